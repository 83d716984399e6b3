"""Small tables shared by the tests, and plain versions of the operators."""

from __future__ import annotations

import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score string, key string, rep long, word string, ids string, n_lines long, `__text` string"
)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} and{i % 53}" for i in range(9000))
PROSE = "the cat sat on the mat and looked at the dog that was in the garden of the old house by the river"


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORDS.findall(lower(text))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None, "x", "k", 7, "w", "i", 3, "t")


def texts():
    """NULLs in any column, empty, long, equal and repeated rows."""
    return [
        row(1, PROSE + "\nA shared line of text.\n" + PROSE.upper()),
        row(2, "A shared line of text.\nsomething else entirely, told in other words than before"),
        row(3, "  a SHARED line of text. \n\n" + PROSE),
        row(4, ""),
        row(5, None),
        row(6, LONG),
        row(7, LONG + " tail"),
        row(8, PROSE, None),
        row(8, PROSE, None),
        row(9, "12 34 !! ??"),
        row(10, "short"),
        row(None, PROSE),
        row(11, "été à Zürich — ÉTÉ\x00 日本語 😀 " * 4, "fr"),
        row(12, "\n\n \t\r\n"),
        row(13, "x y z"),
        row(14, "X y\tz"),
    ]


def table_of(spark, rows=None):
    return spark.createDataFrame(texts() if rows is None else rows, SCHEMA)
