"""HTML to text as a column operator."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is not text of the page.
SILENT_ELEMENTS = ("script", "style", "template", "rt", "rp")

# Entities replaced in the JVM.  The ampersand comes last, so "&amp;lt;" stays "&lt;".
COMMON_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)

# a ``>`` inside a quoted attribute does not end its tag; a tag whose quote never closes ends at its ``>``
_TAG = r"</?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[A-Za-z][^>]*>"
_DECLARATION = r"<![^>]*>|<\?[^>]*>"
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"  # one left open reaches to the end


def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def strip_markup(col: Column) -> Column:
    """Drop comments, silent elements, declarations and tags; keep all other text as it is."""
    out = F.regexp_replace(col, _COMMENT, "")
    for name in SILENT_ELEMENTS:
        opening = rf"<{name}\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
        out = F.regexp_replace(out, rf"(?is){opening}.*?</{name}\s*>", "")
    return F.regexp_replace(out, f"{_DECLARATION}|{_TAG}", "")


def unescape_common(col: Column) -> Column:
    out = col
    for entity, char in COMMON_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def html_to_text(col: Column, all_entities: bool = True) -> Column:
    """Text of a page, pieces joined without separators, as one expression.

    For whole tables ``add_html_text`` is the better choice: it strips the markup only once.
    """
    return _resolved(strip_markup(col), all_entities)


def add_html_text(
    df: DataFrame, column: str, into: str = "text", all_entities: bool = True
) -> DataFrame:
    """Add the text of a page column.

    Stripping is a step of its own, because both ways of resolving entities read its result.
    """
    stripped = df.withColumn(into, strip_markup(df[column]))
    return stripped.withColumn(into, _resolved(stripped[into], all_entities))


def _resolved(text: Column, all_entities: bool) -> Column:
    """Common entities are replaced in the JVM.  Only rows that hold any other entity are handed
    to the Arrow helper, which knows the complete table; every other row sends it a NULL."""
    plain = unescape_common(text)
    if not all_entities:
        return plain
    known = "|".join(e[1:-1] for e, _ in COMMON_ENTITIES)
    rare = text.rlike(rf"&(?!(?:{known});)#?[A-Za-z0-9]")
    full = F.pandas_udf(_unescape, T.StringType())
    return F.coalesce(full(F.when(rare, text)), plain)
