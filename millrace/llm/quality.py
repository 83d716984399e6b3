"""Quality by distribution divergence, in DataFrame functions only.

Two histograms describe a text: its character classes, and the share of each of its language's most
common words.  Both are compared with the references of all languages by Jensen-Shannon distance
(square root of the divergence to base 2, 0 to 1); the closest language counts.  The references are
sums over all documents that name a language: the ``COMMON`` words that occur most often in it, and
how often its texts hold each class and each of those words.  Junk blurs such sums, so the sums that
count are those of the half of each language's documents whose classes are closest to the first ones.

Length guards: a histogram of few samples is far from its own reference by chance, so a distance is
judged only from ``MIN_CHARS`` code points and ``MIN_WORDS`` words on, and the limit is wider by
``SLACK / sqrt(samples)``.

One scan counts words, one describes the documents (stored, without text), and the rest works on
those rows.  Words found twice in windows of eight are compared by 64-bit hashes.  Everything per
document is array work inside its row; nothing groups by a key that one source could fill.

Definitions for odd input: NULL text has no words and fails the base rule; documents without a
language add to no reference but are judged; without any reference no distance is judged; repeated
rows are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.base import stored, table

BASE_WORDS, BASE_REPEATS, RUN = 20, 30, 8
COMMON = 16  # words per language
MIN_CHARS, MIN_WORDS = 200, 40
CLASS_LIMIT, WORD_LIMIT, SLACK = 0.12, 0.18, 2.5
BLANKS = " \t\n\x0b\x0c\r"
CLASSES = ("plain", "upper", "symbol", "mark", "space", "wide")  # plain: all else, digits among it
FIRST_CODE = 0x4E00  # common words are counted as single characters from here on


def split_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _left(text: Column, other: str) -> Column:
    """How many code points remain without those of the class ``other``."""
    return F.length(F.regexp_replace(text, f"{other}+", ""))


def _shifted(name: str, by: int) -> Column:
    return F.zip_with(
        F.col(name), F.slice(F.col(name), by + 1, F.greatest(F.size(name), F.lit(1))), lambda a, b: F.xxhash64(a, b)
    )


def repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words inside windows of eight that occur twice or more."""
    df = df.withColumn("__1", F.transform("__words", lambda w: F.xxhash64(w)))
    df = df.withColumn("__2", _shifted("__1", 1))
    df = df.withColumn("__4", _shifted("__2", 2))
    df = df.withColumn("__8", F.slice(_shifted("__4", 4), 1, F.greatest(F.col("n_words") - (RUN - 1), F.lit(0)).cast("int")))
    twice = F.size(F.array_distinct("__8")) < F.size("__8")
    sort = F.sort_array(F.transform("__8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(twice, sort))
    same = lambda x, k: F.coalesce(F.get("__s", k)["h"] == x["h"], F.lit(False))
    found = F.filter("__s", lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1))
    df = df.withColumn("__p", F.sort_array(F.transform(found, lambda x: x["i"])))
    steps = F.zip_with(
        "__p", F.slice("__p", 2, F.greatest(F.size("__p"), F.lit(1))), lambda a, b: F.least(F.lit(RUN), F.coalesce(b - a, F.lit(RUN)))
    )
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("__1", "__2", "__4", "__8", "__s", "__p")


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, word, rank): each language's most frequent words of letters."""
    words = docs.where("lang is not null and text is not null").select("lang", F.explode(split_words(F.col("text"))).alias("word"))
    counted = words.where(r"length(word) <= 16").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return (
        counted.where(F.col("word").rlike(r"^\p{L}+$"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= COMMON)
        .drop("n")
    )


def describe(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """One row per document: the base counts, class counts and counts of the common words."""
    text, length = F.coalesce("text", F.lit("")), F.length("__text")
    df = docs.select("doc_id", "lang", text.alias("__text")).withColumn("__words", split_words(F.col("__text")))
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    df = df.withColumn("n_symbols", _left(F.col("__text"), r"[^#*$%&|<>]").cast("long"))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    counts = {
        "upper": _left(F.col("__text"), r"[^A-Z]"),
        "symbol": F.col("n_symbols"),
        "mark": _left(F.col("__text"), r"[^!-~&&[^A-Za-z0-9#*$%&|<>]]"),
        "space": length - F.col("word_chars"),
        "wide": F.octet_length("__text") - length,  # bytes beyond the first of each code point
    }
    df = df.withColumns({f"__{k}": v.cast("double") for k, v in counts.items()})
    rest = length - sum((F.col(f"__{k}") for k in CLASSES[1:-1]), F.lit(0.0))
    df = df.withColumn("classes", F.array(F.greatest(rest, F.lit(0.0)), *(F.col(f"__{k}") for k in CLASSES[1:])))
    if vocabulary:
        codes = F.create_map(*(F.lit(x) for i, w in enumerate(vocabulary) for x in (w, chr(FIRST_CODE + i))))
        df = df.withColumn("__codes", F.array_join(F.transform("__words", lambda w: codes[w]), ""))
        n = F.length("__codes")
        count = lambda i: (n - F.length(F.replace("__codes", F.lit(chr(FIRST_CODE + i))))).cast("double")
        df = df.withColumn("commons", F.array(*map(count, range(len(vocabulary)))))
    else:
        df = df.withColumn("commons", F.array().cast("array<double>"))
    return repeated_words(df).select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "commons"
    )


def references(described: DataFrame, ranked: list) -> list[tuple[str, list[float], list[int], list[float]]]:
    """Per language: class shares, places of its common words in the vocabulary, their shares and the rest's."""
    vocabulary = sorted({r.word for r in ranked})
    sums = described.where("lang is not null").groupBy("lang").agg(
        F.sum("n_words").alias("n"),
        *(F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))),
        *(F.sum(F.get("commons", F.lit(i))).alias(f"w{i}") for i in range(len(vocabulary))),
    )
    out = []
    for r in sorted(sums.collect(), key=lambda r: r.lang):
        places = [i for i, w in enumerate(vocabulary) if any(x.lang == r.lang and x.word == w for x in ranked)]
        chars = sum(r[f"c{i}"] for i in range(len(CLASSES)))
        if not chars or not r.n:
            continue
        own = [r[f"w{i}"] / r.n for i in places]
        out.append((r.lang, [r[f"c{i}"] / chars for i in range(len(CLASSES))], places, [*own, max(0.0, 1 - sum(own))]))
    return out


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / F.greatest(total, F.lit(1.0)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, to base 2."""

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (part(a) + part(b)) / 2

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0)))


def judge(described: DataFrame, refs: list[tuple[str, list[float], list[int], list[float]]]) -> DataFrame:
    """Adds base_failed, the distances to the closest language, and kept."""
    failed = (F.col("n_words") < BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_REPEATS)
    df = described.withColumn("base_failed", failed)
    chars = F.aggregate("classes", F.lit(0.0), lambda acc, x: acc + x)
    df = df.withColumn("__chars", chars).withColumn("__p", shares(F.col("classes"), F.col("__chars")))
    if not refs:
        none = F.lit(None).cast("double")
        df = df.withColumns({"class_distance": none, "word_distance": none, "closest": F.lit(None).cast("string")})
        return df.withColumn("kept", ~F.col("base_failed")).drop("__p", "__chars")
    found = []
    for lang, classes, places, words in refs:
        own = F.array(*(F.get("commons", F.lit(i)) for i in places)) if places else F.array().cast("array<double>")
        rest = F.greatest(F.col("n_words") - F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0))
        q = shares(F.concat(own, F.array(rest)), F.col("n_words").cast("double"))
        found.append(
            F.struct(
                distance(q, F.array(*map(F.lit, words))).alias("w"),
                distance(F.col("__p"), F.array(*map(F.lit, classes))).alias("c"),
                F.lit(lang).alias("lang"),
            )
        )
    df = df.withColumn("__best", F.array_min(F.array(*found)))
    df = df.withColumns({"class_distance": F.col("__best.c"), "word_distance": F.col("__best.w"), "closest": F.col("__best.lang")})
    odd_class = (F.col("__chars") >= MIN_CHARS) & (F.col("class_distance") > limit(CLASS_LIMIT, len(CLASSES), F.col("__chars")))
    odd_words = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > limit(WORD_LIMIT, COMMON + 1, F.col("n_words")))
    return df.withColumn("kept", ~(F.col("base_failed") | odd_class | odd_words)).drop("__p", "__chars", "__best")


def limit(base: float, bins: int, samples: Column) -> Column:
    """``base``, widened by what few samples add by chance: (bins - 1) / (8 n ln 2) on average."""
    return F.sqrt(F.lit(base * base) + SLACK * (bins - 1) / (8 * math.log(2)) / F.greatest(samples, F.lit(1)))


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance, closest, kept."""
    docs = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
        F.col(f"`{lang}`").cast("string").alias("lang"),
    )
    ranked = common_words(docs).collect()  # COMMON rows per language
    described = stored(describe(docs, sorted({r.word for r in ranked})), "described")
    rough = judge(described, references(described, ranked)).where("not base_failed and lang is not null")
    middle = rough.groupBy("lang").agg(F.percentile_approx("class_distance", 0.5).alias("c")).collect()
    limits = F.create_map(*(F.lit(x) for r in middle if r.c is not None for x in (r.lang, r.c)))
    typical = rough.where(F.col("class_distance") <= limits[F.col("lang")]) if middle else rough
    return judge(described, references(typical, ranked)).drop("classes", "commons", "lang")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return assess(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance", "closest",
    )
