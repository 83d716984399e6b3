"""From raw documents to token ids: language, lines, near copies, benchmark, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept;
``run`` writes its result as Parquet below the shared folder and rereads it.  All stages but the last
return the columns of ``docs``, whatever other columns there are; inside a stage columns go by number, so
no name of theirs can clash.

* language ID drops documents without a letter, and documents that no learned language explains
  (more than ``MAX_BITS`` bits a byte in the best one); a NULL language is filled in,
* line dedup takes out repeated lines, ``n_chars`` follows the text,
* near dedup keeps one document of each group of texts with 80 % of their five-word shingles in common;
  rows that repeat an id stay or go together,
* decontamination drops documents that hold a passage of the benchmark,
* BPE gives each document's token ids and what they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, hyperminhash, line_dedup, ppm
from millrace.llm.base import stored, table

MAX_BITS = 6.0
WIDTH = 5  # words of a shingle
ORACLE_SQL: str | None = None  # trees, signatures and automata are beyond SQL; tests hold run() against brute force


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with numbers for names, and the number of each name."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), {n: f"c{i}" for i, n in enumerate(docs.columns)}


def named(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df, at = numbered(docs)
    model = ppm.train(df.where(~ppm.held_out(at["doc_id"])), doc_id=at["doc_id"], text=at["text"], lang=at["lang"])
    found = ppm.predict(df, model, keep=tuple(df.columns), text=at["text"])
    kept = found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MAX_BITS))
    return named(kept.withColumn(at["lang"], F.coalesce(at["lang"], "lang_pred")), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df, at = numbered(docs)
    clean = line_dedup.dedup(df, at["doc_id"], at["text"])
    if "n_chars" in at:
        length = F.length(at["text"]).cast(df.schema[at["n_chars"]].dataType)
        clean = clean.withColumn(at["n_chars"], F.when(F.col("n_dropped") > 0, length).otherwise(F.col(at["n_chars"])))
    return named(clean, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df, at = numbered(docs)
    found = hyperminhash.near_duplicates(df, at["doc_id"], at["text"], width=WIDTH)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return named(df.join(gone, df[at["doc_id"]] == gone.gone, "left_anti"), docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df, at = numbered(docs)
    found = decontaminate.scan(df, table(spark, sf_dir, "benchmark"), keep=tuple(df.columns), text=at["text"])
    return named(found.where("n_hit = 0"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian, 32 bits each)."""
    return bpe.digests(docs, bpe.vocabulary(), "ids_le")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontaminate", benchmark_free),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
