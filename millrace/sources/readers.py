"""Reading files of many formats into DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.html import add_html_text
from millrace.session import split_bytes
from millrace.sources import files, records

Reader = Callable[..., DataFrame]


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: T.StructType | str | None = None,
    keep_damaged: str | None = None,
    parallel: bool | None = None,
    **opts,
) -> DataFrame:
    """Delimited text with a header.  Give a schema for large inputs: inferring reads them twice.

    A line with too many or too few fields, or with a quote left open, raises an error: nothing is
    shortened silently.  Values with line breaks need ``multiLine=True``; files larger than a split are
    then read by many tasks (``millrace.sources.records``), unless an option asks for what only Spark's own
    reader of whole files knows; ``parallel`` forces the one or the other.  ``keep_damaged`` names a column that receives damaged lines whole instead.
    """
    if str(opts.get("multiLine", False)).lower() == "true" and _in_parts(spark, path, opts, CSV_PLAIN, parallel):
        return _csv_records(spark, path, sep, schema, keep_damaged, opts)
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("columnPruning", False)  # else unread columns hide surplus fields
        .option("mode", "FAILFAST" if keep_damaged is None else "PERMISSIVE")
        .options(**opts)
    )
    if schema is None:
        schema = reader.option("mode", "PERMISSIVE").option("inferSchema", True).csv(path).schema
        reader = reader.option("mode", "FAILFAST" if keep_damaged is None else "PERMISSIVE").options(**opts)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if keep_damaged is not None:
        schema = T.StructType([*schema.fields, T.StructField(keep_damaged, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", keep_damaged)
    return reader.schema(schema).csv(path)


CSV_PLAIN = ("multiLine", "lineSep", "nullValue", "dateFormat", "timestampFormat", "mode")
JSON_PLAIN = ("dateFormat", "timestampFormat", "mode", "primitivesAsString", "columnNameOfCorruptRecord")


def _in_parts(spark: SparkSession, path: str, opts: dict, plain: Sequence[str], wanted: bool | None) -> bool:
    """Whether a file is larger than a split and could be split; only the listing is read."""
    if wanted is not None:
        return wanted
    if not set(opts) <= set(plain) or opts.get("lineSep", "\n") != "\n":
        return False
    listed = spark.read.format("binaryFile").load(path)
    packed = F.lower("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$")
    largest = listed.agg(F.max(F.when(~packed, F.col("length")))).first()[0]
    return (largest or 0) > split_bytes(spark)


def _csv_records(spark, path, sep, schema, keep_damaged, opts) -> DataFrame:
    rows = records.as_strings(records.records(spark, path, records.Csv(sep)).where("not head").select("value"))
    mode = "FAILFAST" if keep_damaged is None else "PERMISSIVE"
    own = {"sep": sep, "quote": '"', "escape": '"', "columnPruning": False, **opts, "multiLine": True, "lineSep": "\n"}
    reader = spark.read.options(**own)
    if schema is None:
        first = spark.read.options(**own).option("header", True).csv(path).columns
        inferred = DataFrame(reader.option("inferSchema", True)._jreader.csv(rows), spark).schema
        schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(first, inferred, strict=True)])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    reader = spark.read.options(**({"mode": mode} | own))
    if keep_damaged is not None:
        schema = T.StructType([*schema.fields, T.StructField(keep_damaged, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", keep_damaged)
    return DataFrame(reader.schema(schema)._jreader.csv(rows), spark)


def read_tsv(spark: SparkSession, path: str, **opts) -> DataFrame:
    return read_csv(spark, path, sep="\t", **opts)


def read_json(
    spark: SparkSession, path: str, lines: bool = False, schema=None, parallel: bool | None = None, **opts
) -> DataFrame:
    """One JSON document per file, or one per line.

    A file that is larger than a split and holds an array of objects, or objects one after the other, is read by
    many tasks.
    """
    if not lines and _in_parts(spark, path, opts, JSON_PLAIN, parallel):
        rows = records.as_strings(records.records(spark, path, records.Json()).select("value"))
        reader = spark.read.options(**opts)
        return DataFrame((reader.schema(schema) if schema else reader)._jreader.json(rows), spark)
    reader = spark.read.option("multiLine", not lines).options(**opts)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, **opts) -> DataFrame:
    return read_json(spark, path, lines=True, **opts)


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None, schema=None, **opts):
    """One row per ``row_tag`` element; without it one row per document, nested below its root."""
    tag = row_tag or _root_tag(spark, path)
    reader = spark.read.format("xml").option("rowTag", tag).options(**opts)
    return (reader.schema(schema) if schema else reader).load(path)


def _root_tag(spark: SparkSession, path: str) -> str:
    opening = F.regexp_extract("value", r"<([A-Za-z_][\w.:-]*)", 1)
    row = spark.read.text(path).select(opening.alias("tag")).where("tag <> ''").first()
    if row is None:
        raise ValueError(f"no XML element in {path}")
    return row["tag"]


def read_parquet(spark: SparkSession, path: str, **opts) -> DataFrame:
    return spark.read.options(**opts).parquet(path)


def read_avro(spark: SparkSession, path: str, **opts) -> DataFrame:
    try:
        return spark.read.format("avro").options(**opts).load(path)
    except AnalysisException as error:
        raise RuntimeError(
            "Avro needs Spark's spark-avro module on the class path (--packages)"
        ) from error


def read_text(spark: SparkSession, path: str, whole: bool = True, **opts) -> DataFrame:
    """``(path, text)``, one row per file or per line.

    Whole files of a folder are listed and read by tasks (``files.read_whole``), unless an option asks for what only
    Spark's own reader knows.
    """
    if whole and not opts and (found := files.read_whole(spark, path)) is not None:
        return found
    return spark.read.options(**opts).text(path, wholetext=whole).select(
        F.input_file_name().alias("path"), F.col("value").alias("text")
    )


def read_html(spark: SparkSession, path: str, **opts) -> DataFrame:
    """``(path, text)`` with the markup removed."""
    return add_html_text(read_text(spark, path, **opts), "text")


def read_gzip(spark: SparkSession, path: str, **opts) -> DataFrame:
    """Compressed text, one row per file or (``whole=False``) per line.

    ``x.csv.gz`` and the like are read by their inner format.
    """
    inner = os.path.splitext(path[: -len(".gz")])[1].lower() if path.endswith(".gz") else ""
    return _GZIP_INNER.get(inner, read_text)(spark, path, **opts)


_GZIP_INNER: dict[str, Reader] = {
    ".csv": read_csv,
    ".tsv": read_tsv,
    ".json": read_json,
    ".jsonl": read_json_lines,
    ".xml": read_xml,
}

READERS: dict[str, Reader] = {
    ".csv": read_csv,
    ".tsv": read_tsv,
    ".json": read_json,
    ".jsonl": read_json_lines,
    ".xml": read_xml,
    ".html": read_html,
    ".txt": read_text,
    ".log": read_text,
    ".sql": read_text,
    ".hl7": read_text,
    ".rtf": read_text,
    ".odt": read_text,
    ".parquet": read_parquet,
    ".feather": files.read_feather,
    ".avro": read_avro,
    ".eml": files.read_mail,
    ".gz": read_gzip,
    ".zip": files.read_zip,
    ".tar": files.read_tar,
}

# Formats whose contents only a per-file desktop or media library can read.
# fmt: off
NOT_READ = (  # fixed values
    ".xlsx", ".xls", ".ods", ".pdf", ".docx", ".doc", ".pptx", ".ppt", ".yaml", ".yml", ".wav", ".mp3", ".mp4",
    ".sqlite", ".db",
)
# fmt: on


def read_any(spark: SparkSession, path: str, fmt: str | None = None, **opts) -> DataFrame:
    """Read by file extension, or by ``fmt`` for folders and globs."""
    ext = "." + fmt.lstrip(".").lower() if fmt else os.path.splitext(path)[1].lower()
    if ext in NOT_READ:
        hint = "use read_database" if ext in (".sqlite", ".db") else "convert it first"
        raise ValueError(f"File format {ext} is not read by Spark: {hint}")
    if ext not in READERS:
        raise ValueError(f"Unsupported file format: {ext}")
    return READERS[ext](spark, path, **opts)


def read_catalog(
    spark: SparkSession, tables: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Every table of the current database, lazily."""
    names = tables or [t.name for t in spark.catalog.listTables()]
    return {t: spark.table(t) for t in names}


def read_database(
    spark: SparkSession, url: str, tables: Sequence[str], **opts
) -> dict[str, DataFrame]:
    """The named tables of a database, through whatever JDBC driver the session carries.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to read a large
    table in parallel.
    """
    return {
        t: spark.read.format("jdbc").options(url=url, dbtable=t, **opts).load() for t in tables
    }
