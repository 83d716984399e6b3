"""Formats Spark has no reader for: feather, e-mail, zip and tar; and folders of very many files.

A task lists a folder, its names are spread over tasks, and each task opens its own files; the driver holds
no list of files.  Members and record batches are passed on one at a time, so a task holds one of them, not a
whole archive's contents twice.
"""

from __future__ import annotations

import email
import email.policy
import gzip
import os
import re
import tarfile
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from millrace.session import scratch_path, split_bytes

BATCH_BYTES = 8 * 1024 * 1024
BATCH_ROWS = 1_000
NAMES = 10_000  # names a task holds while it lists a folder
FILES_PER_TASK = 2_000
PACKED = (".bz2", ".deflate", ".lz4", ".snappy", ".zst")  # fixed values: besides .gz, what Spark unpacks by its ending
GLOB = re.compile(r"[{}\[\]*?\\]")
QUOTED = re.compile(r"[\x00-\x20\"#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # what a URI has no place for

MEMBER_SCHEMA = "archive string, member string, content binary, text string"
MAIL_SCHEMA = "path string, subject string, sender string, recipient string, body string"


def _open(uri: str):
    """A readable handle for a path Spark listed (local, mounted or object store)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(_local(uri))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _local(uri: str) -> str:
    """The plain path behind ``file:``, which Spark does not quote."""
    return "/" + uri[len("file:") :].lstrip("/")


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder that a task can list by itself (local or mounted), else None."""
    if GLOB.search(path):
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getScheme() != "file" or not system.exists(at) or not system.getFileStatus(at).isDirectory():
        return None
    return system.makeQualified(at).toUri().getPath()


def _hidden(name: str) -> bool:
    """Whether Spark passes over the name when it lists a folder."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _listing(spark: SparkSession, path: str, unfit: tuple[str, ...] = ()) -> DataFrame | None:
    """``(path)`` of the files in a folder, in parts of bounded number and length, or None if Spark must list it.

    One task walks through the folder, a stretch of names at a time, and writes them down; the driver only learns their
    number and length.  As in Spark's own listing, hidden and empty files are left out.  Globs, stores other than a
    local or mounted one, folders in folders (which may be partitions) and names that end in ``unfit`` are Spark's.
    """
    folder = _local_folder(spark, path)
    if folder is None:
        return None

    arrow = pa.schema([("path", pa.string()), ("length", pa.int64()), ("odd", pa.bool_())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        with os.scandir(folder) as entries:
            for entry in entries:
                if _hidden(entry.name):
                    continue
                try:
                    inner, length = entry.is_dir(), entry.stat().st_size
                except FileNotFoundError:  # gone since
                    continue
                if inner or length:
                    rows.append(("file:" + os.path.join(folder, entry.name), 0 if inner else length, inner or entry.name.lower().endswith(unfit)))
                if len(rows) == NAMES:
                    yield _batch(rows, arrow)
                    rows = []
        if rows:
            yield _batch(rows, arrow)

    kept, schema = scratch_path(spark, "listed"), "path string, length bigint, odd boolean"
    spark.range(0, 1, 1, 1).mapInArrow(walk, schema).write.parquet(kept)
    listed = spark.read.schema(schema).parquet(kept)
    number, length, odd = listed.agg(F.count("path"), F.coalesce(F.sum("length"), F.lit(0)), F.count_if("odd")).first()
    if odd:
        return None
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(number, cores), -(-number // FILES_PER_TASK), min(number, -(-length // split_bytes(spark))))
    return listed.select("path").repartition(parts)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path)`` of the files, dealt out to tasks; contents are not read."""
    listed = _listing(spark, path)
    return spark.read.format("binaryFile").load(path).select("path") if listed is None else listed


def read_whole(spark: SparkSession, path: str) -> DataFrame | None:
    """``(path, text)``, one row per file of a folder, as Spark's text reader gives them; None if only that can read it.

    Bytes that are no UTF-8 stay as they are, gzip files are unpacked, and paths are quoted as URIs.
    """
    listed = _listing(spark, path, PACKED)
    if listed is None:
        return None
    arrow = pa.schema([("path", pa.string()), ("data", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with _open(uri) as handle:
                    data = handle.readall()
                shown = "file://" + QUOTED.sub(lambda m: quote(m[0], safe=""), _local(uri))
                yield shown, gzip.decompress(data) if uri.lower().endswith(".gz") else data

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(rows(batches), arrow)

    read = listed.mapInArrow(load, "path string, data binary")
    return read.select("path", F.col("data").cast("string").alias("text"))


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files, streamed batch by batch; the schema is the union of all files' schemas.

    The schemas are read by tasks, and only the different ones reach the driver.  A column that a
    file lacks is NULL there.
    """
    files = list_files(spark, path)

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with _open(uri) as handle:
                    own = pa.ipc.open_file(handle).schema.remove_metadata().serialize().to_pybytes()
                found[own] = min(uri, found.get(own, uri))
        yield pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), pa.array([*found.values()], pa.string())], ["head", "uri"])

    seen = files.mapInArrow(headers, "head binary, uri string").groupBy("head").agg({"uri": "min"}).collect()
    if not seen:
        raise ValueError(f"no files at {path}")
    heads = [bytes(r["head"]) for r in sorted(seen, key=lambda r: r[1])]
    arrow_schema = pa.unify_schemas(
        [pa.ipc.read_schema(pa.py_buffer(h)) for h in heads], promote_options="permissive"
    )
    schema = from_arrow_schema(arrow_schema, prefer_timestamp_ntz=True)

    def filled(part: pa.RecordBatch) -> pa.RecordBatch:
        columns = [
            part.column(f.name).cast(f.type) if f.name in part.schema.names else pa.nulls(part.num_rows, f.type)
            for f in arrow_schema
        ]
        return pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with _open(uri) as handle:
                    reader = pa.ipc.open_file(handle)
                    for i in range(reader.num_record_batches):
                        yield filled(reader.get_batch(i))

    return files.mapInArrow(load, schema)


def _packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about eight megabytes at most."""
    pending, size = [], 0
    for row in rows:
        pending.append(row)
        size += sum(len(v) for v in row if v is not None)
        if size > BATCH_BYTES or len(pending) == BATCH_ROWS:
            yield _batch(pending, schema)
            pending, size = [], 0
    if pending:
        yield _batch(pending, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(v, f.type) for v, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _text(data: bytes) -> str:
    return data.decode("utf-8", errors="ignore")


def _zip_members(handle) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(handle) as archive:
        for info in archive.infolist():
            yield info.filename, archive.read(info)


def _tar_members(handle) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=handle, mode="r|*") as archive:
        for member in archive:
            body = archive.extractfile(member)
            if body:
                yield member.name, body.read()


def _members(files: DataFrame, walk) -> DataFrame:
    arrow = pa.schema(
        [("archive", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("text", pa.string())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with _open(uri) as handle:
                    for name, data in walk(handle):
                        yield uri, name, data, _text(data)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(rows(batches), arrow)

    return files.mapInArrow(load, MEMBER_SCHEMA)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """One row per member.  The archives of a folder are read in parallel, one archive per task."""
    return _members(list_files(spark, path), _zip_members)


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """One row per file member; compressed tars as well."""
    return _members(list_files(spark, path), _tar_members)


def _body(message) -> str:
    """The text of a message; the text parts of a multipart one, joined."""
    parts = message.walk() if message.is_multipart() else [message]
    texts = []
    for part in parts:
        if part.get_content_maintype() == "text":
            data = part.get_payload(decode=True) or b""
            charset = part.get_content_charset() or "utf-8"
            try:
                texts.append(data.decode(charset, errors="ignore"))
            except LookupError:
                texts.append(_text(data))
    return "\n".join(texts)


def _parse_mail(uri: str, raw: bytes) -> tuple:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    head = [message.get(k) for k in ("subject", "from", "to")]
    return (uri, *(None if h is None else str(h) for h in head), _body(message))


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """``(path, subject, sender, recipient, body)``, one row per ``.eml`` file."""
    arrow = pa.schema([(n, pa.string()) for n in ("path", "subject", "sender", "recipient", "body")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with _open(uri) as handle:
                    yield _parse_mail(uri, handle.readall())

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(rows(batches), arrow)

    return list_files(spark, path).mapInArrow(load, MAIL_SCHEMA)
