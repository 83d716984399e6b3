"""Files of formats Spark cannot write, written by tasks from the rows of a table.

Each partition becomes one file (or, for mail, one file per row) in a shared folder, so the set of
files grows with the table.
"""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from email.message import EmailMessage

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import is_scan, scratch_path, splits_of


FILES_PER_TASK = 2_000  # where each row becomes a file
MOST_FILES = 8  # times FILES_PER_TASK, that a split may hold and still be left as it is
EACH_SPLIT = 4 << 20  # bytes of a table whose rows become a file each


def _one_each(df: DataFrame) -> DataFrame:
    """Rows that become a file each, dealt out by their number: a file costs far more than its bytes.

    Splits of a scan that hold few enough are left as they are, since a shuffle would keep all rows on disk once more.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if is_scan(df):
        held = df.groupBy(F.spark_partition_id()).count()
        splits, most, rows = held.agg(F.count("count"), F.max("count"), F.coalesce(F.sum("count"), F.lit(0))).first()
        if splits >= cores and most <= MOST_FILES * FILES_PER_TASK:
            return df
    else:
        rows = df.count()
    return df.repartition(max(cores, -(-rows // FILES_PER_TASK)))


def _write(
    df: DataFrame, label: str, encode: Callable[[int, list], dict[str, bytes]], folder: str | None = None
) -> str:
    folder = folder or scratch_path(df.sparkSession, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        part, n = TaskContext.get().partitionId(), 0
        system, base = fs.FileSystem.from_uri(folder)
        for i, batch in enumerate(batches):
            if not i:
                system.create_dir(base, recursive=True)
            for name, data in encode(part * 100_000 + i, batch).items():
                with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(data)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    df.mapInArrow(run, "files bigint").agg({"files": "sum"}).collect()
    return folder


def _write_each(df: DataFrame, label: str, encode: Callable[[int, list], dict[str, bytes]]) -> str:
    with splits_of(df.sparkSession, EACH_SPLIT):
        return _write(_one_each(df), label, encode)


def text_files(df: DataFrame) -> str:
    """``(name, text)`` rows, a file each."""
    return _write_each(df, "text", lambda i, batch: {f"{r['name']}.txt": r["text"].encode() for r in batch.to_pylist()})


def json_files(df: DataFrame) -> str:
    """One JSON array of whole rows per batch."""

    def encode(i: int, batch: pa.RecordBatch) -> dict[str, bytes]:
        return {f"part-{i}.json": json.dumps(batch.to_pylist()).encode()}

    return _write(df, "json", encode)


def feather_files(df: DataFrame, folder: str | None = None) -> str:
    def encode(i: int, batch: pa.RecordBatch) -> dict[str, bytes]:
        sink = io.BytesIO()
        with pa.ipc.new_file(sink, batch.schema) as writer:
            writer.write_batch(batch)
        return {f"part-{uuid.uuid4().hex}.feather": sink.getvalue()}

    return _write(df, "feather", encode, folder)


def zip_files(df: DataFrame) -> str:
    """``(name, text)`` rows as members."""

    def encode(i: int, batch: pa.RecordBatch) -> dict[str, bytes]:
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive:
            for row in batch.to_pylist():
                archive.writestr(row["name"], row["text"])
        return {f"part-{i}.zip": sink.getvalue()}

    return _write(df, "zip", encode)


def tar_files(df: DataFrame) -> str:
    def encode(i: int, batch: pa.RecordBatch) -> dict[str, bytes]:
        sink = io.BytesIO()
        with tarfile.open(fileobj=sink, mode="w") as archive:
            for row in batch.to_pylist():
                data = row["text"].encode()
                info = tarfile.TarInfo(row["name"])
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
        return {f"part-{i}.tar": sink.getvalue()}

    return _write(df, "tar", encode)


def gzip_files(df: DataFrame) -> str:
    def encode(i: int, batch: pa.RecordBatch) -> dict[str, bytes]:
        return {
            f"{row['name']}.txt.gz": gzip.compress(row["text"].encode()) for row in batch.to_pylist()
        }

    return _write_each(df, "gzip", encode)


def mail_files(df: DataFrame) -> str:
    """``(name, subject, sender, recipient, body, html)`` rows; those with ``html`` become multipart."""

    def encode(i: int, batch: pa.RecordBatch) -> dict[str, bytes]:
        out = {}
        for k, row in enumerate(batch.to_pylist()):
            message = EmailMessage()
            message["Subject"], message["From"], message["To"] = (
                row["subject"],
                row["sender"],
                row["recipient"],
            )
            message.set_content(row["body"])
            if row["html"] is not None:
                message.add_attachment(row["html"], subtype="html")
            out[f"{row['name']}.eml"] = message.as_bytes()
        return out

    return _write_each(df, "mail", encode)
