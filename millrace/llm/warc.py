"""WARC archives with an index first: write, look up, read back by coalesced byte ranges.

``write_archives`` turns each page into one record, a gzip member of its own, and returns the index:
file, offset, length, URL, digest and kind of every record.  Of equal payloads of at least
``MIN_SHARED`` bytes the one with the smallest id is a response, the others are revisits without
payload.  Only digests are grouped and joined for that; the payloads move once, by page, so a
payload that a third of all pages share weighs on no single task.

A task writes files with names of its own and Spark commits the index rows of successful attempts
only, so a lost executor leaves at most unreferenced files.  Files roll over at ``ARCHIVE_BYTES``.

``read_records`` takes any selection of index rows, deals them out by file and stretch of file,
sorts them by offset, reads neighbouring records in one request of at most ``READ_BYTES``, and
checks each payload against its digest.  Files are opened through ``pyarrow.fs``, so archives can
be in any store that it knows.

Definitions for odd input: NULL html is the empty payload; pages that repeat an id and payload are
records of their own, all responses if theirs is the smallest id; a page without id revisits like
any other; a NULL URL has no header line; control characters of a URL are percent-encoded in the
header and kept in the index; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import slices, table
from millrace.session import scratch_path

MIN_SHARED = 100
ARCHIVE_BYTES = 512 << 20
STRETCH_BYTES = 32 << 20  # neighbouring records that one task reads in order
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10  # unwanted bytes read along rather than asking twice
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format
INDEX = (
    "page_id long, url string, payload_digest string, payload_bytes long, record_type string, "
    "refers_to long, file string, offset long, length long"
)
GZIP = 31  # zlib's window bits for a gzip member


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One uncompressed record."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {safe(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, the payload's stated length, and the payload that is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, int(re.search(rb"Content-Length: (\d+)", http)[1]), payload


def judged(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to."""
    base = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    keys = base.where(F.octet_length("payload") >= MIN_SHARED).select("page_id", "payload_digest")
    firsts = (
        keys.groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and refers_to is not null")
        .drop("n")
    )
    place = F.xxhash64("page_id", "payload_digest").alias("place")
    revisits = (
        keys.join(firsts, "payload_digest")
        .where("page_id is null or page_id > refers_to")
        .select(place, F.col("payload_digest").alias("digest"), "refers_to")
        .distinct()
    )
    named = base.select("*", place)
    same = (named.place == revisits.place) & (named.payload_digest == revisits.digest)
    return named.join(revisits, same, "left").select("page_id", "url", "payload", "payload_digest", "refers_to")


def _archive(folder: str):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_of(folder)
        fs.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        for piece in slices(batches, "payload"):
            rows = []
            for r in piece.to_pylist():
                if out is None or offset >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(posixpath.join(root, name), compression=None)
                payload = r["payload"].encode("utf-8")
                press = zlib.compressobj(1, zlib.DEFLATED, GZIP)
                data = press.compress(record(r["page_id"], r["url"], payload, r["payload_digest"], r["refers_to"]))
                data += press.flush()
                out.write(data)
                kind = "response" if r["refers_to"] is None else "revisit"
                rows.append(
                    (r["page_id"], r["url"], r["payload_digest"], len(payload), kind, r["refers_to"], name, offset, len(data))
                )
                offset += len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES
            )
        if out:
            out.close()

    return work


NAMES = [part.split(" ")[0] for part in INDEX.split(", ")]
TYPES = [pa.int64() if part.endswith("long") else pa.string() for part in INDEX.split(", ")]


def write_archives(
    pages: DataFrame, folder: str | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> tuple[str, DataFrame]:
    """Write one record per page below ``folder``; the folder and the stored index."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    index = judged(pages, page_id, url, html).mapInArrow(_archive(f"{folder}/archives"), INDEX)
    index.write.parquet(f"{folder}/index")
    return folder, spark.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(wanted: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, members) of the requests for (offset, length) pairs in order of offset."""
    start, end, members = 0, 0, []
    for i, (offset, length) in enumerate(wanted):
        if members and (offset - end > GAP_BYTES or offset + length - start > READ_BYTES):
            yield start, end, members
            members = []
        if not members:
            start, end = offset, offset
        end = max(end, offset + length)
        members.append(i)
    if members:
        yield start, end, members


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The index rows with the payload that each record holds (NULL for revisits)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_of(f"{folder}/archives")
        source, opened = None, None
        for batch in batches:
            rows = batch.select(NAMES).to_pylist()
            first = 0
            while first < len(rows):
                last = first
                while last < len(rows) and rows[last]["file"] == rows[first]["file"]:
                    last += 1
                if opened != rows[first]["file"]:
                    if source:
                        source.close()
                    opened = rows[first]["file"]
                    source = fs.open_input_file(posixpath.join(root, opened))
                part = rows[first:last]
                for start, end, members in ranges([(r["offset"], r["length"]) for r in part]):
                    data = source.read_at(end - start, start)
                    found = [_checked(part[i], data[(o := part[i]["offset"] - start) : o + part[i]["length"]]) for i in members]
                    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), [*TYPES, pa.string()], strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, [*NAMES, "payload"])
                first = last
        if source:
            source.close()

    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    dealt = selected.select(*NAMES).repartition("file", stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(work, INDEX + ", payload string")


def _checked(row: dict, data: bytes) -> tuple:
    """What the record itself says; an error if it is not what the index says."""
    fields, size, payload = parse(zlib.decompress(data, GZIP))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    sound = kind == "revisit" or (hashlib.sha256(payload).hexdigest() == digest and len(payload) == size)
    if not sound or digest != row["payload_digest"] or kind != row["record_type"]:
        raise ValueError(f"record at {row['file']}:{row['offset']} is not the one indexed")
    refers = fields.get("WARC-Refers-To")
    own = row | {
        "payload_digest": digest,
        "payload_bytes": size,
        "record_type": kind,
        "refers_to": int(refers.removeprefix("<urn:page:").rstrip(">")) if refers else None,
    }
    return (*(own[n] for n in NAMES), None if kind == "revisit" else payload.decode("utf-8"))


ORACLE = """
with base as (
  select page_id, coalesce(html, '') as payload, sha256(coalesce(html, '')) as payload_digest from pages
), firsts as (
  select payload_digest, min(page_id) as first_id from base where strlen(payload) >= 100 group by payload_digest
)
select page_id, strlen(payload) as payload_bytes, base.payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from base left join firsts on base.payload_digest = firsts.payload_digest and strlen(payload) >= 100
"""


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    kept, index = write_archives(table(spark, folder, "pages"))
    return read_records(index, kept).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
