"""Nested XML as a table of nodes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = (
    "doc string, pre long, last long, parent long, level int, ancestors array<long>, path string, tag string, "
    "attributes map<string,string>, text string, error string"
)
CHUNK = 1 << 20  # bytes parsed before nodes are handed on
_FIELDS = [
    ("doc", pa.string()), ("pre", pa.int64()), ("last", pa.int64()), ("parent", pa.int64()), ("level", pa.int32()),
    ("ancestors", pa.list_(pa.int64())), ("path", pa.string()), ("tag", pa.string()),
    ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("error", pa.string()),
]


class _Walk:
    """What is open while a document's events pass, and the nodes that have ended since they were last taken."""

    def __init__(self, doc: str):
        self.doc, self.next, self.open, self.done = doc, 0, [], []
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.buffer_text = True
        self.parser.StartElementHandler = self.start
        self.parser.EndElementHandler = self.end
        self.parser.CharacterDataHandler = self.data

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        tag = "{" + tag if "}" in tag else tag
        up = self.open[-1] if self.open else None
        if up:
            up["leaf"] = False
        node = {
            "doc": self.doc, "pre": self.next, "parent": up["pre"] if up else None, "level": len(self.open),
            "ancestors": [*up["ancestors"], up["pre"]] if up else [], "path": f"{up['path'] if up else ''}/{tag}", "tag": tag,
            "attributes": [("{" + k if "}" in k else k, v) for k, v in attributes.items()], "text": [], "leaf": True, "error": None,
        }
        self.next += 1
        self.open.append(node)

    def data(self, text: str) -> None:
        if self.open and self.open[-1]["leaf"]:
            self.open[-1]["text"].append(text)

    def end(self, tag: str) -> None:
        node = self.open.pop()
        self.done.append(node | {"last": self.next - 1, "text": "".join(node["text"]).strip()})

    def take(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _FIELDS], [n for n, _ in _FIELDS])

    def events(self, content: bytes) -> Iterator[pa.RecordBatch]:
        try:
            for at in range(0, len(content), CHUNK):
                self.parser.Parse(content[at : at + CHUNK], False)
                yield self.take()
            self.parser.Parse(b"", True)
        except expat.ExpatError as wrong:
            self.done.append(dict.fromkeys(n for n, _ in _FIELDS) | {"doc": self.doc, "error": str(wrong)})
        yield self.take()


def nodes(docs: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """One row per element of each document of ``docs``.

    ``pre`` numbers the elements of a document in the order they begin; those inside an element have a ``pre``
    above its own and up to its ``last``.  ``ancestors`` are the numbers from the root down to the parent, so
    questions about subtrees are equi-joins (``inside``).  ``text`` is what stands before the first child, trimmed, and
    empty if there is none.  Names in a namespace read ``{uri}name``.

    Documents are parsed as a stream of events: a task holds the bytes of one document and its open elements.  A
    document that is not well formed gives the elements that ended before the fault, and one row with ``error`` alone; so
    does an empty or NULL one.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0), batch.column(1), strict=True):
                for out in _Walk(doc.as_py()).events(data.as_py() or b""):
                    yield out

    given = docs.select(F.col(f"`{name}`").cast("string"), F.col(f"`{content}`").cast("binary"))
    return given.mapInArrow(work, NODES)


def read_xml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of all files below ``path``; ``doc`` is a file's address.  A file is one task."""
    return nodes(spark.read.format("binaryFile").load(path).select("path", "content"))


def inside(table: DataFrame, tops: DataFrame, prefix: str = "top_") -> DataFrame:
    """Each node that lies inside an element of ``tops`` (rows of such a table), with that element's columns beside it."""
    held = tops.select(*(F.col(f"`{c}`").alias(prefix + c) for c in tops.columns))
    inner = table.withColumn("_up", F.explode("ancestors"))
    on = (F.col("doc") == F.col(prefix + "doc")) & (F.col("_up") == F.col(prefix + "pre"))
    return inner.join(held, on).drop("_up")
