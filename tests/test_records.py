"""Records over line breaks, against Spark's own readers of whole files."""

from __future__ import annotations

import json
import random

import pytest

from millrace.sources import records
from millrace.sources.readers import read_csv, read_json

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def splits(spark):
    """``splits(n)``: files are cut every n bytes."""
    kept = {k: spark.conf.get(k) for k in (SPLIT, "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set(SPLIT, str(n))
    for k, v in kept.items():
        spark.conf.set(k, v)


def quoted(value: str) -> str:
    return '"' + value.replace('"', '""') + '"'


def csv_rows():
    pick = random.Random(3)
    for i in range(400):
        value = "".join(pick.choice(["a", "b,", "\n", '"', "\r\n", " ", "é", '""', ",\n\""]) for _ in range(pick.randint(0, 12)))
        yield i, value, pick.choice(["plain", 'mid"quote', "x y", ""])


@pytest.mark.parametrize("size", [90, 333])
def test_csv_like_the_reader_of_whole_files(spark, splits, tmp_path, size):
    rows = [*csv_rows(), (400, "long\n" * 300, "z")]
    for name, part in (("a.csv", rows[:250]), ("b.csv", rows[250:]), ("empty.csv", [])):
        (tmp_path / name).write_bytes(("id,value,note\n" + "".join(f"{i},{quoted(v)},{n}\r\n" for i, v, n in part)).encode())
    schema = "id long, value string, note string"
    own = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\n")
    splits(size)
    got = read_csv(spark, str(tmp_path), schema=schema, multiLine=True)
    want = {i: v for i, v, _ in rows}
    assert {r.id: r.value or "" for r in got.collect()} == want and got.count() == len(rows)
    if size == 333:
        assert got.rdd.getNumPartitions() > 3
        inferred = read_csv(spark, str(tmp_path), multiLine=True)
        assert dict(inferred.dtypes) == {"id": "int", "value": "string", "note": "string"} and inferred.count() == len(rows)
        theirs = own.schema(schema).csv(str(tmp_path)).collect()
        assert {r.id: r.value for r in theirs} == {r.id: r.value for r in got.collect()}


def test_damaged_records(spark, splits, tmp_path):
    text = "a,b\n" + "".join(f'{i},"x\ny"{",surplus" if i % 10 == 0 else ""}\n' for i in range(100))
    (tmp_path / "d.csv").write_text(text)
    splits(100)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, str(tmp_path), schema="a int, b string", multiLine=True).collect()
    kept = read_csv(spark, str(tmp_path), schema="a int, b string", multiLine=True, keep_damaged="bad")
    assert kept.where("bad is not null").count() == 10 and kept.count() == 100
    assert kept.where("a = 20").first().bad == '20,"x\ny",surplus'


def test_csv_states():
    step = records.Csv().step
    cases = [('a,b', 0, 0), ('a,"b', 0, 1), ('b"', 1, 0), ('b""', 1, 1), ('b"",c"', 1, 0), ('x",y,"z', 1, 1), ('mid"quote,c', 0, 0), ('"a"",b', 0, 1), ('""', 0, 0), ('"', 0, 1), ('"a"b,"c', 0, 1)]
    for piece, before, after in cases:
        assert step(piece, before) == (after, 0), piece


def json_rows():
    pick = random.Random(5)
    for i in range(300):
        text = "".join(pick.choice(['}', '{', '"', "\\", "]", "[", "a", "\n", "é", ","]) for _ in range(pick.randint(0, 12)))
        yield {"id": i, "text": text, "deep": {"x": [{"y": text}, {"y": "}"}]}, "none": None}


@pytest.mark.parametrize("size", [200, 3000])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_array(spark, splits, tmp_path, size, indent):
    rows = [*json_rows()] + [{"id": 300, "text": "}" * 2000, "deep": {"x": []}, "none": None}]
    (tmp_path / "a.json").write_text(json.dumps(rows[:200], indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "b.json").write_text(json.dumps(rows[200:], indent=indent))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "one.json").write_text(json.dumps({"id": 301, "text": "{", "deep": {"x": []}}, indent=indent))
    splits(size)
    got = read_json(spark, str(tmp_path), schema="id long, text string, deep struct<x:array<struct<y:string>>>")
    found = {r.id: (r.text, [x.y for x in r.deep.x]) for r in got.collect()}
    assert found == {r["id"]: (r["text"], [x["y"] for x in r["deep"]["x"]]) for r in rows} | {301: ("{", [])}
    assert got.count() == 302
    if size == 3000:
        assert got.rdd.getNumPartitions() > 4
        assert dict(read_json(spark, str(tmp_path)).dtypes)["deep"] == "struct<x:array<struct<y:string>>>"


def test_json_that_is_no_array_of_objects(spark, splits, tmp_path):
    splits(10)
    (tmp_path / "open.json").write_text('[{"a": 1}, {"a": 2}')
    with pytest.raises(ValueError, match="not closed"):
        read_json(spark, str(tmp_path / "open.json"), schema="a int")
    (tmp_path / "numbers.json").write_text('[1, 2, 3, {"a": 1}, 4, 5]')
    with pytest.raises(Exception, match="not an array of JSON objects"):
        read_json(spark, str(tmp_path / "numbers.json"), schema="a int").collect()
