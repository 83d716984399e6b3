"""Files in, tables out."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile

import pyarrow as pa
import pyarrow.feather as feather
import pytest

from millrace.operators.catalog import schema_text
from millrace.operators.sqlq import SqlAgent, extract_select, run_select
from millrace.plans.flow import run_workflow
from millrace.session import CHECKPOINT_KEY, scratch_path
from millrace.sources import files
from millrace.sources.readers import read_any
from millrace.sources.sinks import cleaned_name, save_table


def test_unknown_formats(spark):
    with pytest.raises(ValueError, match="Unsupported"):
        read_any(spark, "x.foo")
    with pytest.raises(ValueError, match="not read"):
        read_any(spark, "x.pdf")
    with pytest.raises(RuntimeError, match="spark-avro"):
        read_any(spark, "x.avro")


def test_xml_document(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?>\n<shop><item id='1'>x</item></shop>")
    row = read_any(spark, str(tmp_path / "a.xml")).first()
    assert row.item["_id"] == 1 and row.item["_VALUE"] == "x"


def test_feather_keeps_types(spark, tmp_path):
    table = pa.table({"a": [1, None], "t": pa.array([0, 1], pa.timestamp("us")), "l": [[1], []]})
    for compression in ("uncompressed", "lz4"):
        feather.write_feather(table, str(tmp_path / f"{compression}.feather"), compression)
    df = read_any(spark, str(tmp_path), "feather")
    assert dict(df.dtypes) == {"a": "bigint", "t": "timestamp_ntz", "l": "array<bigint>"}
    assert df.count() == 4 and df.where("a is null").count() == 2


def test_archives_with_bytes_and_folders(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.txt", "hé")
        z.writestr("b.bin", b"\xff\x00ok")
    rows = {r.member: r for r in read_any(spark, str(tmp_path / "z.zip")).collect()}
    assert rows["d/a.txt"].text == "hé" and bytes(rows["b.bin"].content) == b"\xff\x00ok"
    with tarfile.open(tmp_path / "t.tar", "w:gz") as t:
        info = tarfile.TarInfo("x/y.txt")
        info.size = 2
        t.addfile(tarfile.TarInfo("x").__class__("x"), io.BytesIO())
        t.addfile(info, io.BytesIO(b"hi"))
    got = {r.member: r.text for r in read_any(spark, str(tmp_path / "t.tar")).collect()}
    assert got["x/y.txt"] == "hi"


def test_text_ignores_bad_bytes_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "n.log.gz", "wb") as f:
        f.write("a\nb".encode())
    row = read_any(spark, str(tmp_path / "n.log.gz")).first()
    assert row.text == "a\nb" and row.path.endswith("n.log.gz")
    assert read_any(spark, str(tmp_path / "n.log.gz"), whole=False).count() == 2


def test_multipart_mail(spark, tmp_path):
    raw = (
        "Subject: =?utf-8?q?caf=C3=A9?=\nFrom: a@b.c\nTo: d@e.f\nMIME-Version: 1.0\n"
        'Content-Type: multipart/mixed; boundary="q"\n\n--q\nContent-Type: text/plain\n\none\n'
        "--q\nContent-Type: text/html\n\n<p>two</p>\n--q\nContent-Type: image/png\n\nzzz\n--q--\n"
    )
    (tmp_path / "m.eml").write_text(raw)
    row = read_any(spark, str(tmp_path / "m.eml")).first()
    assert row.subject == "café" and row.sender == "a@b.c" and row.recipient == "d@e.f"
    assert row.body == "one\n<p>two</p>"


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert read_any(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "b.csv").write_text('k,t\n1,"a ""q"", b"\n')
    assert tuple(read_any(spark, str(tmp_path / "b.csv")).first()) == (1, 'a "q", b')


def test_tables(spark, frame):
    with pytest.raises(ValueError, match="empty"):
        save_table(frame("a int"), "nothing")
    path = scratch_path(spark, "t")
    for values in ([(1,), (2,)], [(3,)]):
        save_table(frame("a int", *values), "replaced", path)
    assert [r[0] for r in spark.table("replaced").collect()] == [3]
    assert cleaned_name("in/orders.csv") == "orders_cleaned.csv"
    assert schema_text(spark, ["replaced"]) == "Table: replaced\n - a (int)"


def test_select_guard(spark):
    assert extract_select("```sql\nSELECT 1;\n```") == "SELECT 1"
    for bad in ("drop table x", "with a as (select 1) select * from a", ""):
        with pytest.raises(ValueError, match="SELECT"):
            extract_select(bad)
    assert run_select(spark, "with a as (select 1 as x) select * from a", True).first().x == 1
    with pytest.raises(RuntimeError, match="could not run"):
        run_select(spark, "select nope from nowhere")


def test_agent(spark, frame):
    frame("a int", (1,)).createOrReplaceTempView("numbers")
    seen = []
    agent = SqlAgent(spark, lambda p: seen.append(p) or "select a from numbers", ["numbers"])
    answer = agent.by_method("run", "Which?")
    assert answer.result.first().a == 1 and "Table: numbers" in seen[0] and "Which?" in seen[0]
    with pytest.raises(ValueError, match="unknown method"):
        agent.by_method("guess", "?")
    bad = SqlAgent(spark, lambda p: "delete from numbers", ["numbers"]).ask("?")
    assert not bad.ok and bad.explanation.startswith("Error")


def test_workflow(spark, tmp_path):
    (tmp_path / "Sales 1.csv").write_text("Id,Amount\n1,$2.50\n2,$3.00\n2,$3.00\n3,n/a\n4,$9.00\n")
    out = run_workflow(
        spark, str(tmp_path / "Sales 1.csv"), table_path=scratch_path(spark, "w"),
        csv_path=str(tmp_path / "out"),
    )
    assert out.status == "success" and out.table == "sales_1"
    assert out.cleaned.count() == 4
    last = out.report.collect()[-1]
    assert last.rows_after == 4 and out.report.first().rows_before == 5
    assert out.analysis["null_summary"].count() == len(out.cleaned.columns)
    failed = run_workflow(spark, str(tmp_path / "none.csv"))
    assert failed.status == "error" and failed.error


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        assert scratch_path(spark, "x").startswith(configured.rstrip("/"))


def test_large_single_files_are_few_files_beyond_a_bound():
    from millrace.session import UNKNOWN_BYTES, files_for

    assert [files_for(n, 100) for n in (0, 1, 100, 101, 1000, UNKNOWN_BYTES)] == [1, 1, 1, 2, 10, 1]


def test_each_task_writes_a_bounded_number_of_files(spark, monkeypatch):
    from queries import written

    monkeypatch.setattr(written, "FILES_PER_TASK", 3)
    df = spark.range(400).selectExpr("concat('n', id) as name", "cast(id as string) as text").coalesce(1)
    dealt = written._one_each(df)
    assert dealt.rdd.getNumPartitions() >= 134
    assert spark.read.text(written.text_files(df), wholetext=True).count() == 400


def test_xml_files_are_of_bounded_length(spark, monkeypatch):
    from millrace.session import scratch_path
    from queries import files

    monkeypatch.setattr(files, "XML_RECORDS", 10)
    files._write_xml(spark.range(95).selectExpr("id as a").coalesce(1), path := scratch_path(spark, "xml"))
    back = spark.read.format("xml").option("rowTag", "customer").load(path)
    assert back.selectExpr("_metadata.file_path as f").distinct().count() == 10 and back.count() == 95


def _odd_folder(folder):
    names = ("a b.txt", "é%#?[x].txt", "c;,$&+=@!~'()*.txt", "{q}|^`\"<>\\.txt", "_h.txt", ".h.txt", "_k=v.txt", "x._COPYING_", "n\n.txt")
    for name in names:
        (folder / name).write_bytes(b"\xff\x00ok" + name.encode())
    (folder / "empty.txt").write_bytes(b"")
    (folder / "h.txt.GZ").write_bytes(gzip.compress(b"one") + gzip.compress(b"two"))
    (folder / "g.gz").write_bytes(gzip.compress(b""))


def test_whole_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from millrace.sources import files

    monkeypatch.setattr(files, "NAMES", 7)
    for i in range(60):
        (tmp_path / f"n{i}.txt").write_text(f"text {i}")
    _odd_folder(tmp_path)
    back = read_any(spark, str(tmp_path), "txt")
    # the files that the driver knows are those of the listing
    assert len(back.inputFiles()) == 1 and back.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    wanted = spark.read.text(str(tmp_path), wholetext=True).select(F.input_file_name(), F.hex("value"))
    assert sorted(map(tuple, back.select("path", F.hex("text")).collect())) == sorted(map(tuple, wanted.collect()))
    (tmp_path / "k=v").mkdir()  # partitions stay with Spark
    assert files.read_whole(spark, str(tmp_path)) is None and files.read_whole(spark, f"{tmp_path}/*.txt") is None


def test_a_folder_without_files_has_no_rows(spark, tmp_path):
    (tmp_path / "_SUCCESS").write_text("")
    assert read_any(spark, str(tmp_path), "txt").columns == ["path", "text"]
    assert read_any(spark, str(tmp_path), "txt").count() == 0


def test_small_splits_become_files_without_a_shuffle(spark, tmp_path, monkeypatch):
    from queries import written

    df = spark.range(400).selectExpr("concat('n', id) as name", "cast(id as string) as text")
    df.repartition(spark.sparkContext.defaultParallelism * 4).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(written, "EACH_SPLIT", 1000)
    stored = spark.read.parquet(str(tmp_path / "t"))
    with written.splits_of(spark, 1000):
        assert written._one_each(stored) is stored
        monkeypatch.setattr(written, "MOST_FILES", 0)
        assert written._one_each(stored) is not stored
    assert read_any(spark, written.text_files(stored), "txt").count() == 400


def test_mails_are_listed_by_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"m {i}#%41.eml").write_text(f"Subject: s{i}\nFrom: a@b.c\nTo: d@e.f\n\nbody {i}\n")
    (tmp_path / "empty.eml").write_text("")
    listed = files.list_files(spark, str(tmp_path))
    assert len(listed.inputFiles()) == 1
    shown = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    assert sorted(listed.collect()) == sorted(shown.collect())
    back = read_any(spark, str(tmp_path), "eml")
    assert sorted(back.select("subject", "body").collect()) == sorted((f"s{i}", f"body {i}\n") for i in range(40))
