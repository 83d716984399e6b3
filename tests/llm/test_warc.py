from __future__ import annotations

import hashlib
import posixpath
import zlib

import pytest

from millrace.llm import warc

PAGES = "page_id long, url string, html string, payload string, offset long"
BIG = "<p>" + "same payload " * 20 + "</p>"


def pages(spark):
    rows = [
        (3, "http://a/3", BIG), (1, "http://a/1", BIG), (2, "http://b/2", BIG), (1, "http://a/1", BIG), (4, None, "tiny"), (5, "http://c/\r\nx y", "tiny"),
        (6, "http://é/6", None), (7, "u", ""), (8, "u", "ünïcode " * 40), (9, "u", "x" * 300_000), (None, "n", BIG),
    ]
    return spark.createDataFrame([(*r, "p", 1) for r in rows], PAGES), rows


def test_write_and_read_back(spark):
    df, rows = pages(spark)
    folder, index = warc.write_archives(df)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in warc.read_records(index, folder).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == BIG and page != 1
        want.append((page or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None, None if again else html or ""))
    assert got == sorted(want, key=str)
    assert {r.url for r in index.collect()} == {r[1] for r in rows}


def test_archives_are_warc(spark):
    df, rows = pages(spark)
    folder, index = warc.write_archives(df)
    fs, root = warc.store_of(f"{folder}/archives")
    seen = 0
    for file in {r.file for r in index.collect()}:
        data = fs.open_input_file(posixpath.join(root, file)).read()
        while data:  # a sequence of gzip members, one record each
            press = zlib.decompressobj(warc.GZIP)
            raw = press.decompress(data)
            data, seen = press.unused_data, seen + 1
            assert raw.startswith(b"WARC/1.1\r\nWARC-Type: re") and raw.endswith(b"\r\n\r\n")
            fields, _, _ = warc.parse(raw)
            assert "\n" not in fields.get("WARC-Target-URI", "")
    assert seen == len(rows)


def test_selected_records_only(spark):
    df, _ = pages(spark)
    folder, index = warc.write_archives(df)
    got = {r.page_id: r.payload for r in warc.read_records(index.where("page_id in (8, 9)"), folder).collect()}
    assert got == {8: "ünïcode " * 40, 9: "x" * 300_000}


def test_ranges_are_coalesced():
    near = [(0, 100), (100, 50), (200, 10), (10_000_000, 5), (10_000_005, 5)]
    assert [(a, b, m) for a, b, m in warc.ranges(near)] == [(0, 210, [0, 1, 2]), (10_000_000, 10_000_010, [3, 4])]
    assert len([*warc.ranges([(i * 1_000_000, 1_000_000) for i in range(40)])]) == 5
    assert [*warc.ranges([])] == []


def test_a_wrong_index_is_noticed(spark):
    df, _ = pages(spark)
    folder, index = warc.write_archives(df.where("page_id = 8"))
    wrong = index.selectExpr("page_id", "url", "'00' as payload_digest", "payload_bytes", "record_type", "refers_to", "file", "offset", "length")
    with pytest.raises(Exception, match="not the one indexed"):
        warc.read_records(wrong, folder).collect()


def test_empty_table(spark):
    folder, index = warc.write_archives(spark.createDataFrame([], PAGES))
    assert warc.read_records(index, folder).count() == 0
