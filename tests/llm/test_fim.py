from __future__ import annotations

import hashlib
import random
import re

import pytest
import zstandard

from millrace.llm import fim
from tests.llm.cases import SCHEMA, row, table_of, texts

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
plain = zstandard.ZstdDecompressor().decompress
press = zstandard.ZstdCompressor().compress


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    """(doc_id, n, form, prefix_chars, middle_chars, output, text)."""
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", text
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", text


def cases():
    pick = random.Random(13)
    made = ["".join(pick.choice(" \n\tabé日<>PSM\xa0\x1c\x85") for _ in range(pick.randint(0, 60))) for _ in range(150)]
    made += ["x" * 300, " " * 300, "a " * 200, "  lead and trail  ", "has <P> in it", "ends in <", "ends in <S"]
    return texts() + [row(100 + i, t) for i, t in enumerate(made)]


@pytest.mark.parametrize("size", [1, 7, 64, fim.FRAME_BYTES])
def test_like_plain_strings(spark, size):
    docs = table_of(spark, cases())
    made = fim.transform(fim.planned(fim.frames(docs, size=size)))
    got = {}
    for r in made.collect():
        got.setdefault(r.doc_id, []).append((r.units, r.form, r.prefix_chars, r.middle_chars, b"".join(map(plain, r.frames)).decode()))
    want = {}
    for r in cases():
        want.setdefault(r[0], []).append(brute(*r[:2])[1:6])
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    out = sorted(((r.output_sha256, r.restored_sha256) for r in fim.digests(made).collect()))
    assert out == sorted((sha(b[5]), sha(b[6])) for b in (brute(*r[:2]) for r in cases()))


def test_all_forms_are_there():
    assert {brute(*r[:2])[2] for r in cases()} == {"plain", "spm", "psm"}


def test_frames_are_cut_between_units():
    text = "ab cd  ef\n\ngh   "
    parts = [*fim.pieces(text.encode(), 4)]
    assert b"".join(p for _, p in parts).decode() == text
    assert [u for part in parts for u in UNIT.findall(part[1].decode())] == UNIT.findall(text)
    assert [n for n, _ in parts] == [len(UNIT.findall(p.decode())) for _, p in parts]


def test_only_frames_with_a_cut_are_opened():
    data = [press(f"w{i} ".encode() * 10) for i in range(50)]
    before, opened = [*range(0, 500, 10)], []

    def seen(frame):
        opened.append(data.index(frame))
        return plain(frame)

    at, end = fim.find(123, before, data, seen)
    assert (at, plain(data[at])[:end].decode()) == (12, "w12" + " w12" * 2)
    moved = [*fim.stretch((12, 3), (40, 0), data, seen, press)]
    assert opened == [12, 12] and moved[1:] == data[13:40]


def test_output_is_one_stream():
    frames = [press(p) for p in (b"<P>", b"a ", b"<S>", b"c", b"<M>", b"b ")]
    whole = zstandard.ZstdDecompressor().stream_reader(b"".join(frames), read_across_frames=True).read()
    assert whole == b"<P>a <S>c<M>b "
    assert b"".join(fim.restore("psm", frames, plain)) == b"a b c"
    # marks may lie across frames, and what stands before one may look like its start
    odd = [press(p) for p in (b"<", b"P>x <", b"<S", b">y<S<M", b">z")]
    assert b"".join(fim.restore("psm", odd, plain)) == b"x <zy<S"


def test_very_long_text(spark):
    text = "".join(f"word{i}{' ' if i % 7 else chr(10)}" for i in range(400_000))
    for key in (1, 2, 3, 5):
        docs = spark.createDataFrame([(key, text)], "doc_id long, text string")
        made = fim.transform(fim.planned(fim.frames(docs)))
        r = fim.digests(made).first()
        want = brute(key, text)
        assert (r.units, r.form, r.prefix_chars, r.middle_chars) == want[1:5]
        assert (r.output_sha256, r.restored_sha256) == (sha(want[5]), sha(text))


def test_empty_table(spark):
    made = fim.transform(fim.planned(fim.frames(spark.createDataFrame([], SCHEMA))))
    assert fim.digests(made).count() == 0
