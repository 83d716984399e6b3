from __future__ import annotations

import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bpe, ppm
from tests.llm import test_decontaminate, test_hyperminhash, test_line_dedup
from tests.llm.cases import row, table_of, texts


def lines_of(rows):
    """The kept text per row, as the line test has it."""
    holders: dict[str, set] = {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            key = test_line_dedup.lower(x.strip(" \t\n\x0b\x0c\r"))
            if r[0] is not None and len(key) >= 10:
                holders.setdefault(key, set()).add(r[0])
    out = []
    for r in rows:
        left = [
            x for x in (r[1] or "").split("\n")
            if r[0] is None or len(own := holders.get(test_line_dedup.lower(x.strip(" \t\n\x0b\x0c\r")), ())) < 2 or min(own) == r[0]
        ]
        out.append((r[0], "\n".join(left)))
    return out


def test_whole_run_against_brute_force(spark, tmp_path):
    items = test_decontaminate.ITEMS
    rows = texts() + test_hyperminhash.copies(20) + [row(500, "Ein Haus am See mit einem Garten und einem Hund", "de")]
    table_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, test_decontaminate.ITEM_SCHEMA).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in rows if ppm.has_letter(r[1])]
    kept = lines_of(kept)
    gone = {x[0] for x in test_hyperminhash.plain(kept, 5) if not x[3] and x[0]}
    kept = [r for r in kept if r[0] not in gone]
    kept = [r for r in kept if not test_decontaminate.plain([r], items)[0][5]]
    tool = Tokenizer.from_file(bpe.vocabulary())
    want = sorted((r[0] or 0, hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in tool.encode(r[1] or "", add_special_tokens=False).ids)).hexdigest()) for r in kept)
    assert sorted((r.doc_id or 0, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_take_empty_tables(spark, stage):
    docs, folder = table_of(spark), "/root/testdata/sf0.001"
    out = stage(spark, docs, folder)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert stage(spark, docs.where("doc_id = -1"), folder).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
