from __future__ import annotations

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe
from tests.llm.cases import SCHEMA, table_of, texts


@pytest.fixture(scope="module")
def library():
    tool = Tokenizer.from_file(bpe.vocabulary())
    tool.no_padding()
    tool.no_truncation()
    return tool


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary())


def samples():
    pick = random.Random(3)
    yield from ["", " ", "aaaaaaaaaaaaa", "'s 't 're", "İSTANBUL ΑΣ ΣΑΣ", "a\x1cb\x85c\xa0d", "<|endoftext|>x<|startoftext|> <|y|>", "\x00\x0b", "é é"]
    for letters in ("ab", "aeinrst", "thean", "éèaôu", "日本語テキ한국어", "0123 .,!'"):
        for _ in range(200):
            yield "".join(pick.choice(letters) for _ in range(pick.randint(1, 40)))
    yield " ".join(t[1] for t in texts() if t[1])


def test_ids_and_text_of_the_library(codec, library):
    for text in samples():
        ids = library.encode(text, add_special_tokens=False).ids
        packed = codec.encode(text)
        assert list(memoryview(packed).cast("I")) == ids, text
        assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_every_prefix_has_one_path(codec):
    auto = codec.auto
    for word in ("banana", "internationalization", "aaaaaaa", "thththth"):
        path = auto.encode_word(word)
        assert "".join(auto.labels[t].removesuffix("</w>") for t in path) == word
        states = [-1, *path[:-1]]
        assert all(auto.has_arc(s, t) for s, t in zip(states, path, strict=True))


def test_small_automaton_by_hand():
    vocab = {c: i for i, c in enumerate(["a", "b", "a</w>", "b</w>", "ab", "ab</w>", "aa", "aba</w>"])}
    auto = bpe.TokenAutomaton(vocab, [("a", "b"), ("a", "b</w>"), ("a", "a"), ("ab", "a</w>")], "</w>")
    spell = lambda w: [auto.labels[t] for t in auto.encode_word(w)]
    assert spell("abab") == ["ab", "ab</w>"]
    assert spell("aaab") == ["aa", "ab</w>"]
    assert spell("aba") == ["aba</w>"]
    assert not auto.has_arc(vocab["a"], vocab["b"])


def test_table(spark, library):
    docs = table_of(spark)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, bpe.vocabulary()).collect())
    want = []
    for r in texts():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r[0] or 0, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text.encode())))
    assert got == sorted(want)
    ids = bpe.encode(docs, bpe.vocabulary(), keep=("doc_id", "score"))
    back = {r.doc_id: r.decoded for r in bpe.decode(ids, bpe.vocabulary()).collect()}
    assert back[13] == "x</w> y</w> z</w>" and back[5] == ""


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], SCHEMA), bpe.vocabulary()).count() == 0
