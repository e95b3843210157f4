import public_tokenizers
import pytest
from shelfline.llm import token_counts as t
from tokenizers import Tokenizer

TEXTS = [
    None, "", "   ", "Hello, World! it's they'LL", "á ́x", "<|startoftext|> a <|endoftext|>b <|end of text|>", "ΣΑΣ ΣΑΣ. ǅ İstanbul",
    "tab\tand nbsp em\x1fus\x85nel", "x" * 30_000, "日本語 テキスト 123456", "word " * 20_000, "é" * 100, "\x00 \x0b\x0c|", "a\r\nb",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(t.VOCABULARY))


def test_equals_the_library(spark, tokenizer):
    rows = [(i, x, "c", 1) for i, x in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, extra int")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in t.token_counts(docs).collect())
    n = [len(tokenizer.encode(x or "", add_special_tokens=False).ids) for x in TEXTS]
    assert got == sorted((i, len((x or "").encode()), n[i], n[i] > 2048) for i, x in enumerate(TEXTS) for _ in range(2))


@pytest.mark.parametrize("text", ["a1" * 60_000, "ab,c7'S9x-" * 20_000, "é1́2b" * 30_000, "x" * 70_000 + "12" + "y" * 70_000, "1" * 100_000])
def test_long_chunks_are_cut_beside_digits(tokenizer, text):
    pieces = t.chunks_of(text.encode())
    assert b"".join(pieces) == text.encode() and len(pieces) > 1
    assert sum(len(tokenizer.encode(p.decode(), add_special_tokens=False).ids) for p in pieces) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_memo_is_bounded_and_long_chunks_are_not_kept(monkeypatch):
    monkeypatch.setattr(t, "MEMO", 2)
    monkeypatch.setattr(t, "TEXT_BYTES", 4)
    memo = {}
    got = list(t.lengths(iter([b"a b c d", b"a e" + b"f" * 100, b"g h"]), lambda chunks: [len(c) for c in chunks], memo))
    assert got == [4, 102, 2]
    assert all(len(k) <= t.MEMO_CHUNK for k in memo)


def test_empty_table(spark):
    assert t.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
