from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wicara.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "",
    None,
    "   \n\t ",
    "Don't STOP, it's 'll 1234 a1b2!!! ???",
    "ΑΣ ΣΑΣ σς İstanbul straße ÉCOLE école école",
    "x<|endoftext|>y <|STARTOFTEXT|> <|startoftext|><|endoftext|>",
    "日本語テキスト 한국어 👩‍👩‍👧 ½² \x85 a b",
    "a\x1cb\x1d c\x1f",
    "aaaaaaaaaaaaa abababababab zzzzzzzz " * 3,
    "q" * 30_000,
    "word " * 50_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    own = bpe.vocabulary(PATH)
    r = random.Random(7)
    made = ["".join(r.choice("abcdeEÉßñü0123 '.,!-\n") for _ in range(60)) for _ in range(400)]
    for text in [t for t in TEXTS if t] + made:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text[:80]
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_scalar_and_indexed_merges_agree():
    own = bpe.vocabulary(PATH)
    pieces = ["internationalisation", "aaaaaaa", "aaaa", "ññandú", "the", "x", ""]
    assert own.encode_pieces(pieces) == [own.encode_one(p.encode()) for p in pieces]


@pytest.mark.parametrize("size", [12_000_000, 40])
def test_digests(spark, library, monkeypatch, size):
    rows = [(i, t, "k", 1.5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "k", 1.5), (None, "hello", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n_tokens double")
    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    got = (
        bpe.encode_digests(df, PATH)
        if size > 1000
        else df.selectExpr("doc_id", "text").mapInArrow(lambda b: bpe.encoded(b, PATH, size), schema).withColumnRenamed("key", "doc_id")
    ).collect()

    def expected(i, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        joined, decoded = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        return str(i), len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    want = sorted(expected(r[0], r[1]) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_ids_and_empty_table(spark, library):
    df = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.token_ids(df, PATH).collect()}
    assert got == {1: library.encode("Hello there", add_special_tokens=False).ids, 2: []}
    assert bpe.encode_digests(df.where("false"), PATH).collect() == []
