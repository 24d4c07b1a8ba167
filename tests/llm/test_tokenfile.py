from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wicara.llm import tokenfile


PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("size", [0, 1, 2, 127, 128, 129, 2047, 2048, 2049, 4096, 9000])
@pytest.mark.parametrize("kind", ["random", "same", "skewed", "largest"])
def test_round_trip(size, kind):
    r = np.random.Generator(np.random.PCG64(size))
    ids = {
        "random": r.integers(0, tokenfile.LARGEST_ID + 1, size),
        "same": np.full(size, 7),
        "skewed": np.minimum(r.zipf(1.3, size), tokenfile.LARGEST_ID),
        "largest": np.full(size, tokenfile.LARGEST_ID),
    }[kind].astype(np.uint16)
    lengths = np.array([size // 2, size - size // 2])
    data = tokenfile.pack_chunk([None, 5], lengths, ids)
    ((keys, sizes, back),) = tokenfile.unpack_chunks(data + b"\n")
    assert keys == [None, 5] and sizes.tolist() == lengths.tolist() and (back == ids).all()
    if kind == "same" and size > 1000:
        assert len(data) < size / 8


def test_blocks_are_independent():
    r = np.random.Generator(np.random.PCG64(1))
    ids = r.integers(0, 300, 3 * tokenfile.BLOCK).astype(np.uint16)
    words, sizes = tokenfile.encode_blocks(ids)
    ends = np.cumsum(sizes)
    for i in range(3):
        alone = ids[i * tokenfile.BLOCK : (i + 1) * tokenfile.BLOCK]
        own = words[ends[i] - sizes[i] : ends[i]]
        assert (tokenfile.encode_blocks(alone)[0] == own).all()
        assert (tokenfile.decode_blocks(own, sizes[i : i + 1], tokenfile.BLOCK) == alone).all()


def test_damage_is_noticed():
    data = bytearray(tokenfile.pack_chunk([1], np.array([500]), np.arange(500, dtype=np.uint16)))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        list(tokenfile.unpack_chunks(bytes(data) + b"\n"))
    with pytest.raises(ValueError):
        tokenfile.pack_chunk([1], np.array([1]), np.array([65535], np.uint16))


TEXTS = [(3, "Hello there"), (1, None), (2, ""), (9, "x<|endoftext|>y é 日本 " * 3), (3, "again"), (None, "no id"), (4, "word salad " * 40_000), (5, "q" * 20_000)]


@pytest.mark.parametrize("chunk", [tokenfile.CHUNK, 10])
def test_index_equals_the_library(spark, monkeypatch, chunk):
    monkeypatch.setattr(tokenfile, "CHUNK", chunk)
    df = spark.createDataFrame([(*t, "a", 2) for t in TEXTS], "doc_id long, text string, key string, start int").repartition(3)
    library = Tokenizer.from_file(PATH)
    start, want = 0, []
    for key, text in sorted(TEXTS, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenfile.token_index(df, PATH).collect()
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.token_index(df, PATH).collect() == []


def test_only_strange_texts_go_to_the_library(spark, monkeypatch):
    """Plain texts are cut into pieces and encoded together, as in packing."""
    from wicara.llm import fastwords

    asked = []

    class Library:
        def encode(self, text, **options):
            asked.append(text)
            return Tokenizer.from_file(PATH).encode(text, **options)

    known = fastwords.FastWordIds(PATH)
    known.library = Library()
    monkeypatch.setitem(tokenfile._KNOWN, PATH, known)
    import pyarrow as pa

    texts = [t for _, t in TEXTS[:4]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts)], names=["key", "body"])
    (chunk,) = tokenfile._write_chunks(PATH, 2)(iter([batch]))
    ((keys, sizes, ids),) = tokenfile.unpack_chunks(chunk.column(0)[0].as_py() + b"\n")
    library = Tokenizer.from_file(PATH)
    assert ids.tolist() == [i for t in texts for i in [*library.encode(t or "", add_special_tokens=False).ids, 2]]
    assert asked == [TEXTS[3][1]]


def test_equal_words_are_looked_up_once_a_call():
    from wicara.llm import fastwords

    class Counting(fastwords._Numbers):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    known = fastwords.FastWordIds(PATH)
    known.index = Counting()
    texts = ["the salad, the words; the salad isn't it " * 200] * 50
    library = Tokenizer.from_file(PATH)
    assert [ids.tolist() for ids in known.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert known.index.asked < 20


@pytest.mark.parametrize("seed", range(4))
def test_odd_words_equal_the_library(seed):
    import random

    from wicara.llm import fastwords

    r, known, library = random.Random(seed), fastwords.FastWordIds(PATH), Tokenizer.from_file(PATH)
    parts = ["'s", "'ST", "'", "''", "'re", "don't", "x'll've", "\"'d", ",'m", "12", "7", "a1'2", "é", "ÀÉÞ", "ß'T", "ÿ", "_-", "!?", "~", "e" * 16, "e" * 17, "f" * 8 + "g" * 8]
    gaps = ["", "", " ", "  ", "\n", "\t\r\n"]
    texts = ["".join(r.choice(parts) + r.choice(gaps) for _ in range(r.randrange(40))) for _ in range(300)]
    texts += ["", None, " ", "\n\n", "q" * 5000, "ab" * 9 + " " + "ab" * 9, " 'tis ", "×", "a÷b", "日本", "a\x0bb", "a\xa0b"]
    got = known.encode(texts) + known.encode([t for t in texts if t and t.isascii()])
    want = texts + [t for t in texts if t and t.isascii()]
    assert [ids.tolist() for ids in got] == [library.encode(t or "", add_special_tokens=False).ids for t in want]


def test_tables_of_a_block_are_small():
    """They are read at random in every step, so they should stay in the processor's caches."""
    model = tokenfile.Model(64)
    assert sum(a.nbytes for a in vars(model).values() if isinstance(a, np.ndarray)) <= 64 * 4096
