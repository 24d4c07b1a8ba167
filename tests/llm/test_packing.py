from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wicara.llm import fastwords, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


@pytest.mark.parametrize("letters", ["abcdeistnr'  .,!?\t\n\r0123ÀÉÖØÞßàéöøþÿ<|>~{}\"AZ", "aZ\x00\x1c\x85\xa0ªµº×÷İıΣσς日本é́ '."])
def test_word_ids_equal_the_library(letters, monkeypatch):
    monkeypatch.setattr(fastwords.FastWordIds, "LIMIT", 500)
    monkeypatch.setattr(fastwords.FastWordIds, "CHARS", 2_000)
    ids, want, r = fastwords.FastWordIds(PATH), library(), random.Random(7)
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(1500)] + [None, "", "a<|endoftext|>b"]
    got = ids.encode(texts)
    assert [g.tolist() for g in got] == [want.encode(t or "", add_special_tokens=False).ids for t in texts]


def by_hand(lengths, capacity):
    """The rule in plain loops: largest first, lowest-cost sequence that can take all of it."""
    left = {i: n % capacity for i, n in enumerate(lengths)}
    total = sum(left.values())
    room = [capacity] * (total // capacity) + [1 << b for b in reversed(range(20)) if total % capacity >> b & 1]
    spent, pieces = [0.0] * len(room), []
    for i in sorted(left, key=lambda i: (-packing.cost(left[i]), i)):
        at = lengths[i] - left[i]
        while left[i]:
            open_ = [s for s in range(len(room)) if room[s] >= left[i]] or [s for s in range(len(room)) if room[s]]
            s = min(open_, key=lambda s: (spent[s], s))
            n = min(left[i], room[s])
            pieces.append((i, at, n, s))
            room[s] -= n
            spent[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
            left[i] -= n
            at += n
    return pieces


@pytest.mark.parametrize("seed", range(6))
def test_assignment(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 2, 15, 16, 17, 64, r.randrange(1, 60)]) for _ in range(r.randrange(80))]
    rows = packing.assign(np.array(lengths, np.int64), 16)
    full = sum(n // 16 for n in lengths)
    assert [(d, s, n, q - full) for d, s, n, q, _ in rows[full:].tolist()] == by_hand(lengths, 16)
    covered = sorted((d, s + k) for d, s, n, _, _ in rows.tolist() for k in range(n))
    assert covered == [(d, k) for d, n in enumerate(lengths) for k in range(n)]
    sizes = {}
    for _, _, n, q, o in sorted(rows.tolist(), key=lambda x: (x[3], x[4])):
        assert o == sizes.get(q, 0)
        sizes[q] = o + n
    assert all(n == 16 or n & (n - 1) == 0 for n in sizes.values())


def spread(sequence, length):
    spent, sizes = np.zeros(sequence.max() + 1), np.zeros(sequence.max() + 1)
    np.add.at(spent, sequence, packing.cost(length))
    np.add.at(sizes, sequence, length)
    return spent[sizes == packing.CAPACITY].std()


def test_costs_are_balanced():
    """Documents below a third of a sequence: full sequences cost nearly the same, unlike in reading order."""
    r = np.random.Generator(np.random.PCG64(3))
    lengths = np.clip(r.lognormal(5, 1, 4000).astype(np.int64), 1, 600)
    rows = packing.assign(lengths)
    cuts = np.unique(np.concatenate([[0], np.cumsum(lengths), np.arange(0, lengths.sum(), packing.CAPACITY)]))
    in_turn = spread(cuts[:-1] // packing.CAPACITY, np.diff(cuts))
    assert spread(rows[:, 3], rows[:, 2]) < 0.25 * in_turn


TEXTS = [(3, "Hello there"), (1, None), (2, ""), (9, "x<|endoftext|>y é 日本 " * 3), (3, "Hello there"), (None, "no id"), (4, "word salad " * 30_000), (5, "q" * 20_000)]


@pytest.mark.parametrize("group", [packing.GROUP, 5000])
def test_pieces_hold_every_id_once(spark, group):
    df = spark.createDataFrame([(t[0], t[1], "a", 2, 3) for t in TEXTS], "doc_id long, text string, key string, start int, pieces int")
    packed = packing.pack_documents(df.repartition(3), PATH, group=group)
    rows = packing.packed_pieces(packed).collect()
    want, lib = {}, library()
    for key, text in TEXTS:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        want.setdefault((key, len(ids)), []).append(ids)
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert got.keys() == want.keys()
    for name, some in got.items():
        ids, copies = want[name][0], len(want[name])
        assert sorted(i for r in some for i in range(r["start"], r["start"] + r["length"])) == sorted([*range(len(ids))] * copies)
        for r in some:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    sizes = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sizes.get(r["sequence_id"], 0)
        sizes[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= packing.CAPACITY and (n == packing.CAPACITY or n & (n - 1) == 0) for n in sizes.values())
    assert sum(sizes.values()) == sum(n * len(v) for (_, n), v in want.items())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_index(df, PATH).collect() == []
