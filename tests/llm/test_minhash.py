from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wicara.llm import hashing, minhash

SCHEMA = "doc_id long, text string"


def words_of(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    w = words_of(text)
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, o in sets[:a]:
            if s and o and 100 * len(s & o) >= 75 * len(s | o):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "é", "a b", "Ünï"]
    rows, number = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 40, 200]))]
        for _ in range(r.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 3, 12])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            text = r.choice([" ", "\n", "\t "]).join(copy)
            rows.append((number, text.upper() if r.random() < 0.2 else text))
            number += 1
    return rows


def collected(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("block", [512, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus() + [(1000, ""), (1001, None), (1002, " \n\t"), (1003, "one two"), (1004, "ONE TWO"), (1005, "one two three")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{SCHEMA}, key int, component int")
    assert collected(minhash.near_duplicates(df)) == brute(rows)


def test_sketches_fill_every_coordinate_and_estimate_similarity():
    r = np.random.Generator(np.random.PCG64(3))
    base = r.integers(0, 1 << 63, 400, np.uint64)
    other = np.concatenate([base[:300], r.integers(0, 1 << 63, 100, np.uint64)])
    sets = [np.unique(base), np.unique(other), base[:1], np.zeros(0, np.uint64)]
    grid = minhash.sketches(sets)
    assert (grid[:3] != np.iinfo(np.uint64).max).all()
    assert (grid[3] == np.iinfo(np.uint64).max).all()
    assert abs((grid[0] == grid[1]).mean() - 0.6) < 0.15


def test_sketch_does_not_depend_on_the_batch():
    r = np.random.Generator(np.random.PCG64(4))
    sets = [np.unique(r.integers(0, 1 << 63, n, np.uint64)) for n in (1, 7, 90, 700, 2)]
    together = minhash.sketches(sets)
    for i, s in enumerate(sets):
        assert (minhash.sketches([s])[0] == together[i]).all()


def test_shingles_do_not_cross_rows():
    column = pa.array(["a b c d e f", None, "", "g", "h i j k l", "  a  B c\td e F "])
    sets = [s for _, data, bounds in hashing.text_slices(column) for s in hashing.shingle_sets(data, bounds)]
    assert [len(s) for s in sets] == [2, 0, 0, 1, 1, 2]
    assert (sets[0] == sets[5]).all()


def test_very_long_text_and_long_word(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, "y" * 300_000)]
    found = collected(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert found == [(1, 59_996, 1, True), (2, 59_997, 1, False), (3, 1, 3, True)]


def test_repeated_ids_null_ids_and_empty_table(spark):
    text, other = "a b c d e f g h", "p q r s t u v w"
    rows = [(5, text), (5, text), (5, other), (7, other), (None, text), (2, text)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None) == [
        (2, 2, True), (5, 2, False), (5, 2, False), (5, 2, False), (7, 2, False),
    ]
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
