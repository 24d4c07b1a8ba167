from __future__ import annotations

import numpy as np
import pytest

from wicara.llm import embed
from wicara.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    links, root = {}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a, la in rows:
        links[i] = 0
        for j, b, lb in rows:
            if i == j or la is None or la != lb or not usable(a) or not usable(b) or len(a) != len(b):
                continue
            x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= embed.COSINE:
                links[i] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, links[i], find(i), find(i) == i) for i, _, _ in rows)


def usable(v):
    return bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v)


def collected(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


def vectors(seed, groups=6, dim=16):
    r = np.random.Generator(np.random.PCG64(seed))
    rows = []
    for g in range(groups):
        center = r.standard_normal(dim)
        for _ in range([1, 2, 5, 40][g % 4]):
            noise = r.standard_normal(dim) * r.choice([0.02, 0.1, 0.4])
            rows.append((len(rows), (center + noise).astype(np.float32).tolist(), int(r.integers(0, 2))))
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed, "BLOCK", block)
    rows = vectors(2)
    rows += [(500, rows[3][1], rows[3][2]), (501, [2 * x for x in rows[3][1]], rows[3][2]), (502, rows[3][1], 9)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [None] + [1.0] * 15, 1), (603, [float("nan")] * 16, 1), (604, [1.0, 2.0], 1), (605, [1.0, 2.0], 1), (606, rows[0][1], None), (607, [], 1)]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], f"{SCHEMA}, key double, vec string")
    found, recall = embed.near_duplicates(df)
    assert collected(found) == brute(rows)
    assert recall == 1.0


def test_repeated_and_null_ids_and_empty_table(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(4, a, 0), (4, a, 0), (4, b, 0), (9, a, 0), (None, a, 0)]
    found = embed.near_duplicates(spark.createDataFrame(rows, SCHEMA))[0].collect()
    assert sorted({(r["vec_id"], r["n_links"]) for r in found if r["vec_id"] is not None}) in ([(4, 0), (9, 0)], [(4, 1), (9, 1)])
    assert len([r for r in found if r["vec_id"] == 4]) == 3
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in found if r["vec_id"] is None] == [(0, None, True)]
    assert embed.near_duplicates(spark.createDataFrame([], SCHEMA))[0].collect() == []


def pairs_beside_a_hot_group(seed, hot=600, pairs=400, dim=32):
    r = np.random.Generator(np.random.PCG64(seed))
    center, rows = r.standard_normal(dim), []
    near = lambda v: (v + 0.05 * r.standard_normal(dim)).astype(np.float32).tolist()
    for _ in range(hot):
        rows.append((len(rows), near(center), 0))
    for _ in range(pairs):
        one = r.standard_normal(dim)
        rows += [(len(rows) + i, near(one), 0) for i in range(2)]
    return rows


def test_isolated_pairs_count_beside_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(embed, "SIGNATURES", 1)
    rows = pairs_beside_a_hot_group(3)
    found, recall = embed.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    assert all(got[i] == (599, 0) for i in range(600))
    missed = [i for i in range(600, len(rows)) if got[i] != (1, i - i % 2)]
    assert recall >= embed.RECALL and len(missed) <= 0.02 * 800


@pytest.mark.parametrize("met, reached", [(0, 0.0), (3, 0.75)])
def test_audited_links_stay_out_and_recall_is_reported(spark, monkeypatch, tmp_path, met, reached):
    rows = pairs_beside_a_hot_group(5, hot=40, pairs=4)
    edges = [(i, 0) for i in range(1, 40) if met] + [(41 + 2 * i, 40 + 2 * i) for i in range(met)]
    links = spark.createDataFrame(edges, "u long, v long")
    monkeypatch.setattr(embed, "descend", lambda scratch, classes, restart, before=None: (None, links))
    monkeypatch.setattr(embed, "RESTARTS", 1)
    df = spark.createDataFrame(rows, SCHEMA)
    found, recall = embed.near_duplicates(df)
    assert recall == reached
    assert {r["vec_id"] for r in found.collect() if r["n_links"]} == {x for e in edges for x in e}
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(RuntimeError, match="recall"):
        QUERIES["op1_nn_descent_near_dedup"](spark, str(tmp_path))
