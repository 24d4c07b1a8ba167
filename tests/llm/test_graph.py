from __future__ import annotations

import random

import numpy as np

from wicara.llm.common import Scratch
from wicara.llm.graph import components, spanning


def least(nodes, edges):
    root = {n: n for n in nodes}
    for _ in nodes:
        for u, v in edges:
            low = min(root[u], root[v])
            root[u] = root[v] = low
    return root


def test_components(spark):
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    r.shuffle(chain)
    star = [(100, 100 + i) for i in range(1, 30)]
    loose = [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(30)]
    edges = chain + star + loose + [(7, 7), (300, 301), (301, 300)]
    want = least({n for e in edges for n in e}, edges)
    got = components(Scratch(spark, "test"), spark.createDataFrame(edges, "u long, v long")).collect()
    found = {r["node"]: r["component"] for r in got}
    assert len(found) == len(got)
    assert all(found.get(n, n) == c for n, c in want.items())


def test_components_of_nothing(spark):
    assert components(Scratch(spark, "test"), spark.createDataFrame([], "u long, v long")).collect() == []


def test_spanning_names_the_smallest():
    near = np.zeros((5, 5), bool)
    for a, b in ((0, 1), (1, 2), (3, 4)):
        near[a, b] = near[b, a] = True
    assert spanning(np.array([9, 4, 7, 2, 3]), near) == [(9, 4), (7, 4), (3, 2)]
