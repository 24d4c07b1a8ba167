"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicara.llm.common import Scratch


def grouped(batches, keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of Arrow rows with equal first ``keys`` columns, the key columns left out."""
    held, rows = None, []
    for batch in batches:
        listed = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for key, group in itertools.groupby(listed, lambda r: r[:keys]):
            if key != held and rows:
                yield held, rows
                rows = []
            held = key
            rows += [r[keys:] for r in group]
    if rows:
        yield held, rows


def spanning(names: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Each member with the smallest name it reaches; ``near`` is a symmetric matrix of links."""
    at = np.flatnonzero(near.any(axis=1))
    if not len(at):
        return []
    near, names = near[np.ix_(at, at)], names[at]
    roots = names.copy()
    while True:
        lower = np.minimum(roots, np.where(near, roots, np.iinfo(np.int64).max).min(axis=1))
        if (lower == roots).all():
            break
        roots = lower
    return [(u, v) for u, v in zip(names.tolist(), roots.tolist(), strict=True) if u != v]


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(scratch: Scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Every step groups by node with partial aggregation and joins back, so a hub is never collected;
    each round is written to the shared folder. Rounds grow with the logarithm of the diameter.
    Loops and nulls link nothing.
    """
    current = scratch.write(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        f"{name}_0",
    )
    state, turn = _state(current), 0
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        turn += 1
        after = scratch.write(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(root.select("u", F.col("m").alias("v")))
            .distinct(),
            f"{name}_{turn}",
        )
        scratch.drop(f"{name}_{turn - 1}")
        before, state, current = state, _state(after), after
        if state == before:
            break
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
