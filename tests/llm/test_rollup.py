from __future__ import annotations

import random

import pytest

from wicara.llm.common import Scratch
from wicara.llm.rollup import DELETE, INSERT, REVISE, TokenRollup

SCHEMA = "doc_id long, tokenizer string, source string, lang string, n_tokens long, op string, number long, docs string"


@pytest.fixture()
def totals(spark):
    return TokenRollup(spark, Scratch(spark, "test").path("totals"))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def listed(totals):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in totals.totals().collect()}


def test_random_batches_equal_recomputation(spark, totals):
    r = random.Random(9)
    state = {}
    for batch in range(4):
        rows, seen = [], {}
        for number in range(30):
            key = (r.randrange(20), r.choice(["v1", "v2"]))
            row = (*key, r.choice(["s", "t", None]), r.choice(["en", None]), r.randrange(50), r.choice([INSERT, DELETE, REVISE]), number)
            rows.append(row)
            seen[key] = row
        assert totals.commit(f"b{batch}", frame(spark, rows))
        for key, row in seen.items():
            state.pop(key, None)
            if row[5] != DELETE:
                state[key] = row
        want = {}
        for (_, tokenizer), row in state.items():
            docs, tokens = want.get((row[2], row[3], tokenizer), (0, 0))
            want[row[2], row[3], tokenizer] = docs + 1, tokens + row[4]
        assert listed(totals) == want
        assert not totals.commit(f"b{batch}", frame(spark, rows))
        assert listed(totals) == want
    assert totals.state().count() == len(state)


def test_failed_attempt_is_overwritten(spark, totals):
    totals.commit("one", frame(spark, [(1, "v", "s", "en", 5, INSERT, 0)]))
    half = totals.spark.createDataFrame([("s", "en", "v", 100, 100)], "source string, lang string, tokenizer string, docs long, tokens long")
    half.write.parquet(f"{totals.path}/deltas/number=2")  # written, but never committed
    assert listed(totals) == {("s", "en", "v"): (1, 5)}
    totals.commit("two", frame(spark, [(2, "v", "s", "en", 7, INSERT, 0)]))
    assert listed(totals) == {("s", "en", "v"): (2, 12)}


def test_nulls_ties_and_empty_batches(spark, totals):
    rows = [(None, "v", "s", "en", 5, INSERT, 0), (1, None, "s", "en", 5, INSERT, 0), (2, "v", None, None, None, INSERT, 0)]
    rows += [(3, "v", "s", "en", 4, INSERT, 0)] * 3 + [(4, "v", "s", "en", 4, INSERT, 0), (4, "v", "s", "en", 4, DELETE, 0), (5, "v", "s", "en", 1, DELETE, 0)]
    assert totals.commit("a", frame(spark, rows))
    assert totals.commit("empty", frame(spark, []))
    assert listed(totals) == {(None, None, "v"): (1, 0), ("s", "en", "v"): (1, 4)}
    assert TokenRollup(spark, f"{totals.path}-none").totals().collect() == []
