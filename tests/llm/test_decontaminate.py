from __future__ import annotations

import itertools
import random

from wicara.llm import decontaminate
from wicara.llm.queries import QUERIES

r = random.Random(11)
VOCABULARY = [f"tok{i}" for i in range(3000)] + ["the", "of", "and"] * 200


def words(n):
    return [r.choice(VOCABULARY) for _ in range(n)]


def found(spark, docs, items, **settings):
    d = spark.createDataFrame(docs, "doc_id long, text string, h string, item long")
    b = spark.createDataFrame(items, "item_id long, text string, at int")
    rows = decontaminate.contaminated(d, b, **settings).collect()
    return {x["doc_id"]: x["item_ids"] for x in rows}


def test_masks_meet_every_four_substitutions():
    places = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    assert all(len(p) == 5 for p in places) and max(map(len, decontaminate.MASKS)) == decontaminate.SPAN
    for bad in itertools.combinations(range(decontaminate.WINDOW), 4):
        hit = any(
            not set(s + x for x in p) & set(bad)
            for p, m in zip(places, decontaminate.MASKS, strict=True)
            for s in range(decontaminate.WINDOW - len(m) + 1)
        )
        assert hit, bad


def test_equals_sliding_comparison(spark):
    items = [(i, words(n)) for i, n in enumerate([8, 15, 16, 30, 60, 5, 12])]
    docs = []
    for number in range(120):
        body = words(r.choice([0, 10, 80]))
        if number % 3:
            _, item = r.choice(items)
            copy = list(item)
            for _ in range(r.choice([0, 1, 2, 4, 8])):
                copy[r.randrange(len(copy))] = r.choice(VOCABULARY)
            if number % 5 == 0:
                copy = copy[: max(4, len(copy) // 2)]
            at = r.randrange(len(body) + 1)
            body = body[:at] + copy + body[at:]
        docs.append((number, body))

    def overlaps(doc, item):
        size = min(len(item), decontaminate.WINDOW)
        for start in range(-len(item), len(doc)):
            low, high = max(0, -start), min(len(item), len(doc) - start)
            same = [doc[start + i] == item[i] for i in range(low, high)]
            if any(4 * sum(same[i : i + size]) >= 3 * size for i in range(len(same) - size + 1)):
                return True
        return False

    want = {}
    for number, body in docs:
        hit = [i for i, item in items if len(item) >= decontaminate.LEAST_ITEM and overlaps(body, item)]
        if hit:
            want[number] = hit
    # a short item with many substitutions may have no seed left; windows of 16 always have one
    short = {i for i, item in items if len(item) < decontaminate.WINDOW}
    rows = [(n, ", ".join(w).upper() if n % 2 else " ".join(w), "h", 1) for n, w in docs]
    texts = [(i, " ".join(w) + ".", 0) for i, w in items]
    for settings in ({}, {"broadcast_seeds": 0}):
        got = found(spark, rows, texts, **settings)
        for number in want.keys() | got.keys():
            missing = set(want.get(number, [])) - set(got.get(number, []))
            assert not set(got.get(number, [])) - set(want.get(number, []))
            assert missing <= short


def test_nulls_ties_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, None, "", 0), (2, "", "", 0), (3, item, "", 0), (3, item, "", 0), (None, "x " + item, "", 0), (4, "z " * 200_000 + item, "", 0)]
    assert found(spark, docs, [(7, item, 0), (7, item, 0), (8, None, 0), (None, "", 0)]) == {3: [7], None: [7], 4: [7]}
    assert found(spark, docs, []) == {}
    assert found(spark, [], [(7, item, 0)]) == {}
    assert found(spark, [(1, "the of and the of and plain words here", "", 0)], [(7, item, 0)]) == {}


def short_copies():
    """Items of 1 to 15 tokens; documents with every placement of the most substitutions, and with one more."""
    items = [(n, [f"s{n}t{i}" for i in range(n)]) for n in range(1, 16)]
    docs, want = [], {}
    for n, item in items:
        most = n // 4 if n >= decontaminate.LEAST_ITEM else 0
        for count in (0, most, most + 1):
            for bad in itertools.combinations(range(n), count):
                if count > most and len(docs) % 7:
                    docs.append((len(docs), "x y"))
                    continue
                body = ["other" if i in bad else w for i, w in enumerate(item)]
                if count <= most:
                    want[len(docs)] = [n]
                docs.append((len(docs), " ".join(["x"] * (len(docs) % 3) + body + ["y"] * (len(docs) % 2))))
    return items, docs, want


def test_short_items_miss_no_placement(spark, tmp_path):
    items, docs, want = short_copies()
    rows = [(n, text, "h", 1) for n, text in docs]
    texts = [(n, " ".join(w), 0) for n, w in items]
    for settings in ({}, {"broadcast_seeds": 0}):
        assert found(spark, rows, texts, short_items=True, **settings) == want
    long = {n: w for n, w in want.items() if w[0] >= decontaminate.LEAST_ITEM}
    assert found(spark, rows, texts) == long
    spark.createDataFrame(rows, "doc_id long, text string, h string, item long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(texts, "item_id long, text string, at int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op5_spaced_seed_decontamination"](spark, str(tmp_path)).collect()
    assert {x["doc_id"]: x["item_ids"] for x in got} == want
