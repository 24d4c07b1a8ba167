from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wicara.llm import automata, collocation

SIGNS = re.compile("[.,;:!?\n-\r]")


def brute_force(rows, least, top, share=100):
    counts, out = {}, []
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in SIGNS.split(low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for m in range(1, 6):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            longer = [q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * found[q] >= share * a for q in longer):
                continue
            score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, l, r, n, score))
        for rank, (_, _, phrase, a, l, r, n, score) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, n, score))
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame([(t, l, 1, "x") for t, l in rows], "text string, lang string, n int, word string")
    return df.repartition(4)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("share", [100, 60])
def test_equals_brute_force(spark, seed, share):
    r = random.Random(seed)
    small = collocation.Bounds(shard=50, words=7, pairs=20, part=11, together=2)
    bounds = small if seed % 2 else collocation.Bounds()
    words = ["a", "The", "the", "été", "ß", "日本", "x y", "b\x1c", "z", "É"]
    signs = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]
    rows = []
    for _ in range(120):
        text = "".join(r.choice(words) + r.choice(signs) for _ in range(r.randrange(12)))
        rows.append((r.choice([text, text, text, None, "", "the z a b\x1c été"]), r.choice(["en", "de", None, "und"])))
    want = brute_force(rows, 3, 40, share)
    assert want
    assert result(collocation.collocations(table(spark, rows), least=3, top=40, share=share, bounds=bounds)) == want


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """Where every word and pair passes, the counts still decide."""
    real = collocation.bit_filter
    monkeypatch.setattr(collocation, "bit_filter", lambda *a: b"\xff" * len(real(*a)))
    rows = [("a b c d e f a b c", "en"), ("a b. c d", "en"), ("x a b", "en")]
    bounds = collocation.Bounds(filter_bits=1 << 16)
    assert result(collocation.collocations(table(spark, rows), least=2, top=9, bounds=bounds)) == brute_force(rows, 2, 9)


def test_hot_words_and_long_texts(spark):
    """One word and one pair hold most of the words; a text of a million words has no cut n-gram."""
    text = "of the " * 400_000 + "end " + "of the house. " * 50_000
    rows = [(text, "en"), ("of the end", "en"), ("q" * 100_000, "en")]
    assert result(collocation.collocations(table(spark, rows), least=100)) == brute_force(rows, 100, 2000)


def test_large_products_are_exact(spark):
    df = spark.createDataFrame([("en", "a b", 9 * 10**9, 1, 9 * 10**9 + 1, 9 * 10**9 + 3)], "lang string, phrase string, a long, cut int, l long, r long")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")}
    got = df.withColumns(wide).selectExpr("cast(1000 as decimal(10,0)) * a * cast(8000000000001 as decimal(15,0)) div (l * r) as s").first()[0]
    assert got == 1000 * 9 * 10**9 * 8000000000001 // ((9 * 10**9 + 1) * (9 * 10**9 + 3))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocation.collocations(df).collect() == []
    assert collocation.collocations(table(spark, [(None, None), ("", "en")])).collect() == []


def test_automata():
    r = random.Random(5)
    grams = Counter(tuple(r.choice("abcd").encode() for _ in range(r.randrange(1, 5))) for _ in range(400))
    first = automata.build(sorted(grams.items()), 1)
    want = Counter()
    for g, n in grams.items():
        for k in range(1, len(g) + 1):
            want[g[:k]] += n
    again = automata.Automaton.from_bytes(first.to_bytes())
    assert list(again.paths()) == sorted(want.items())
    assert list(again.compose([(b"a",), (b"a", b"b"), (b"z",), (b"a", b"z"), (b"b",)])) == [want[(b"a",)], want[(b"a", b"b")], 0, 0, want[(b"b",)]]
    both = automata.unite([first, again])
    assert list(both.paths()) == sorted((g, 2 * n) for g, n in want.items())
    some = automata.unite([first, again], 60)
    assert list(some.paths()) == sorted((g, 2 * n) for g, n in want.items() if len(g) == 1 or 2 * n >= 60)
    shared = automata.build([((b"a", b"x", b"y"), 1), ((b"b", b"x", b"y"), 1)])
    assert len(shared.states) == 4  # the end, one state before y, one before x, the start
