from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from wicara.functions import rules
from wicara.operators import lexicon, promo
from wicara.operators.trie import WordTrie
from wicara.plans.scoring import promo_table
from wicara.sources.files import read_lexicon, read_number_reference


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, text string")


def expressions(spark):
    return lexicon.Lexicon.of(lexicon.default_lexicon(spark))


def ruled(spark, values):
    rows = lexicon.lexicon_rule(texts(spark, values), "text", expressions(spark), "id").orderBy("id").collect()
    return [r["rule"] for r in rows]


def test_lexicon_has_all_expressions(spark):
    table = expressions(spark).expressions
    assert len(table) == 167
    assert dict(table)["anjing"] == ["Indonesia", "Sunda"]
    assert table[0][0] == "anjing"


def test_words_and_phrases(spark):
    word, phrase, bound, empty = ruled(spark, ["Kamu ANJING!", "Kamu sok tahu.", "anjingnya lucu", None])
    assert word["label"] == "toxic"
    assert "anjing" in [m["expression"] for m in word["matches"]]
    assert "sok tahu" in [m["expression"] for m in phrase["matches"]]
    assert bound["label"] == "non_toxic"
    assert (empty["toxic"], empty["label"], empty["matches"]) == (False, "non_toxic", [])


def test_matches_in_lexicon_order_without_repeats(spark):
    (rule,) = ruled(spark, ["dasar bodoh, tidak punya harga diri, bodoh! anjing bodoh"])
    assert [m["expression"] for m in rule["matches"]] == [
        "anjing", "bodoh", "dasar bodoh", "tidak punya harga diri",
    ]


@pytest.mark.parametrize("extra,trie_limit", [(0, 0), (2_001, 0), (50_000, 0), (2_001, 10_000), (50_000, 100_000)])
def test_joined_and_trie_matches_equal_inline_matches(spark, extra, trie_limit):
    values = ["tai anjing tai kucing", "dasar sampah masyarakat", None, "", "netral", "gila " * 50]
    df = texts(spark, values)
    inline = lexicon.lexicon_matches(df, "text", expressions(spark), "id").orderBy("id").collect()
    more = spark.range(extra).selectExpr("1000 + id as position", "concat('kata lain ', id) as expression", "'x' as region")
    large = lexicon.Lexicon.of(lexicon.default_lexicon(spark).unionByName(more), 100, trie_limit)
    assert not large.small and large.in_row == bool(trie_limit)
    if not trie_limit:
        with pytest.raises(ValueError):
            large.expressions
    joined = lexicon.lexicon_matches(df, "text", large, "id").orderBy("id").collect()
    assert [r["matches"] for r in inline] == [r["matches"] for r in joined]
    assert lexicon.lexicon_rule(df, "text", large, "id").filter("rule.toxic").count() == 3


@pytest.mark.parametrize("seed", range(20))
def test_trie_equals_containment(seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    entries = sorted({text(r.randrange(1, 5)) for _ in range(r.randrange(1, 40))}, key=lambda _: r.random())
    trie = WordTrie(entries)
    for _ in range(40):
        body = text(r.randrange(12)) + r.choice(["", " d", " d a b"])
        assert trie.matches(body) == [i for i, e in enumerate(entries) if f" {e} " in f" {body} "]


def test_rule_report(spark):
    df = lexicon.lexicon_matches(texts(spark, ["goblok anjing", "baik"]), "text", expressions(spark), "id")
    first, second = lexicon.rule_report(df).orderBy("id").collect()
    assert first["rule_toxicity"] == "toxic"
    assert first["matched_expressions"] == "anjing, goblok"
    assert first["matched_regions"] == "Indonesia, Sunda"
    assert (second["rule_toxicity"], second["matched_expressions"]) == ("non_toxic", "")


def test_lexicon_file(spark, tmp_path):
    path = tmp_path / "lexicon.json"
    path.write_text(json.dumps({"entries": [{"expression": "A-b", "region": ""}, {"expression": "?!"}]}))
    grouped = lexicon.group_lexicon(read_lexicon(spark, str(path))).collect()
    assert [(r["expression"], r["regions"]) for r in grouped] == [("a b", [])]


def promos(spark, values, terms=None):
    df = texts(spark, values)
    found = promo.with_promotions(df, "text", terms) if terms else promo.with_promotions(df, "text")
    return [[(m["term"], m["number"]) for m in r["promotions"]] for r in found.orderBy("id").collect()]


def test_promotion_pattern(spark):
    got = promos(spark, ["Menang88", "Suka138", "Juara 77", "Singapore88", "Sidney49", "menang88x"])
    assert got == [
        [("menang", "88")], [("suka", "138")], [("juara", "77")], [("singapore", "88")],
        [("sidney", "49")], [("menang", "88")],
    ]
    assert promos(spark, ["menangis88", "menang8", "menang1234", "Singapore news", None]) == [[]] * 5
    assert promos(spark, ["juara 77, menang88 juara77"]) == [
        [("juara", "77"), ("menang", "88"), ("juara", "77")]
    ]


def test_promotion_terms(spark):
    assert promos(spark, ["bet 365 88 bet12"], ["Bet", "BET-365", " "]) == [
        [("bet 365", "88"), ("bet", "12")]
    ]
    with pytest.raises(ValueError):
        promo.prefix_alternatives(["!", ""])


def test_only_verified_meanings(spark, tmp_path):
    entry = {"number": "88", "meaning": "verified paraphrase", "meaning_status": "contextual",
             "review_status": "verified", "source_ids": ["licensed-source"]}
    entries = [
        entry,
        {"number": "77", "meaning": "pending", "review_status": "pending"},
        {"number": "88", "meaning": "second", "review_status": "verified"},
        {"number": "8", "meaning": "short", "review_status": "verified"},
        {"number": "49", "meaning": "", "review_status": "verified"},
    ]
    path = tmp_path / "numbers.json"
    path.write_text(json.dumps({"entries": entries}))
    numbers = promo.verified_numbers(read_number_reference(spark, str(path)))
    posts = texts(spark, ["Menang88", "Juara77", "x"])
    found = promo.with_promotions(posts, "text")
    matched = promo.with_meanings(found, "id", numbers).orderBy("id").collect()
    assert [[len(m["meanings"]) for m in r["promotions"]] for r in matched] == [[2], [0], []]
    report = promo_table(posts, "id", numbers).orderBy("id").collect()
    assert report[0]["verified_number_meanings"] == (
        "verified paraphrase (contextual; sources: licensed-source); second (unknown; sources: )"
    )
    assert (report[1]["matched_patterns"], report[1]["verified_number_meanings"]) == ("juara + 77", "")
    assert report[2]["suspected_gambling_promo"] is False
    missing = promo.verified_numbers(read_number_reference(spark, str(tmp_path / "none.json")))
    assert missing.count() == 0
    plain = promo_table(texts(spark, ["Menang88"]), "id").first()
    assert (plain["matched_patterns"], plain["verified_number_meanings"]) == ("menang + 88", "")


def test_toxicity_meter(spark):
    values = [
        "aku sangat marah dan ingin menyerang orang",
        "aku benci kamu dan ingin menghancurkan semuanya",
        "bunuh bunuh",
        "bunuh kamu dan dia itu",
        "", None, "!!!",
    ]
    df = texts(spark, values).withColumn("s", rules.toxicity_meter("text"))
    got = df.withColumn("label", rules.meter_label("s")).orderBy("id").collect()
    assert [r["s"] for r in got] == [0.2857, 0.1429, 1.0, 0.45, 0.0, 0.0, 0.0]
    assert [r["label"] for r in got][:3] == ["toxic", "non_toxic", "toxic"]


def test_keyword_features(spark):
    df = texts(spark, ["suka suka bahagia marah", "sedih baik damai", None])
    got = df.orderBy("id").select(rules.keyword_features("text").alias("v")).collect()
    assert [r["v"] for r in got] == [[2, 1, 0, 0], [0, 0, 1, 2], [0, 0, 0, 0]]


def test_flags(spark):
    df = spark.createDataFrame([(1, 0), (0, 1), (1, 1), (0, 0)], "rule int, svm int")
    got = df.select(rules.or_flags("rule", "svm"), rules.review_flag("rule", "svm")).collect()
    assert [tuple(r) for r in got] == [(1, 1), (1, 0), (1, 0), (0, 0)]
    assert [r[0] for r in df.select(rules.mood_proxy("svm")).collect()][:2] == ["happy", "angry"]
    assert df.select(F.max(rules.sentiment_proxy("svm"))).first()[0] == "positive"


@pytest.mark.parametrize("first_words", [100_000, 1])
def test_joined_phrases_of_all_lengths(spark, monkeypatch, first_words):
    """Each distinct n-gram once, with no array of all n-grams of a text in the plan."""
    monkeypatch.setattr(lexicon, "FIRST_WORDS", first_words)
    names = ["a", "a b", "b c d", "c d", "d a b a", "e f", "z"]
    entries = spark.createDataFrame([(i, n, r) for i, n in enumerate(names) for r in "yx"], "position long, expression string, region string")
    texts_ = ["A b, a b! c d", "d a b a d a b a", "b c", "", None, "e e f", "a"]
    df = spark.createDataFrame(list(enumerate(texts_)), "id long, text string")
    found = lexicon.lexicon_hits(df, "text", "id", lexicon.group_lexicon(entries))
    got = {r["id"]: [m["expression"] for m in r["matches"]] for r in found.collect()}
    assert got == {0: ["a", "a b", "b c d", "c d"], 1: ["a", "a b", "d a b a"], 5: ["e f"], 6: ["a"]}
    assert all(m["regions"] == ["x", "y"] for r in found.collect() for m in r["matches"])
    assert "lambdafunction(array_join" not in found._jdf.queryExecution().optimizedPlan().toString()
