from __future__ import annotations

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wicara.functions import lists, text
from wicara.functions.emoji import EMOJI_RANGES, extract_emojis, remove_emojis


def apply(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


def test_clean_ascii(spark):
    got = apply(spark, text.clean_ascii, ["  Halo!!!  saya   sangat marah  ", None, "", "é\nA_1", "--"])
    assert got == ["halo saya sangat marah", "", "", "a 1", ""]


def test_normalize_tokens(spark):
    got = apply(spark, text.normalize_tokens, ["GUE gak suka, lu!", None, "  ", "banget"])
    assert got == ["saya tidak suka anda", "", "", "sangat"]


def test_clean_unicode_steps(spark):
    cases = {
        "Lihat https://a.b/c?d=1 www.x.y selesai": "lihat selesai",
        "a<br><b>tebal</b>": "a tebal",
        "hai @user_1, apa": "hai apa",
        "#SavePalestine a#b": "savepalestine ab",
        "heeeebat!!! aa": "hebat aa",
        "café ²": "café ²",
        "x  y\x1cz": "x y z",
        "ok\U0001f600ok": "okok",
    }
    assert apply(spark, text.clean_unicode, list(cases)) == list(cases.values())
    assert apply(spark, text.clean_unicode, [None]) == [""]


def test_collapse_keeps_line_feeds_and_pairs(spark):
    got = apply(spark, text.collapse_repeats, ["aab\n\n\n\nccc", "   ", "\U0001f600" * 4])
    assert got == ["aab\n\n\n\nc", " ", "\U0001f600"]


def test_slang_is_not_transitive_and_keeps_order(spark):
    got = apply(spark, text.slang_normalize, ["knp kenapa gatau", "bgt  bgt", None, "cmiiw"])
    assert got == ["kenapa mengapa tidak tahu", "banget banget", "", "correct me if I'm wrong"]


def test_remove_stopwords_is_case_sensitive(spark):
    got = apply(spark, lambda c: text.remove_stopwords(c, ["yang", "di"]), ["Yang di sana yang", None])
    assert got == ["Yang sana", ""]
    assert apply(spark, lambda c: text.remove_stopwords(c, []), ["a b"]) == ["a b"]


def test_safe_float_and_blank(spark):
    assert apply(spark, text.safe_float, ["1.5", " 2 ", "x", None]) == [1.5, 2.0, 0.0, 0.0]
    assert apply(spark, text.is_blank, [None, "", " \t\n ", "x"]) == [True, True, True, False]


def test_emoji_sequences(spark):
    values = [
        "a\U0001f600b \U0001f44d\U0001f3fd",
        "\U0001f1ee\U0001f1e9!",
        "\U0001f469‍\U0001f4bb ❤️ 1️⃣",
        "12 #tag *",
        None,
    ]
    assert apply(spark, extract_emojis, values) == [
        "\U0001f600 \U0001f44d\U0001f3fd",
        "\U0001f1ee\U0001f1e9",
        "\U0001f469‍\U0001f4bb ❤️ 1️⃣",
        "",
        "",
    ]
    assert apply(spark, remove_emojis, values[:1]) == ["ab "]


def test_emoji_ranges_follow_the_unicode_property():
    ours = set()
    for item in EMOJI_RANGES.split():
        low, _, high = item.partition("-")
        ours.update(range(int(low, 16), int(high or low, 16) + 1))
    property_set = {
        c
        for c in range(0x80, 0x20000)
        if not 0x1F1E6 <= c <= 0x1F1FF and regex.match(r"\p{Emoji}", chr(c))
    }
    # Newer Unicode versions may add code points on either side, all in the symbol planes.
    assert all(c >= 0x1F6D0 for c in ours ^ property_set)


def test_topic_lists(spark):
    assert apply(spark, lists.split_topics, ["a, b,,", None, " ,", "x"]) == [["a", "b"], [], [], ["x"]]
    got = apply(spark, lists.parse_list_literal, ["['a', ' b ']", "[\"it's\", '']", "nope", None, "[]"])
    assert got == [["a", "b"], ["it's"], [], [], []]


def test_indicators_and_top_labels(spark):
    row = spark.createDataFrame([(["b", "c"], [0.25, 0.5, 0.25])], "l array<string>, p array<double>")
    got = row.select(
        lists.indicators("l", ["a", "b", "c"]).alias("v"),
        lists.one_hot(F.lit("b"), ["a", "b"]).alias("h"),
        lists.top_labels("p", ["z", "m", "a"], 2).alias("t"),
    ).first()
    assert got["v"] == [0, 1, 1]
    assert got["h"] == [0.0, 1.0]
    assert got["t"] == ["m (0.50)", "a (0.25)"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40).filter(lambda s: "\x00" not in s), min_size=20, max_size=40))
def test_cleaning_twice_changes_nothing(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    for function in (text.clean_ascii, text.collapse_repeats, text.squeeze_ws):
        once = apply(spark, function, values)
        assert apply(spark, function, once) == once


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40).filter(lambda s: "\x00" not in s), min_size=20, max_size=40))
def test_ascii_clean_equals_word_list(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    expected = [" ".join(regex.findall("[a-z0-9]+", v.lower())) for v in values]
    assert apply(spark, text.clean_ascii, values) == expected


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40).filter(lambda s: "\x00" not in s), min_size=20, max_size=40))
def test_unicode_clean_leaves_words_and_single_spaces(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    for cleaned in apply(spark, text.clean_unicode, values):
        assert regex.fullmatch(r"(?:[\p{L}\p{N}_]+(?: [\p{L}\p{N}_]+)*)?", cleaned)
        assert not regex.search(r"(.)\1\1", cleaned)
