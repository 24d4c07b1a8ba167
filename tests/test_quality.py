from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wicara.functions.text import clean_ascii
from wicara.operators import labels, quality, stemming
from wicara.schemas import COMMENTS, require_columns
from wicara.sources import feed, files

ROWS = [
    (1, "a", 0), (2, "a", 1), (3, "b", 0), (4, "b", 0), (5, None, 1), (6, None, 0), (7, "c", None), (8, "c", 1),
]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, text string, toxicity int")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_conflicts(rows):
    assert ids(quality.conflict_rows(rows, "text", "toxicity", "id")) == [1, 2]
    assert ids(quality.conflict_free_rows(rows, "text", "toxicity", "id")) == [3, 4, 5, 6, 7, 8]


def test_label_counts(rows):
    got = {r["text"]: r["n_label"] for r in quality.labels_per_key(rows, "text", "toxicity").collect()}
    assert got == {"a": 2, "b": 1, "c": 1}
    assert [r["text"] for r in quality.label_conflicts(rows, "text", "toxicity").collect()] == ["a"]


def test_duplicates(rows):
    assert ids(quality.keep_first(rows, "text", "id")) == [1, 3, 5, 7]
    assert ids(quality.duplicate_rows(rows, "text", "id")) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert quality.duplicate_count(rows, "text").first()["n_duplicates"] == 4
    assert ids(quality.keep_first_consistent(rows, "text", "toxicity", "id")) == [3, 5, 7]


def test_profile_and_counts(rows):
    profile = {r["column_name"]: (r["n_non_null"], r["n_null"]) for r in quality.column_profile(rows).collect()}
    assert profile == {"id": (8, 0), "text": (6, 2), "toxicity": (7, 1)}
    assert [tuple(r) for r in quality.value_counts(rows, "toxicity").collect()] == [(0, 4), (1, 3)]
    shares = {r["toxicity"]: r["share"] for r in quality.value_shares(rows, "toxicity").collect()}
    assert shares == {0: 0.571, 1: 0.429}
    table = quality.crosstab(rows, "text", "toxicity", [0, 1]).collect()
    assert {r["text"]: (r["toxicity_0"], r["toxicity_1"]) for r in table} == {"a": (1, 1), "b": (2, 0), "c": (0, 1)}


def test_filters_and_defaults(spark):
    df = spark.createDataFrame([(0, " x "), (1, "y"), (None, "z"), (0, " \n"), (0, None)], "flag int, text string")
    assert quality.drop_spam(df, "flag").count() == 3
    assert quality.drop_blank(df).count() == 3
    assert quality.count_blank(df).first()["n_blank"] == 2
    filled = quality.fill_defaults(df, "flag", "text").collect()
    assert [r["flag"] for r in filled] == [0, 1, 0, 0, 0]
    assert filled[4]["text"] == ""


def test_sample_and_union(spark):
    df = spark.range(50)
    assert quality.hash_sample(df, "id", 7).collect() == quality.hash_sample(df.repartition(3), "id", 7).collect()
    both = quality.tagged_union([("a", spark.range(2)), ("b", spark.range(3))])
    assert {r["source"]: r["count"] for r in both.groupBy("source").count().collect()} == {"a": 2, "b": 3}
    with pytest.raises(ValueError):
        quality.tagged_union([])


def test_multi_hot(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, ["c", "c"])], "id int, t array<string>")
    got = labels.multi_hot(df, "t").orderBy("id").collect()
    assert [(r["t_a"], r["t_b"], r["t_c"]) for r in got] == [(1, 1, 0), (0, 0, 0), (0, 0, 1)]
    assert labels.multi_hot_long(df, "t", "id").count() == 3
    assert labels.fit_labels(df, "t") == ["a", "b", "c"]


def test_stemming(spark):
    values = ["makan makanan", "memakan  di rumah", "", None, "makanan " * 5]
    df = spark.createDataFrame(list(enumerate(values)), "id long, text string")
    stems = {"makanan": "makan", "memakan": "makan"}
    built = stemming.build_dictionary(stemming.distinct_tokens(df, "text"), lambda w: stems.get(w, w))
    assert built.count() == 2
    small = stemming.stem_by_dictionary(df, "text", "id", built, "out").orderBy("id").collect()
    assert [r["out"] for r in small] == ["makan makan", "makan di rumah", "", "", "makan makan makan makan makan"]


def test_json_lines(spark, tmp_path):
    lines = [
        '{"text": "a", "toxicity": 1}', "[1]", "5", '{"a":', '{"a":1} x', "{'a':1}", '{"a":NaN}', "",
        ' {"text":"b"} ', '{"a":1},{"b":2}', "null", '{"a":01}', "{}", '{"a":[1,{"b":null}]}',
        '\t{"t":1}', '{"a":1}]  ,[{}', '{"a":1}},{"b":1}', '{"a":1}}', '{"a":1,"a":2}',
    ]
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(lines) + "\n")
    raw = spark.read.text(str(path))
    flags = {r["value"]: r["ok"] for r in raw.select("value", files.is_json_object("value").alias("ok")).collect()}
    good = {lines[0], '{"a":NaN}', ' {"text":"b"} ', "{}", '{"a":[1,{"b":null}]}', '\t{"t":1}', '{"a":1,"a":2}'}
    assert {k for k, v in flags.items() if v} == good
    assert files.json_validity(raw).first().asDict() == {"n_valid": 7, "n_invalid": 12}
    rows = files.read_jsonl(spark, str(path)).filter("text is not null").orderBy("text").collect()
    assert [(r["text"], r["toxicity"]) for r in rows] == [("a", 1), ("b", None)]


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text(
        ",".join(COMMENTS.names) + '\n"a ""quoted""\nline",0,1,"x, y",0,0,1,0,0,\n,1,,,0,0,0,0,0,p\n'
    )
    got = files.read_csv(spark, str(path)).collect()
    assert [(r["text"], r["toxicity"], r["topic"]) for r in got] == [('a "quoted"\nline', 1, "x, y"), (None, None, None)]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(["a", "it's"], 7)], "topic_list array<string>, row_id long")
    files.export_csv(df, out, "row_id")
    back = spark.read.option("header", True).option("escape", '"').csv(out)
    assert back.columns == ["row_id", "topic_list"]
    from wicara.functions.lists import parse_list_literal

    assert back.select(parse_list_literal("topic_list")).first()[0] == ["a", "it's"]
    files.write_table(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def test_annotators_and_word_list(spark, tmp_path):
    path = tmp_path / "annotators.csv"
    path.write_text(
        "annotator_id,ethnicity,religion,disability,lgbt,gender,age,domisili,pendidikan terakhir,"
        "status pekerjaan,president vote leaning\n5,Bali,Hindu,no,no,M ,23,Banda Aceh ,S1,Bekerja,-\n"
    )
    row = files.read_annotators(spark, str(path)).first()
    assert (row["annotator_id"], row["gender"], row["domisili"], row["president vote leaning"]) == (5, "M", "Banda Aceh", "-")
    words = tmp_path / "stop.txt"
    words.write_text("yang\n di \n\nyang\n")
    assert files.read_word_list(spark, str(words)) == ["di", "yang"]


def test_feed_selection(spark):
    posts = spark.createDataFrame(
        [(1, "#DPR ya", "id", False), (2, "#dpr RT", "id", True), (3, "#dpr", "en", False), (4, "dpr", "id", None), (5, "", "id", None)],
        "id long, text string, lang string, is_retweet boolean",
    )
    kept = feed.select_posts(posts, hashtags=feed.hashtags_of("text"))
    assert ids(kept) == [1]
    assert feed.latest_posts(posts, [F.desc("id")], 2).count() == 2


def test_required_columns(spark):
    with pytest.raises(ValueError):
        require_columns(spark.range(1), "id", "text_clean")
    assert spark.range(1).select(clean_ascii(F.lit("A"))).first()[0] == "a"


def test_sparse_labels(spark):
    rows = [(1, ["b", "a", "b", None]), (2, []), (3, None), (4, ["c"]), (5, ["a"])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    numbers = labels.label_numbers(df, "t")
    number = {r["label"]: r["number"] for r in numbers.collect()}
    assert sorted(number) == ["a", "b", "c"] and sorted(number.values()) == [0, 1, 2]
    got = {r["id"]: r["indices"] for r in labels.sparse_labels(df, "t", "id").collect()}
    assert got == {i: sorted({number[v] for v in ls or [] if v}) for i, ls in rows}
    new = spark.createDataFrame([(9, ["z", "c"])], "id int, t array<string>")
    assert labels.sparse_labels(new, "t", "id", numbers).first()["indices"] == [number["c"]]
    many = spark.range(20_000).select("id", F.array((F.col("id") * 7 % 15_000).cast("string")).alias("t"))
    found = labels.label_numbers(many, "t").agg(F.count("*"), F.min("number"), F.max("number"), F.count_distinct("number")).first()
    assert tuple(found) == (15_000, 0, 14_999, 15_000)


def test_hash_sample(spark):
    df = spark.range(9_000).repartition(5)
    order = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("7")))
    want = [r["id"] for r in df.orderBy(order).collect()]
    for n in (0, 1, 50, 5_000, 9_000, 10_000):
        assert [r["id"] for r in quality.hash_sample(df, "id", n, 7).collect()] == want[:n]
    assert quality.hash_sample(df.limit(0), "id", 3).collect() == []
