from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from wicara.models.forest import ForestParams
from wicara.models.toxicity import ToxicityParams
from wicara.operators.lexicon import Lexicon, default_lexicon, lexicon_frame
from wicara.plans.evaluation import evaluation_report
from wicara.plans.preprocess import conflict_report, preprocess, process_text, topic_encoder
from wicara.plans.scoring import score_posts
from wicara.plans.training import TrainedModels, TrainingParams, train
from wicara.schemas import POSTS
from wicara.streaming.feed import read_feed, score_feed, write_batches, write_feed

COMMENTS = [
    (0, "Kamu goblok bgt!!! \U0001f621", 0, 1, "a, b,,"),
    (1, "Kamu goblok bgt!!! \U0001f621", 0, 1, "a"),
    (2, "gue suka #Jakarta yang indah", 0, 0, None),
    (3, "konflik", 0, 0, "a"),
    (4, "konflik", 0, 1, "a"),
    (5, "spam", 1, 0, "a"),
    (6, None, 0, 0, "a"),
    (7, "!!!", 0, 0, "a"),
    (8, "tak tahu", None, 0, "a"),
]


def comments(spark):
    return spark.createDataFrame(
        COMMENTS, "row_id long, text string, is_noise_or_spam_text int, toxicity int, topic string"
    )


def test_preprocess(spark):
    stems = spark.createDataFrame([("goblok", "gob")], "token string, stem string")
    rows = preprocess(comments(spark), "row_id", ["yang"], stems, True).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [0, 2]
    assert rows[0]["emoji"] == "\U0001f621"
    assert rows[0]["text_clean"] == "kamu goblok banget"
    assert rows[0]["text_processed"] == "kamu gob banget"
    assert (rows[0]["topic_list"], rows[0]["topic_list_a"], rows[0]["topic_list_b"]) == (["a", "b"], 1, 1)
    assert rows[1]["text_processed"] == "saya suka jakarta indah"
    assert (rows[1]["topic_list"], rows[1]["topic_list_a"]) == ([], 0)
    report = conflict_report(comments(spark), "row_id")
    assert sorted(r["row_id"] for r in report.collect()) == [3, 4]


def test_preprocess_checks_columns(spark):
    with pytest.raises(ValueError):
        process_text(comments(spark), "row_id")
    no_topic = spark.createDataFrame([(1, "a")], "row_id long, text_clean string")
    with pytest.raises(ValueError):
        process_text(no_topic, "row_id", encode_topic=True)
    assert process_text(no_topic, "row_id").first()["text_processed"] == "a"


def expressions(spark):
    return Lexicon.of(default_lexicon(spark))


def test_training_and_scoring(spark, tmp_path):
    good, bad = ["warga senang kerja", "program bantuan lancar"], ["kamu goblok sekali", "dasar bajingan tengik"]
    rows = [(i, f"{(good + bad)[i % 4]} nomor{i // 4}", int(i % 4 > 1), ["politik"] if i % 3 else ["agama"]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text_clean string, toxicity int, topic_list array<string>")
    forest = ForestParams(num_trees=3, max_depth=3)
    params = TrainingParams(head_features=50, heads=forest, stacking_trees=3, stacking_folds=2,
                            toxicity=ToxicityParams(max_features=50, calibration_folds=2, max_iter=10))
    models, split = train(df, "id", expressions(spark), params)
    sides = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sides == {"test": 16, "train": 64}
    report = {(r["target"], r["side"], r["measure"]): r["value"] for r in evaluation_report(models, split, "id").collect()}
    assert len(report) == 28
    assert report["toxicity svm", "test", "accuracy"] == 1.0
    assert 0 <= report["toxicity svm", "test", "brier_score"] < 0.25
    assert report["rule review", "test", "n_review"] == 0
    assert report["mood", "train", "accuracy"] == 1.0
    posts = spark.createDataFrame([(1, "Kamu goblok!"), (2, "warga senang")], "id long, text string")
    got = score_posts(posts, models, "id").orderBy("id").collect()
    assert [r["toxicity_final"] for r in got] == ["toxic", "non_toxic"]
    assert [r["lexicon_rule_hit"] for r in got] == [True, False]
    assert got[1]["vocabulary_coverage"] == 1.0
    assert len(got[0]["top_subtopics"]) == 2
    models.save(str(tmp_path / "models"))
    again = score_posts(posts, TrainedModels.load(spark, str(tmp_path / "models")), "id").orderBy("id").collect()
    assert again == got


def test_stream_equals_batch(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    posts = [
        {"id": 1, "text": "menang88 goblok", "lang": "id", "hashtags": ["DPR"], "is_retweet": False},
        {"id": 2, "text": "damai", "lang": "id", "hashtags": ["viral"]},
        {"id": 3, "text": "lain", "lang": "id", "hashtags": ["x"]},
        {"id": 4, "text": "", "lang": "id", "hashtags": ["viral"]},
    ]
    for number in (0, 2):
        lines = "\n".join(json.dumps(p) for p in posts[number : number + 2])
        (landed / f"{number}.json").write_text(lines)
    batch = score_feed(spark.read.schema(POSTS).json(str(landed)), expressions(spark), "id")
    stream = score_feed(read_feed(spark, str(landed), max_files=1), expressions(spark), "id")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # a restart finds nothing new and writes nothing twice
        write_feed(stream, out, state, once=True).awaitTermination()
    written = spark.read.schema(batch.schema).parquet(out).orderBy("id").collect()
    assert written == batch.orderBy("id").collect()
    assert [(r["rule_toxicity"], r["promo_label"]) for r in written] == [
        ("toxic", "suspected_gambling_promo"), ("non_toxic", "no_pattern"),
    ]
    assert batch.select(F.max("meter")).first()[0] == 0.0


def test_stream_with_a_joined_lexicon(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    posts = [{"id": i, "text": t, "lang": "id", "hashtags": ["viral"]} for i, t in enumerate(["menang88 goblok", "damai", "kata7 sok tahu"])]
    (landed / "0.json").write_text("\n".join(json.dumps(p) for p in posts))
    entries = [("goblok", "a"), ("sok tahu", "b")] + [(f"kata{i}", "c") for i in range(2_001)]
    large = Lexicon.of(lexicon_frame(spark, entries), trie_limit=0)
    feed = read_feed(spark, str(landed))
    with pytest.raises(ValueError):
        score_feed(feed, large, "id")
    # below the limit of the trie the same lexicon is matched inside the row, also on a stream
    in_row = score_feed(feed, Lexicon.of(lexicon_frame(spark, entries)), "id")
    write_feed(in_row, str(tmp_path / "trie"), str(tmp_path / "trie-state"), once=True).awaitTermination()
    by_trie = spark.read.schema(in_row.schema).parquet(str(tmp_path / "trie")).orderBy("id").collect()
    assert [r["matched_expressions"] for r in by_trie] == ["goblok", "", "sok tahu, kata7"]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        write_batches(feed, lambda df: score_feed(df, large, "id"), out, state, once=True).awaitTermination()
    rows = spark.read.parquet(out).orderBy("id").collect()
    assert [r["matched_expressions"] for r in rows] == ["goblok", "", "sok tahu, kata7"]


def test_topic_encoder_gives_new_data_the_same_columns(spark):
    names = topic_encoder(comments(spark))
    assert names == ["a", "b"]
    new = spark.createDataFrame([(1, "x", "b, z")], "row_id long, text_clean string, topic string")
    row = process_text(new, "row_id", encode_topic=names).first()
    assert (row["topic_list_a"], row["topic_list_b"]) == (0, 1)
