"""Model queries: trained and applied on whole tables with the default settings."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wicara.catalog.base import (
    PROMO_TERMS,
    ascii_sql,
    documents,
    hits_sql,
    labelled,
    mapped_sql,
    query,
    sql_list,
    topics,
    words_sql,
)
from wicara.catalog.rules import expressions, meter_sql, promo_sql
from wicara.functions.lists import split_topics
from wicara.functions.rules import toxic_label
from wicara.functions.text import clean_ascii
from wicara.functions.wordlists import METER_SEVERE_TERMS, METER_TERMS, PRONOUN_MAP
from wicara.models.forest import fit_class_head, fit_label_vector_head
from wicara.models.toxicity import class_weights, decision_policy, fit_toxicity
from wicara.models.trimodel import fit_trimodel, out_of_fold_proto
from wicara.operators.lexicon import lexicon_matches
from wicara.operators.splits import stratified_row_folds
from wicara.plans.evaluation import evaluation_report
from wicara.plans.scoring import score_posts
from wicara.plans.training import TrainingParams, split_rows, train, with_targets
from wicara.session import cut_lineage, remove_on_exit, shared_dir
from wicara.sources.files import read_table
from wicara.streaming.feed import mark_repeats, read_feed, score_feed, write_feed

FEED_TOKENS = f"select doc_id, {mapped_sql(words_sql(ascii_sql('text')), PRONOUN_MAP)} as ws from documents"


def vectors(spark, folder):
    """Dense features with a class, a coarse class and a label vector."""
    return read_table(spark, folder, "embeddings").select(
        "vec_id",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.concat(F.lit("mood_"), "label").alias("mood_y"),
        F.when(F.col("label") < 3, F.lit("negative"))
        .when(F.col("label") < 6, F.lit("neutral"))
        .otherwise(F.lit("positive"))
        .alias("sentiment_y"),
        F.array((F.col("label") % 2 == 0).cast("int"), (F.col("label") > 6).cast("int"), F.lit(0)).alias("subtopic_y"),
    )


LABELS = ["even", "late", "never"]
TARGETS = ("mood_y", "sentiment_y", "subtopic_y")


def rounded(column: str):
    return F.transform(column, lambda p: F.round(p, 6))


@query("mood_head")
def mood_head(spark, folder):
    rows = vectors(spark, folder)
    head = fit_class_head(rows, "features", "mood_y", "mood")
    return head.transform(rows, "features").select(
        "vec_id", "mood", F.array_join(rounded("mood_proba"), ",").alias("mood_proba")
    )


@query("sentiment_head")
def sentiment_head(spark, folder):
    rows = vectors(spark, folder)
    head = fit_class_head(rows, "features", "sentiment_y", "sentiment")
    return head.transform(rows, "features").select(
        "vec_id", "sentiment", F.array_join(rounded("sentiment_proba"), ",").alias("sentiment_proba")
    )


@query("subtopic_head")
def subtopic_head(spark, folder):
    rows = vectors(spark, folder)
    head = fit_label_vector_head(rows, "features", "subtopic_y", LABELS)
    return head.transform(rows, "features").select(
        "vec_id",
        F.array_join("subtopic", ",").alias("subtopic"),
        F.array_join(rounded("subtopic_proba"), ",").alias("subtopic_proba"),
    )


@query("trimodel_scores")
def trimodel_scores(spark, folder):
    rows = vectors(spark, folder)
    model = fit_trimodel(rows, "features", *TARGETS, LABELS)
    return model.transform(rows, "features").select(
        "vec_id", "mood", "sentiment", F.array_join("subtopic", ",").alias("subtopic")
    )


@query("oof_features")
def oof_features(spark, folder):
    folds = stratified_row_folds(vectors(spark, folder), "vec_id", "mood_y", 3)
    rows = cut_lineage(folds)
    proto = out_of_fold_proto(rows, "features", *TARGETS, "fold", 3, LABELS)
    return proto.select("vec_id", "fold", F.array_join(F.col("proto").cast("array<int>"), ",").alias("proto"))


def toxicity_scores(spark, folder):
    rows = labelled(spark, folder).select("doc_id", "text", "toxic")
    model = fit_toxicity(rows, "text", "toxic", "doc_id", lexicon=expressions(spark))
    return model.transform(rows, "text", "doc_id")


@query("svm_scores")
def svm_scores(spark, folder):
    return toxicity_scores(spark, folder).select(
        "doc_id", "toxic", "svm_prediction", "rule_prediction", "final_prediction", "rule_review",
        "or_experimental_prediction",
    )


@query("calibrated_confidence")
def calibrated_confidence(spark, folder):
    return toxicity_scores(spark, folder).select(
        "doc_id",
        "svm_prediction",
        F.round("confidence", 6).alias("confidence"),
        F.round(F.col("class_probabilities")[1], 6).alias("positive_probability"),
    )


def training_rows(spark, folder):
    """The annotated texts with their topics."""
    return labelled(spark, folder).select(
        "doc_id",
        clean_ascii("text").alias("text_clean"),
        F.col("toxic").alias("toxicity"),
        split_topics(topics()).alias("topic_list"),
    )


_TRAINED: dict[tuple[str, str], tuple] = {}


def trained(spark, folder):
    """Models trained on the annotated texts, with the rows and their split; once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = train(training_rows(spark, folder), "doc_id", expressions(spark))
    return _TRAINED[key]


@query("score_posts")
def scored_posts(spark, folder):
    """Every document scored with the trained models."""
    models, _ = trained(spark, folder)
    posts = documents(spark, folder).select("doc_id", "source", "text")
    report = score_posts(posts, models, "doc_id").drop("text")
    return report.withColumn("top_subtopics", F.array_join("top_subtopics", ", "))


@query("evaluation_report")
def evaluated(spark, folder):
    models, rows = trained(spark, folder)
    return evaluation_report(models, rows, "doc_id").withColumn("value", F.round("value", 6))


# The score report without what a model decides: rule hit, rounding and labels of given values.
@query(
    "score_posts_rules",
    f"""
select l.doc_id, count(h.expression) > 0 as lexicon_rule_hit, round_even(l.p, 3) as toxicity_confidence,
  case when l.toxic = 1 then 'toxic' else 'non_toxic' end as toxicity_final,
  count(h.expression) > 0 and l.toxic = 0 as rule_review
from (select doc_id, toxic, (doc_id % 997) / 997.0 as p from labels) l left join ({hits_sql()}) h
  on l.doc_id = h.doc_id group by l.doc_id, l.toxic, l.p
""",
)
def score_posts_rules(spark, folder):
    given = F.col("doc_id") % 997 / 997.0
    ruled = lexicon_matches(labelled(spark, folder), "text", expressions(spark), "doc_id")
    decided = decision_policy(ruled.withColumn("rule", (F.size("matches") > 0).cast("int")), "toxic", "rule")
    return decided.select(
        "doc_id",
        F.col("rule").cast("boolean").alias("lexicon_rule_hit"),
        F.bround(given, 3).alias("toxicity_confidence"),
        toxic_label("final_prediction").alias("toxicity_final"),
        F.col("rule_review").cast("boolean").alias("rule_review"),
    )


@query(
    "training_split",
    f"""
with c as (select l.doc_id, l.toxic as y, sha256({ascii_sql('text')}) as k from labels l join documents d
  on l.doc_id = d.doc_id),
g as (select k, cast(2 * sum(y) > count(*) as integer) as s from c group by k),
f as (select k, (row_number() over (partition by s order by md5(k || ':42')) - 1) % 5 as fold from g)
select c.doc_id, case when f.fold = 0 then 'test' else 'train' end as split,
  case when c.y = 1 then 'angry' else 'happy' end as mood_y from c join f on c.k = f.k
""",
)
def training_split(spark, folder):
    """The test side and the targets of training, before any model is fitted."""
    rows = with_targets(training_rows(spark, folder), ["en"])
    return split_rows(rows, "doc_id", TrainingParams()).select("doc_id", "split", "mood_y")


@query(
    "oof_folds",
    "select doc_id, cast((row_number() over (partition by toxic order by md5(doc_id || ':42')) - 1) % 3 as integer) "
    "as fold, count(*) over () / (2.0 * count(*) over (partition by toxic)) as weight from labels",
)
def oof_folds(spark, folder):
    """Calibration folds and balanced class weights of the annotated rows."""
    rows = stratified_row_folds(read_table(spark, folder, "labels"), "doc_id", "toxic", 3)
    return rows.join(class_weights(rows, "toxic"), "toxic").select("doc_id", "fold", "weight")


FEED_TAGS = ("src1", "src7", "src13")
FEED_SQL = f"""
select d.doc_id, case when count(h.expression) > 0 then 'toxic' else 'non_toxic' end as rule_toxicity,
  coalesce(string_agg(h.expression, ', ' order by h.position), '') as matched_expressions,
  max(case when len(p.terms) > 0 then 'suspected_gambling_promo' else 'no_pattern' end) as promo_label,
  max(m.score) as meter, max(case when m.score >= 0.2 then 'toxic' else 'non_toxic' end) as meter_label
from documents d left join ({hits_sql()}) h on d.doc_id = h.doc_id
join ({promo_sql('documents')}) p on p.doc_id = d.doc_id
join ({meter_sql(METER_TERMS, METER_SEVERE_TERMS, FEED_TOKENS)}) m on m.doc_id = d.doc_id
where d.lang = 'en' and d.source in {sql_list(FEED_TAGS)} group by d.doc_id
"""


def landed(spark, folder, name):
    """A table as a landed feed; the pattern takes a single file as well as a folder of part files."""
    schema = read_table(spark, folder, name).schema
    return read_feed(spark, f"{folder}/{{{name}.parquet}}", schema, "parquet")


@query("feed_stream", FEED_SQL)
def feed_stream(spark, folder):
    """The documents as a landed feed, scored by a stream that runs until the files are used up."""
    base = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    remove_on_exit(spark, base)
    posts = landed(spark, folder, "documents")
    scored = score_feed(
        posts,
        expressions(spark),
        "doc_id",
        tags=FEED_TAGS,
        lang="en",
        terms=PROMO_TERMS,
        hashtags=F.array("source"),
    ).select("doc_id", "rule_toxicity", "matched_expressions", "promo_label", "meter", "meter_label")
    write_feed(scored, f"{base}/out", f"{base}/state", once=True).awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{base}/out")


REPEATS_SQL = """
select doc_id, make_timestamp((1700000000 + cast(doc_id as bigint)) * 1000000) as at, first_value(doc_id) over w as first_id,
  row_number() over w = 1 as is_first, min(doc_id % 3) over w <> max(doc_id % 3) over w as conflict
from documents window w as (partition by text order by doc_id rows unbounded preceding)
"""


def dated(posts):
    """Documents as posts of one second each, with three labels."""
    return posts.select("doc_id", "text", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("at"), (F.col("doc_id") % 3).alias("y"))


@query("repeated_posts", REPEATS_SQL)
def repeated_posts(spark, folder):
    return mark_repeats(dated(read_table(spark, folder, "documents")), "text", "doc_id", "at", "y")


@query("repeat_stream", REPEATS_SQL)
def repeat_stream(spark, folder):
    """The same from a stream with keyed state."""
    base = f"{shared_dir(spark)}/repeats-{uuid.uuid4().hex}"
    remove_on_exit(spark, base)
    posts = landed(spark, folder, "documents")
    marked = mark_repeats(dated(posts), "text", "doc_id", "at", "y")
    write_feed(marked, f"{base}/out", f"{base}/state", once=True).awaitTermination()
    return spark.read.schema(marked.schema).parquet(f"{base}/out")
