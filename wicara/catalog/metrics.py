"""Evaluation queries: the lexicon rule and the meter against the annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicara.catalog.base import query
from wicara.catalog.rules import METER_SQL, RULE_FLAG_SQL, metered, ruled_labels
from wicara.models.toxicity import class_weights as weights_of
from wicara.operators import metrics
from wicara.sources.files import read_table

COUNTS_SQL = """
select {by} count(*) filter (where y = 1 and p = 1) as tp, count(*) filter (where y <> 1 and p = 1) as fp,
  count(*) filter (where y = 1 and p <> 1) as fn, count(*) filter (where y <> 1 and p <> 1) as tn
from ({rows}) r {group}
"""
RATES = """
  coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) as accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1
"""
RULE_ROWS = f"select toxic as y, rule as p, quality from ({RULE_FLAG_SQL}) f"


@query(
    "binary_metrics",
    f"select tp, fp, fn, tn, {RATES} from ({COUNTS_SQL.format(by='', rows=RULE_ROWS, group='')}) c",
)
def binary_metrics(spark, folder):
    return metrics.binary_metrics(ruled_labels(spark, folder), "toxic", "rule")


@query(
    "binary_metrics_by_lang",
    f"""
select lang, tp, fp, fn, tn, {RATES} from ({COUNTS_SQL.format(
    by='lang,', group='group by lang',
    rows=f"select d.lang, f.toxic as y, f.rule as p from ({RULE_FLAG_SQL}) f join documents d on d.doc_id = f.doc_id"
)}) c
""",
)
def binary_metrics_by_lang(spark, folder):
    return metrics.binary_metrics(ruled_labels(spark, folder), "toxic", "rule", ["lang"])


@query(
    "accuracy_gap",
    f"""
with r as ({RULE_ROWS}),
a as (select avg(cast(y = p as integer)) filter (where quality = 0) as v,
  avg(cast(y = p as integer)) filter (where quality = 1) as t from r),
m as (select {RATES} from ({COUNTS_SQL.format(by='', rows='select * from r where quality = 0', group='')}) c)
select m.*, case when abs(t - v) is null then 'n/a' when abs(t - v) < 0.10 then 'good'
  when abs(t - v) < 0.25 then 'warning' else 'poor' end as status, coalesce(abs(t - v), 0) as gap
from m, a
""",
)
def accuracy_gap(spark, folder):
    rows = ruled_labels(spark, folder).withColumn(
        "split", F.when(F.col("quality") == 1, F.lit("train")).otherwise(F.lit("test"))
    )
    return metrics.evaluation(rows, "toxic", "rule", "split")


_TRUTH, _GUESS = "quality * 2 + toxic", "quality * 2 + rule"


@query(
    "macro_metrics",
    f"""
with r as (select {_TRUTH} as y, {_GUESS} as p from ({RULE_FLAG_SQL}) f),
c as (select y as c from r union select p from r),
k as (select c.c, count(*) filter (where y = c.c and p = c.c) as tp,
  count(*) filter (where y <> c.c and p = c.c) as fp, count(*) filter (where y = c.c and p <> c.c) as fn
  from c, r group by c.c)
select (select avg(cast(y = p as integer)) from r) as accuracy,
  avg(coalesce(tp / nullif(tp + fp, 0), 0)) as macro_precision,
  avg(coalesce(tp / nullif(tp + fn, 0), 0)) as macro_recall,
  avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) as macro_f1 from k
""",
)
def macro_metrics(spark, folder):
    rows = ruled_labels(spark, folder).select(F.expr(_TRUTH).alias("y"), F.expr(_GUESS).alias("p"))
    return metrics.macro_metrics(rows, "y", "p")


def label_vectors(spark, folder):
    rows = ruled_labels(spark, folder)
    return rows.select(F.array("quality", "toxic").alias("y"), F.array(F.lit(1), F.col("rule")).alias("p"))


@query(
    "subset_accuracy",
    f"select avg(cast(quality = 1 and toxic = rule as integer)) as subset_accuracy from ({RULE_FLAG_SQL}) f",
)
def subset_accuracy(spark, folder):
    return metrics.subset_accuracy(label_vectors(spark, folder), "y", "p")


CELLS_SQL = (
    f"select quality as y, 1 as p from ({RULE_FLAG_SQL}) f union all select toxic, rule from ({RULE_FLAG_SQL}) g"
)


@query(
    "micro_f1",
    f"select f1 as micro_f1 from (select {RATES} from ({COUNTS_SQL.format(by='', rows=CELLS_SQL, group='')}) c) m",
)
def micro_f1(spark, folder):
    return metrics.micro_f1(label_vectors(spark, folder), "y", "p")


@query("hamming_loss", f"select avg(cast(y <> p as integer)) as hamming_loss from ({CELLS_SQL}) c")
def hamming_loss(spark, folder):
    return metrics.hamming_loss(label_vectors(spark, folder), "y", "p")


@query(
    "brier_score",
    f"select round(avg(power(m.score - l.toxic, 2)), 10) as brier_score from labels l "
    f"join ({METER_SQL}) m on l.doc_id = m.doc_id",
)
def brier_score(spark, folder):
    rows = read_table(spark, folder, "labels").join(metered(spark, folder), "doc_id")
    return metrics.brier_score(rows, "toxic", "score").withColumn("brier_score", F.round("brier_score", 10))


@query(
    "class_weights",
    "select toxic, count(*) as n, (select count(*) from labels) / (2.0 * count(*)) as weight "
    "from labels group by toxic",
)
def class_weights(spark, folder):
    return weights_of(read_table(spark, folder, "labels"), "toxic")
