"""Split and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicara.catalog.base import COMMENTS_SQL, comments, query
from wicara.operators import splits
from wicara.operators.keys import group_key
from wicara.session import cut_lineage
from wicara.sources.files import read_table


@query(
    "exact_split",
    "select o_orderkey, case when row_number() over (order by md5(o_orderkey || ':42')) "
    "<= ceil(count(*) over () * 0.2) then 'test' else 'train' end as split from orders",
)
def exact_split(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey")
    return splits.exact_split(orders, "o_orderkey", 0.2, 42)


@query(
    "ordered_split",
    "select event_id, case when row_number() over (order by event_id desc) "
    "<= ceil(count(*) over () * 0.25) then 'test' else 'train' end as split from events",
)
def ordered_split(spark, folder):
    events = read_table(spark, folder, "events").select("event_id")
    return splits.exact_split(events, "event_id", 0.25, shuffle=False)


FOLDS_SQL = f"""
with c as (select doc_id, sha256(text) as k, coalesce(toxicity, 0) as y from ({COMMENTS_SQL}) q),
g as (select k, cast(2 * sum(y) > count(*) as integer) as s from c group by k),
f as (select k, (row_number() over (partition by s order by md5(k || ':42')) - 1) % 5 as fold from g)
select c.doc_id, c.y, c.k, cast(f.fold as integer) as fold from c join f on c.k = f.k
"""


def folded(spark, folder):
    rows = comments(spark, folder).select(
        "doc_id", "text", F.coalesce("toxicity", F.lit(0)).alias("toxicity")
    )
    return splits.stratified_group_folds(rows, "text", "toxicity", "doc_id", 5, 42)


@query("stratified_group_folds", f"select doc_id, fold from ({FOLDS_SQL}) f")
def stratified_group_folds(spark, folder):
    return folded(spark, folder).select("doc_id", "fold")


@query(
    "fold_leakage_check",
    f"select count(*) as n_groups, count(*) filter (where n > 1) as n_leaking from "
    f"(select k, count(distinct fold) as n from ({FOLDS_SQL}) f group by k) g",
)
def fold_leakage_check(spark, folder):
    return splits.fold_leaks(folded(spark, folder), "text")


# Three rows in ten repeat one of four texts: two hold a tenth of all rows each, two a twentieth.
HEAVY_TEXT = (
    "case when doc_id % 20 < 2 then 'heavy 0' when doc_id % 20 < 4 then 'heavy 1' when doc_id % 20 = 4 then 'heavy 2' "
    "when doc_id % 20 = 5 then 'heavy 3' else text end"
)
HEAVY_LABEL = "case when doc_id % 20 < 6 then cast(doc_id % 100 in (1, 24) as integer) else toxicity end"


@query(
    "balanced_group_folds",
    f"select count(*) as n_rows, sum(y) as n_positive, count(distinct k) as n_groups, 0 as n_leaking, 5 as n_folds, "
    f"true as rows_even, true as positives_even from (select sha256({HEAVY_TEXT}) as k, {HEAVY_LABEL} as y from "
    f"(select doc_id, text, coalesce(toxicity, 0) as toxicity from ({COMMENTS_SQL}) c) q) p",
)
def balanced_group_folds(spark, folder):
    """Folds of a table with four heavy texts: one row that says how even they are.

    The rows of a fold may differ from a fifth of all by a light group of either label, its positive
    rows also by those in light groups of a negative majority.
    """
    k = 5
    plain = comments(spark, folder).select("doc_id", "text", F.coalesce("toxicity", F.lit(0)).alias("toxicity"))
    planted = plain.select("doc_id", F.expr(HEAVY_TEXT).alias("text"), F.expr(HEAVY_LABEL).alias("y"))
    folded = cut_lineage(splits.stratified_group_folds(planted, "text", "y", "doc_id", k, balanced=True))
    groups = folded.groupBy(group_key("text").alias("g")).agg(
        F.count(F.lit(1)).alias("size"), F.sum("y").alias("p"), F.count_distinct("fold").alias("folds")
    )
    is_light = F.col("size") * (splits.HEAVY * k) <= folded.count()
    by_group = groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("folds") > 1).alias("n_leaking"),
        F.coalesce(F.max(F.when(is_light, F.col("size"))), F.lit(0)).alias("light"),
        F.coalesce(F.sum(F.when(is_light & (F.col("p") * 2 <= F.col("size")), F.col("p"))), F.lit(0)).alias("mixed"),
    )
    value = lambda name: by_group.select(name).scalar()
    per_fold = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    off = lambda c: F.greatest(F.max(c) - F.sum(c) / k, F.sum(c) / k - F.min(c))
    totals = per_fold.agg(
        F.sum("n").alias("n_rows"), F.sum("p").alias("n_positive"), F.count(F.lit(1)).alias("n_folds"),
        off("n").alias("rows_off"), off("p").alias("positives_off"),
    )
    slack = 2 * value("light") + 2
    return totals.select(
        "n_rows", "n_positive", "n_folds", value("n_groups").alias("n_groups"), value("n_leaking").alias("n_leaking"),
        (F.col("rows_off") <= slack).alias("rows_even"),
        (F.col("positives_off") <= slack + value("mixed")).alias("positives_even"),
    )


@query(
    "stratified_row_folds",
    "select doc_id, toxic, cast((row_number() over (partition by toxic order by md5(doc_id || ':42')) - 1) "
    "% 3 as integer) as fold from labels",
)
def stratified_row_folds(spark, folder):
    labels = read_table(spark, folder, "labels").select("doc_id", "toxic")
    return splits.stratified_row_folds(labels, "doc_id", "toxic", 3)
