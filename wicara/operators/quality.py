"""Row filters, duplicate and label-conflict handling, profiles and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicara.functions.text import is_blank
from wicara.operators.keys import group_key
from wicara.operators.splits import kth_smallest, order_hash
from wicara.session import cut_lineage


def drop_spam(df: DataFrame, flag: str = "is_noise_or_spam_text") -> DataFrame:
    """Keep rows whose spam flag is 0; a missing flag does not count as 0."""
    return df.filter(F.col(flag) == 0)


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(~is_blank(text))


def count_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """One row with the number of blank texts."""
    return df.agg(F.count_if(is_blank(text)).alias("n_blank"))


def fill_defaults(df: DataFrame, label: str = "toxicity", text: str = "text_clean") -> DataFrame:
    return df.withColumn(label, F.coalesce(F.col(label).cast("int"), F.lit(0))).withColumn(
        text, F.coalesce(F.col(text), F.lit(""))
    )


def row_sum(columns: Sequence[str]) -> Column:
    """Sum over columns of one row; nulls count as 0."""
    total = F.lit(0)
    for name in columns:
        total = total + F.coalesce(F.col(name), F.lit(0))
    return total


def labels_per_key(df: DataFrame, key: str, label: str) -> DataFrame:
    """Distinct non-null labels of each non-null key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(label).alias("n_label"))


def _keyed(df: DataFrame, key: str, row_id: str, *more: str) -> DataFrame:
    """Ids with the hash of their key: what grouping needs, without the texts."""
    return df.select(F.col(row_id).alias("_id"), group_key(key).alias("_key"), F.col(key).isNull().alias("_null"), *more)


def _without(df: DataFrame, row_id: str, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows by a table of ids, written first so that its size decides how it is joined."""
    listed = cut_lineage(ids.select(F.col("_id").alias("_listed")))
    return df.join(listed, F.col(row_id) == F.col("_listed"), how)


def label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys carrying more than one label, with the number of labels."""
    return labels_per_key(df, key, label).filter(F.col("n_label") > 1)


def conflict_rows(df: DataFrame, key: str, label: str, row_id: str) -> DataFrame:
    """Rows whose key carries more than one label."""
    return _against_conflicts(df, key, label, row_id, "left_semi")


def conflict_free_rows(df: DataFrame, key: str, label: str, row_id: str) -> DataFrame:
    """Rows whose key carries at most one label; rows without a key are kept."""
    return _against_conflicts(df, key, label, row_id, "left_anti")


def _against_conflicts(df: DataFrame, key: str, label: str, row_id: str, how: str) -> DataFrame:
    # min <> max decides the conflict in one partial aggregation, whatever the group size
    rows = _keyed(df, key, row_id, F.col(label).alias("_label")).where("not _null")
    conflicts = rows.groupBy("_key").agg(F.min("_label").alias("_low"), F.max("_label").alias("_high")).where("_low <> _high")
    return _without(df, row_id, rows.join(conflicts, "_key", "left_semi"), how)


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """Rows beyond the first of each distinct value; nulls equal each other."""
    sizes = df.groupBy(group_key(column).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def keep_first(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """First row, by unique ``row_id``, of each distinct key; null keys form one group.

    Only hashes and ids are grouped and joined; the ids of the copies, not the texts, are listed.
    """
    rows = _keyed(df, key, row_id)
    first = rows.groupBy("_key").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _without(df, row_id, rows.join(first, "_key").where("_id <> _first"))


def keep_first_consistent(df: DataFrame, key: str, label: str, row_id: str) -> DataFrame:
    """First row of each key whose rows agree on the label; null keys form one group.

    Equals ``conflict_free_rows`` followed by ``keep_first`` with one aggregation for both.
    """
    rows = _keyed(df, key, row_id, F.col(label).alias("_label"))
    groups = (
        rows.groupBy("_key")
        .agg(
            F.min("_id").alias("_first"),
            F.coalesce(F.min("_label") != F.max("_label"), F.lit(False)).alias("_conflict"),
            F.count(F.lit(1)).alias("_n"),
        )
        .where("_n > 1")
    )
    dropped = rows.join(groups, "_key").where("_id <> _first or (_conflict and not _null)")
    return _without(df, row_id, dropped)


def duplicate_rows(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """Every row whose key occurs more than once; nulls equal each other."""
    rows = _keyed(df, key, row_id)
    repeated = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _without(df, row_id, rows.join(repeated, "_key", "left_semi"), "left_semi")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null values by falling frequency."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def value_shares(df: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """Non-null values with their share of all non-null rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, F.bround(F.col("n") / total, digits).alias("share"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` by each value of ``column``, as columns ``<column>_<value>``."""
    return (
        df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row)
        .agg(*[F.count_if(F.col(column) == F.lit(v)).alias(f"{column}_{v}") for v in values])
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Type, non-null and null count of every column, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]
    )
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("column_type"),
            F.col(f"`{name}`").alias("n_non_null"),
            (F.col("_rows") - F.col(f"`{name}`")).alias("n_null"),
        )
        for name, kind in df.dtypes
    ]
    return counts.select(F.inline(F.array(*entries)))


def label_vocabulary(df: DataFrame, labels: str) -> DataFrame:
    """Sorted distinct labels over all label lists."""
    return df.select(F.explode(labels).alias("label")).distinct().orderBy("label")


def hash_sample(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in a random but repeatable order.

    The ``n``-th smallest hash is found by counting, so only the rows of the sample are sorted.
    """
    key = order_hash(row_id, seed)
    if 0 < n < df.count():
        df = df.where(key <= F.lit(kth_smallest(df, key, n)))
    return df.orderBy(key, row_id).limit(n)


def tagged_union(tagged: Sequence[tuple[str, DataFrame]], column: str = "source") -> DataFrame:
    """Union of inputs, each marked with its source name."""
    if not tagged:
        raise ValueError("at least one input is required")
    parts = [df.withColumn(column, F.lit(name)) for name, df in tagged]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
