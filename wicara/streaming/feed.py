"""Landed posts as a stream: stateless rule scoring, and keyed state for repeated texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wicara.functions.rules import join_expressions, join_patterns, meter_label, toxicity_meter
from wicara.functions.wordlists import FEED_HASHTAGS, FEED_LANG, GAMBLING_TERMS
from wicara.operators.keys import group_key
from wicara.operators.lexicon import Lexicon, lexicon_rule
from wicara.operators.promo import promo_label, with_promotions
from wicara.plans.scoring import apply_models
from wicara.plans.training import TrainedModels
from wicara.schemas import POSTS
from wicara.session import cut_lineage
from wicara.sources.feed import select_posts


def read_feed(
    spark: SparkSession,
    path: str,
    schema: T.StructType = POSTS,
    file_format: str = "json",
    max_files: int = 1_000,
    **options: str,
) -> DataFrame:
    """Posts landed as files, picked up in bounded micro-batches."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .options(**options)
        .format(file_format)
        .load(path)
    )


def score_feed(
    posts: DataFrame,
    lexicon: DataFrame | Lexicon,
    row_id: str,
    tags: Iterable[str] = FEED_HASHTAGS,
    lang: str = FEED_LANG,
    terms: Iterable[str] = GAMBLING_TERMS,
    hashtags: Column | None = None,
    models: TrainedModels | None = None,
) -> DataFrame:
    """Selected posts with lexicon, meter and promotion outcome; the same for batch and stream.

    With a lexicon that is matched inside the row every step works on one row, so no state, watermark
    or late-data rule is involved. A larger one is joined: score its stream with ``write_batches``.
    """
    lexicon = Lexicon.of(lexicon)
    if posts.isStreaming and not lexicon.in_row:
        raise ValueError("a lexicon this large is joined: use write_batches")
    selected = select_posts(posts, tags, lang, hashtags)
    columns = selected.columns
    if models is not None:
        selected = apply_models(selected, models, "text", row_id)
        columns = columns + ["mood", "sentiment", "final_prediction", "confidence", "rule_review"]
    ruled = with_promotions(lexicon_rule(selected, "text", lexicon, row_id), "text", terms)
    scored = ruled.withColumn("meter", toxicity_meter("text"))
    return scored.select(
        *columns,
        scored["rule.label"].alias("rule_toxicity"),
        join_expressions("rule.matches").alias("matched_expressions"),
        "meter",
        meter_label("meter").alias("meter_label"),
        promo_label("promotions").alias("promo_label"),
        join_patterns("promotions").alias("matched_patterns"),
    )


SEEN = "first_id long, low long, high long, latest long"


def mark_repeats(
    posts: DataFrame, text: str, row_id: str, time: str, label: str | None = None, keep: str = "7 days"
) -> DataFrame:
    """One row per post: the first post of its text, whether it is that one, and label conflicts so far.

    Columns: ``row_id``, ``time``, ``first_id``, ``is_first`` and ``conflict`` (up to this post its text
    has carried more than one label). Posts count in the order of time and id, on a stream within a
    micro-batch. Null texts share one key; posts without a time give no row.

    On a stream the state of a text, four numbers, is kept until ``keep`` after its latest post in event
    time; a post after that starts anew, and posts more than ``keep`` behind the newest one are late and
    give no row, nor do posts up to 1970, where the watermark starts. On a table nothing is late and nothing ends; for posts that arrive in order of time,
    with less than ``keep`` between repeats, both give the same rows.
    """
    of_row = F.lit(None) if label is None else F.col(label)
    narrow = posts.select(
        group_key(text).alias("key"),
        F.col(row_id).cast("long").alias("id"),
        F.col(time).cast("timestamp").alias("time"),
        of_row.cast("long").alias("label"),
    ).where(F.col("time").isNotNull())
    if not posts.isStreaming:
        return _repeats_of_table(narrow, row_id, time)
    shape = f"{row_id} long, {time} timestamp, first_id long, is_first boolean, conflict boolean"
    span = int(pd.Timedelta(keep).total_seconds() * 1000)

    def follow(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        first, low, high, latest = state.get if state.exists else (None, None, None, None)
        rows = pd.concat(list(batches)).sort_values(["time", "id"])  # of one text in one micro-batch
        known, conflicts = first is not None, []
        first = first if known else int(rows["id"].iloc[0])
        for value in rows["label"]:
            if not pd.isna(value):
                low, high = min(low, int(value)) if low is not None else int(value), max(high, int(value)) if high is not None else int(value)
            conflicts.append(low != high)
        firsts = [not known and i == 0 for i in range(len(rows))]
        last = int(rows["time"].iloc[-1].timestamp() * 1000)
        latest = last if latest is None else max(latest, last)
        state.update((first, low, high, latest))
        state.setTimeoutTimestamp(max(latest + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({row_id: rows["id"], time: rows["time"], "first_id": first, "is_first": firsts, "conflict": conflicts})

    keyed = narrow.withWatermark("time", keep).groupBy("key")
    return keyed.applyInPandasWithState(follow, shape, SEEN, "append", GroupStateTimeout.EventTimeTimeout)


def _repeats_of_table(narrow: DataFrame, row_id: str, time: str) -> DataFrame:
    """The same for a table, by partial minima: no text's posts need to meet in one task."""
    place = F.struct("time", "id")
    by_label = narrow.groupBy("key", "label").agg(F.min(place).alias("place"))
    labelled = F.when(F.col("label").isNotNull(), F.col("place"))
    by_key = by_label.groupBy("key").agg(
        F.min("place").alias("first"), F.get(F.array_sort(F.collect_list(labelled)), F.lit(1)).alias("second")
    )  # the first post with another label than the first one, if any
    joined = narrow.join(cut_lineage(by_key), "key")
    return joined.select(
        F.col("id").alias(row_id),
        F.col("time").alias(time),
        F.col("first.id").alias("first_id"),
        (F.col("first.id") == F.col("id")).alias("is_first"),
        F.coalesce(place >= F.col("second"), F.lit(False)).alias("conflict"),
    )


def write_feed(scored: DataFrame, output: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append results as Parquet; the checkpoint folder makes a restart continue without repeats."""
    writer = (
        scored.writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_batches(
    posts: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Score each micro-batch as a batch, for example with a lexicon that has to be joined.

    A batch owns the folder of its number and replaces it when it is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
