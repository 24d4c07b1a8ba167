"""Benchmark passages in training texts, by spaced-seed hashing. DataFrame functions only.

Tokens are lower-cased runs of letters and digits. Four fixed masks over at most eight tokens read
five of them and ignore the others; equal mask hashes of a training text and a benchmark item name
a diagonal, along which the item is laid against the text. A passage is an overlap in which some
window of 16 aligned tokens (of the whole item, if it is shorter) has at least three quarters equal.
The masks together meet every placement of four substitutions in 16 tokens; items of 8 to 13 tokens
have two more masks, with which every placement of the two or three substitutions they may have is
met, so none is missed. With ``short_items`` items of fewer than ``LEAST_ITEM`` tokens are found as exact
copies of the whole item, by a mask as long as the item.

Defined results: null and empty texts hold nothing; without ``short_items`` items of fewer than
``LEAST_ITEM`` tokens, which can be common phrases, are not searched. Rows with equal ids are one document. Columns
other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicara.llm.common import Scratch

MASKS = ("111011", "10010111", "11110001", "110111")
SHORT_MASKS = ("1100101", "101101")  # for items of LEAST_ITEM to SHORT tokens
SHORT = 13
SPAN = 8
WINDOW = 16
SHARE = 0.75
LEAST_ITEM = 8
BROADCAST_SEEDS = 2_000_000  # seed rows (24 bytes each) sent to every executor; beyond it, a shuffle


def token_hashes(df: DataFrame, text: str) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.split(F.lower(df[text].cast("string")), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(F.coalesce(words, F.array()), lambda w: w != ""), lambda w: F.xxhash64(w))


def numbered_masks() -> dict[int, tuple[str, int, int]]:
    """Number to mask, and the least and most tokens of the items it is for."""
    most = 2**31 - 1
    listed = [(m, LEAST_ITEM, most) for m in MASKS] + [(m, LEAST_ITEM, SHORT) for m in SHORT_MASKS]
    return dict(enumerate(listed + [("1" * n, n, n) for n in range(1, LEAST_ITEM)]))


def seeds(df: DataFrame, numbers: list[int], items: bool) -> DataFrame:
    """``df`` (with ``h``, token hashes) once per position and mask: ``at``, ``number``, ``seed``.

    Of ``items`` only the masks for their length are read.
    """
    masks = {n: numbered_masks()[n] for n in numbers}
    shortest = min((len(m) for m, _, _ in masks.values()), default=1)
    # a mask shorter than the span also starts in the last places; tokens beyond the end are null
    placed = df.where(F.size("h") >= shortest).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("h") - shortest)))
    hashes = []
    for number, (mask, least, most) in masks.items():
        read = [F.get("h", F.col("at") + i) for i, sign in enumerate(mask) if sign == "1"]
        fits = F.col("at") + len(mask) <= F.size("h")
        if items:
            fits &= F.size("h").between(least, most)
        hashes.append(F.when(fits, F.struct(F.lit(number).alias("number"), F.xxhash64(F.lit(number), *read).alias("seed"))))
    one = F.explode(F.array(*hashes) if hashes else F.array().cast("array<struct<number:int,seed:long>>"))
    return placed.withColumn("_one", one).where("_one is not null").select(*df.columns, "at", "_one.number", "_one.seed")


def window_matches(equal: Column, size: Column) -> Column:
    """Most equal tokens in any window of ``size`` aligned tokens; ``equal`` holds 0 and 1."""
    sums = F.aggregate(
        equal,
        F.array(F.lit(0)),
        lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + e)),
    )
    starts = F.sequence(F.lit(0), F.size(equal) - size)
    return F.array_max(F.transform(starts, lambda i: F.get(sums, i + size) - F.get(sums, i)))


def passages(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_seeds: int = BROADCAST_SEEDS,
    short_items: bool = False,
) -> DataFrame:
    """(doc, item, start, n_equal, n_aligned) of every verified overlap; ``start`` is its first token."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.write(
        benchmark.select(benchmark[item_id].alias("item"), token_hashes(benchmark, item_text).alias("h"))
        .where(F.size("h") >= (1 if short_items else LEAST_ITEM))
        .withColumn("row", F.xxhash64("item", "h"))
        .dropDuplicates(["item", "row"]),
        "items",
    )
    wanted = scratch.write(
        seeds(items, list(numbered_masks()), True).select(
            "number", "seed", "item", "row", F.col("at").alias("place"), F.size("h").alias("n")
        ),
        "seeds",
    )
    used = sorted(r["number"] for r in wanted.select("number").distinct().collect())  # masks some item needs
    if wanted.count() <= broadcast_seeds:
        wanted = F.broadcast(wanted)
    tokens = docs.select(docs[doc_id].alias("doc"), token_hashes(docs, text).alias("h"))
    hits = seeds(tokens, used, False).drop("number").join(wanted.drop("number"), "seed").withColumn("start", F.col("at") - F.col("place"))
    skipped = F.greatest(-F.col("start"), F.lit(0))
    aligned = (
        hits.select(
            "doc",
            "item",
            "row",
            "start",
            F.slice("h", F.greatest("start", F.lit(0)) + 1, F.col("n") - skipped).alias("part"),
        )
        .distinct()
        .join(items.select("item", "row", F.col("h").alias("full")), ["item", "row"])
    )
    own = F.slice("full", F.greatest(-F.col("start"), F.lit(0)) + 1, F.size("part"))
    scored = aligned.withColumn("own", own).withColumn(
        "equal", F.zip_with("part", "own", lambda a, b: F.when(a == b, 1).otherwise(0))
    )
    size = F.least(F.size("full"), F.lit(WINDOW))
    best = F.when(F.size("equal") >= size, window_matches(F.col("equal"), size)).otherwise(0)
    least = F.when(F.size("full") < LEAST_ITEM, F.size("full")).otherwise(F.ceil(size * SHARE))
    found = (
        scored.where(best >= least)
        .groupBy("doc", "item", "start")
        .agg(
            F.max(F.aggregate("equal", F.lit(0), lambda a, e: a + e)).alias("n_equal"),
            F.max(F.size("equal")).alias("n_aligned"),
        )
    )
    return scratch.finish(found, "passages")


def contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """One row per document that holds a passage: its items, and the longest overlap."""
    doc_id = names.get("doc_id", "doc_id")
    return (
        passages(docs, benchmark, **names)
        .groupBy(F.col("doc").alias(doc_id))
        .agg(
            F.countDistinct("item").alias("n_items"),
            F.sort_array(F.collect_set("item")).alias("item_ids"),
            F.max("n_equal").alias("most_equal"),
        )
    )
