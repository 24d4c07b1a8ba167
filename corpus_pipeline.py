"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicara.llm import bpe, decontaminate, langid, minhash, pii
from wicara.llm.common import Scratch, table

ENCODED_TOGETHER = 2_000_000  # characters; the stages before leave less memory than a fresh session has
LEAST_SCORE = 0.3  # below it a text is in none of the learned languages


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts no learned language fits."""
    found = langid.predict(docs, langid.fit(docs))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(known).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: that with the smallest id, null ids last."""
    scratch = Scratch(spark, "copies")
    rows = scratch.write(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = scratch.write(minhash.near_duplicates(rows, doc_id="_row").select("_row", "component_id", "kept"), "found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    first = scratch.write(first.where("_row <> component_id"), "first")  # its group is named by another row
    copies = found.where(~F.col("kept")).select("_row").join(first, "_row", "left_anti")
    copies = scratch.write(copies.unionByName(first.select(F.col("component_id").alias("_row"))), "copies")
    return rows.join(copies, "_row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage; rows without id are told apart by their text."""
    rows = docs.withColumn("_row", F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))))
    bad = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), doc_id="_row", short_items=True)
    return rows.join(bad.select("_row"), "_row", "left_anti").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind and renew the character counts."""
    hidden = pii.redact(docs)
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left; digests of ids and decoded text."""
    return bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"), size=ENCODED_TOGETHER)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("bpe_encoding", encode_tokens),
]

# SQL cannot express the fitted model, the sketches or the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
