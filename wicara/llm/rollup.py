"""Token totals kept up to date by signed deltas.

A batch of changes inserts, deletes or revises token counts of (document, tokenizer version). What
the batch replaces is read from the state, and the signed differences are summed by source, language
and tokenizer version into the batch's own delta table. Totals are the sum of the deltas of all
committed batches. A batch becomes visible by its commit row, written last; committing it again
changes nothing, and what a failed attempt left behind is overwritten.

Defined results: an insert of a known pair revises it; a delete or revision of an unknown pair is
nothing, or an insert. Of several changes of one pair in a batch the greatest by (number, deletes
last, tokens, source, language) holds. Changes without document or tokenizer are left out; null
sources and languages are groups of their own; a null count is zero. Columns other than those of
``CHANGE`` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE = ("doc_id", "tokenizer", "source", "lang", "n_tokens", "op")
DIMENSIONS = ("source", "lang", "tokenizer")
INSERT, REVISE, DELETE = "insert", "revise", "delete"
_STATE = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean"
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


class TokenRollup:
    """Totals below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self) -> list[tuple[int, str]]:
        """(number, name) of the committed batches, in order; one entry per batch."""
        if not self._exists(f"{self.path}/commits"):
            return []
        rows = self.spark.read.schema("number long, batch string").parquet(f"{self.path}/commits")
        return sorted((r["number"], r["batch"]) for r in rows.distinct().collect())

    def _parts(self, kind: str, schema: str, batches: list[tuple[int, str]]) -> DataFrame:
        """The rows of the given batches, with their ``number``."""
        schema = f"{schema}, number long"
        if not batches:
            return self.spark.createDataFrame([], schema)
        parts = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        return parts.where(F.col("number").isin([n for n, _ in batches]))

    def state(self) -> DataFrame:
        """The current count of every pair."""
        return self._current(self._parts("state", _STATE, self.committed())).where("alive").drop("alive")

    @staticmethod
    def _current(parts: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("source", "lang", "n_tokens", "alive"), "number").alias("last")
        return parts.groupBy("doc_id", "tokenizer").agg(last).select("doc_id", "tokenizer", "last.*")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (columns ``CHANGE``, optionally ``number`` for their order); False if known."""
        done = self.committed()
        if batch in {name for _, name in done}:
            return False
        number = max((n for n, _ in done), default=0) + 1
        order = changes["number"] if "number" in changes.columns else F.lit(0)
        rows = changes.select(
            changes["doc_id"].cast("long").alias("doc_id"),
            changes["tokenizer"].cast("string").alias("tokenizer"),
            F.struct(
                order.cast("long").alias("number"),
                (changes["op"] != DELETE).alias("alive"),
                F.coalesce(changes["n_tokens"].cast("long"), F.lit(0)).alias("n_tokens"),
                changes["source"].cast("string").alias("source"),
                changes["lang"].cast("string").alias("lang"),
            ).alias("change"),
        ).where("doc_id is not null and tokenizer is not null")
        # in order of (number, deletes last, ...): a delete must sort after what it deletes
        ranked = F.struct(F.col("change.number"), ~F.col("change.alive"), F.col("change.n_tokens"), F.col("change.source"), F.col("change.lang"))
        latest = rows.groupBy("doc_id", "tokenizer").agg(F.max_by("change", ranked).alias("c")).select(
            "doc_id", "tokenizer", "c.source", "c.lang", "c.n_tokens", "c.alive"
        )
        self._write(latest, "state", number)
        latest = self.spark.read.schema(_STATE).parquet(f"{self.path}/state/number={number}")
        after = latest.where("alive").select(*DIMENSIONS, F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))
        deltas = after
        if done:
            keys = latest.select("doc_id", "tokenizer")
            replaced = self._current(self._parts("state", _STATE, done).join(keys, ["doc_id", "tokenizer"], "left_semi"))
            before = replaced.where("alive").select(*DIMENSIONS, F.lit(-1).alias("docs"), (-F.col("n_tokens")).alias("tokens"))
            deltas = after.unionByName(before)
        signed = deltas.groupBy(*DIMENSIONS).agg(
            F.sum(F.col("docs").cast("long")).alias("docs"), F.sum("tokens").alias("tokens")
        )
        self._write(signed, "deltas", number)
        commit = self.spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(batch).alias("batch"))
        commit.write.mode("append").parquet(f"{self.path}/commits")
        return True

    def _write(self, df: DataFrame, kind: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}/number={number}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of the groups that hold documents."""
        deltas = self._parts("deltas", _DELTA, self.committed())
        return (
            deltas.groupBy(*DIMENSIONS)
            .agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
            .where("n_docs <> 0 or n_tokens <> 0")
        )


def changes(rows: DataFrame, tokenizer: str, op: str, n_tokens) -> DataFrame:
    """Rows with doc_id, source and lang as changes of one tokenizer version."""
    return rows.select(
        "doc_id", F.lit(tokenizer).alias("tokenizer"), "source", "lang", n_tokens.cast("long").alias("n_tokens"), F.lit(op).alias("op")
    )
