"""Chat formatting with prefix targets.

Each turn becomes a segment of a fixed template; control strings inside texts and roles are escaped
reversibly. Every assistant turn becomes an example of its own: its context is the formatted
conversation before it and only its reply is trainable. As the examples of a conversation are
prefixes of the same formatted text, the segments are stored once, each with its place, and an
example names its end and its trainable span; the stored size stays in proportion to the input.
``example_texts`` spells examples out.

Defined results: rows are ordered by turn, then role, then text; repeated rows are turns of their
own; null texts and roles are empty; a null conversation id is a conversation of its own. Columns
other than the four named are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wicara.llm.common import Scratch, lean

START, END, TARGET = "<|im_start|>", "<|im_end|>\n", "assistant"
SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)


def escape(text: Column) -> Column:
    r"""``<|`` becomes ``<\|``, ``<\|`` becomes ``<\\|`` and so on; nothing else changes."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    """As ``escape``, and the line feed that ends a role is spelled out."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_text(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def unescape_role(role: str) -> str:
    return unescape_text(role.replace("%0A", "\n").replace("%25", "%"))


def segments(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per turn: conv, seq, segment, start, loss_start and loss_end (null: not trainable).

    Offsets count code points of the formatted conversation. The running sums stream through a
    window; no conversation is gathered.
    """
    rows = turns.select(
        turns[conv_id].alias("conv"),
        turns[turn].alias("turn"),
        F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text].cast("string"), F.lit("")).alias("body"),
    )
    order = W.partitionBy("conv").orderBy("turn", "role", "body")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = rows.withColumn("head", head).withColumn("said", escape(F.col("body")))
    whole = parts.withColumn("segment", F.concat("head", "said", F.lit(END)))
    placed = whole.withColumn("seq", F.row_number().over(order).cast("long")).withColumn(
        "start", F.sum(F.length("segment").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.length("segment")
    )
    loss = F.col("start") + F.length("head")
    target = F.col("role") == TARGET
    return placed.select(
        "conv",
        "seq",
        "segment",
        "start",
        F.when(target, loss).alias("loss_start"),
        F.when(target, loss + F.length("said")).alias("loss_end"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: its context is [0, context_end), its trainable span follows."""
    return formatted.where(F.col("loss_start").isNotNull()).select(
        "conv",
        F.col("seq").alias("target_seq"),
        F.col("start").alias("context_end"),
        "loss_start",
        "loss_end",
        (F.col("start") + F.length("segment")).alias("example_end"),
    )


def example_texts(formatted: DataFrame, partitions: int | None = None) -> DataFrame:
    """(conv, target_seq, text, loss_start, loss_end): every example with its whole text.

    Streams the sorted segments; a task holds the formatted text of one conversation. The output is
    as large as the sum of all prefixes.
    """
    schema = "conv long, target_seq long, text string, loss_start long, loss_end long"

    def run(batches):
        import pandas as pd

        conv, so_far = object(), ""
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = None if pd.isna(row.conv) else int(row.conv)
                if key != conv:
                    conv, so_far = key, ""
                so_far += row.segment
                if not pd.isna(row.loss_start):
                    out.append((key, int(row.seq), so_far, int(row.loss_start), int(row.loss_end)))
                if len(out) >= 64:
                    yield pd.DataFrame(out, columns=["conv", "target_seq", "text", "loss_start", "loss_end"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["conv", "target_seq", "text", "loss_start", "loss_end"])

    return _dealt(formatted, partitions).mapInPandas(run, schema)


def _dealt(formatted: DataFrame, partitions: int | None = None) -> DataFrame:
    dealt = formatted.repartition(partitions, "conv") if partitions else formatted.repartition("conv")
    return dealt.sortWithinPartitions("conv", "seq")


def write_examples(turns: DataFrame, scratch: Scratch, **names: str) -> tuple[DataFrame, DataFrame]:
    """The formatted segments and the example table, written and read back."""
    formatted = scratch.write(segments(turns, **names), "formatted")
    return formatted, scratch.write(examples(formatted), "examples")


@lean
def _digests(batches):
    """Sorted segments to one row per conversation; digests grow turn by turn."""
    import pyarrow as pa

    names = ("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "example_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    state, seen = None, False
    close = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6], s[7])
    for batch in batches:
        done = []
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for conv, segment, start, loss_start, loss_end in zip(*columns, strict=True):
            if not seen or conv != state[0]:
                if seen:
                    done.append(close(state))
                state, seen = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0], True
            role, said = SEGMENT.fullmatch(segment).groups()
            state[1] += 1
            state[2].update(f"{unescape_role(role)}\n{unescape_text(said)}\n".encode())
            state[5] += len(segment)
            if loss_start is not None:
                reply = unescape_text(segment[loss_start - start : loss_end - start])
                state[3] += len(reply)
                state[4].update(reply.encode())
                state[6] += 1
                state[7] += state[5]
        if done:
            yield pack(done)
    if seen:
        yield pack([close(state)])


def conversation_digests(formatted: DataFrame, targets: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per conversation, read from the written segments and examples."""
    spans = targets.select("conv", F.col("target_seq").alias("seq"), "loss_start", "loss_end")
    same = formatted["conv"].eqNullSafe(spans["conv"]) & (formatted["seq"] == spans["seq"])
    joined = formatted.drop("loss_start", "loss_end").join(spans, same, "left").select(
        formatted["conv"], formatted["seq"], "segment", "start", spans["loss_start"], spans["loss_end"]
    )
    ordered = _dealt(joined).select("conv", "segment", "start", "loss_start", "loss_end")
    schema = (
        "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_examples long, example_chars long"
    )
    return ordered.mapInArrow(_digests, schema).withColumnRenamed("conv", conv_id)
