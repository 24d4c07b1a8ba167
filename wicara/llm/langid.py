"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, signs other than letters become blanks, and n-grams of one to three
characters are hashed to ``BUCKETS`` features. Document frequencies cover every learning row. The
regression is fitted with the follow-the-regularised-leader update and elastic-net penalties, in
shards whose states are averaged after every round, on at most about ``rows_per_language`` labelled
rows of each language (drawn by a hash of id and text). A temperature fitted on rows kept out of the
regression then calibrates the probabilities.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if
nothing can be learned from. Of equal probabilities the first language in text order wins. Rows are
kept one for one. Null ids are not held out and not learned from. Columns other than the three named
are not read.
"""

from __future__ import annotations

import functools
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicara.llm.common import Scratch, lean, pieces

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = 3
ROWS_PER_LANGUAGE = 1500
SENT_LANGUAGES = 100_000  # row counts by language sent to every task (a few MB); more are joined
SHARDS = 4
ROUNDS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
SCALE = 30.0  # term shares are small numbers; scaled, one setting of the rates suits all lengths
SLICE = 1_000_000  # characters of one text handled at a time
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


@functools.cache
def letter_table() -> np.ndarray:
    """Each code point itself if a letter, else a blank."""
    codes = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, len(codes))
    return np.where(letters, codes, np.uint32(32))


def gram_slices(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of the n-grams of a text, a bounded slice at a time."""
    for start in range(0, len(text), SLICE):
        part = text[start : start + SLICE + ORDERS - 1].lower()
        codes = letter_table()[np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)]
        if start == 0:
            codes = np.concatenate([[np.uint32(32)], codes])
        total, out = np.zeros(len(codes), np.uint32), []
        for order in range(min(ORDERS, len(codes))):
            total = total[: len(codes) - order] + codes[order:] * _FACTORS[order]
            mixed = (total + np.uint32(order)) * np.uint32(0x2C1B3C6D)
            out.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x297A2D39) >> np.uint32(32 - BUCKET_BITS))
        letters = codes != 32
        yield np.concatenate(out) if letters.any() else np.zeros(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Languages in text order, n-gram weights by feature, intercepts and temperature."""

    languages: list[str]
    weights: np.ndarray  # (buckets, languages), inverse document frequencies and scale multiplied in
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total, count = np.zeros(len(self.languages)), 0
        for grams in gram_slices(text):
            if len(grams) > 2000:
                total += np.bincount(grams, minlength=BUCKETS).astype(np.float64) @ self.weights
            else:
                total += self.weights[grams].sum(axis=0)
            count += len(grams)
        return total / max(count, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(p[best], 1.0))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Closed form of the regularised leader; small sums give weights of exactly zero."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl_pass(rows: list[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over (label, features, values), updating the state in place; the last row is the bias."""
    for label, at, x in rows:
        w = ftrl_weights(z[at], n[at])
        error = softmax(x @ w)
        error[label] -= 1.0
        g = x[:, None] * error
        rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - rate * w
        n[at] += g * g


@lean
def _frequencies(batches):
    """Partial document frequencies of a partition: (bucket, docs); bucket -1 counts the rows."""
    import pyarrow as pa

    total, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in pieces(batches):
        for text in batch.column(0).to_pylist():
            if has_letter(text):
                seen = np.zeros(BUCKETS, bool)
                for grams in gram_slices(text):
                    seen[grams] = True
                total += seen
                rows += 1
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(total[found], rows))], names=["bucket", "docs"]
    )


@lean
def _features(batches):
    """(lang, shard, text) to (lang, shard, features, shares)."""
    import pyarrow as pa

    for batch in pieces(batches):
        langs, shards, at, shares = [], [], [], []
        for lang, shard, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not has_letter(text):
                continue
            counts = np.zeros(BUCKETS, np.int64)
            for grams in gram_slices(text):
                counts += np.bincount(grams, minlength=BUCKETS)
            found = np.flatnonzero(counts)
            langs.append(lang)
            shards.append(shard)
            at.append(found.astype(np.int32))
            shares.append(counts[found] / counts.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.string()),
                pa.array(shards, pa.int32()),
                pa.array(at, pa.list_(pa.int32())),
                pa.array(shares, pa.list_(pa.float64())),
            ],
            names=["lang", "shard", "at", "share"],
        )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> LanguageModel:
    """Learn from the labelled rows that are not held out."""
    spark = docs.sparkSession
    context = spark.sparkContext
    scratch = Scratch(spark, "langid")
    named = docs.select(docs[doc_id].alias("key"), docs[text].cast("string").alias("body"), docs[lang].cast("string").alias("lang"))
    learn = named.where(F.col("key").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("key")))
    counts = scratch.write(learn.groupBy("lang").agg(F.count("*").alias("rows")), "counts")
    if counts.count() <= SENT_LANGUAGES:  # then the rows are drawn where they are read, before any exchange
        counts = F.broadcast(counts)
    frequency = (
        learn.select("body").mapInArrow(_frequencies, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs"))
    )
    found = {r["bucket"]: r["docs"] for r in frequency.collect()}  # at most one row per feature
    total = found.pop(-1, 0) or 0
    if not total:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    seen = np.zeros(BUCKETS)
    seen[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + seen)) + 1

    share = F.lit(float(rows_per_language)) / F.col("rows")
    # drawn row by row, so that many copies of one text do not enter or stay out together
    lot = lambda seed, size: F.pmod(F.xxhash64(F.lit(seed), "key", "body"), F.lit(size))
    drawn = lot(0, 1 << 30) < share * F.lit(float(1 << 30))
    sample = scratch.write(
        learn.join(counts, "lang")
        .where(drawn)
        .select("lang", lot(1, SHARDS + 1).cast("int").alias("shard"), "body")
        .mapInArrow(_features, "lang string, shard int, at array<int>, share array<double>"),
        "sample",
    )
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    number = {name: i for i, name in enumerate(languages)}
    size = len(languages)

    def examples(pdf):
        for row in pdf.itertuples(index=False):
            at = np.append(np.asarray(row.at, np.int64), BUCKETS)
            yield number[row.lang], at, np.append(np.asarray(row.share) * idf[at[:-1]] * SCALE, 1.0)

    z, n = np.zeros((BUCKETS + 1, size)), np.zeros((BUCKETS + 1, size))
    fitted = sample.where(F.col("shard") < SHARDS)
    def one_pass(state):
        def run(pdf):
            import pandas as pd

            own_z, own_n = (a.copy() for a in state.value)
            ordered = pdf.assign(order=[zlib.crc32(np.asarray(a).tobytes()) for a in pdf["share"]])
            ftrl_pass(list(examples(ordered.sort_values(["order", "lang"]))), own_z, own_n)
            return pd.DataFrame({"z": [own_z.tobytes()], "n": [own_n.tobytes()]})

        return run

    for _ in range(ROUNDS):
        state = context.broadcast((z, n))  # features x languages, whatever the number of rows
        states = fitted.groupBy("shard").applyInPandas(one_pass(state), "z binary, n binary").collect()  # one row per shard
        if not states:
            break
        z = np.mean([np.frombuffer(bytes(r["z"])).reshape(z.shape) for r in states], axis=0)
        n = np.mean([np.frombuffer(bytes(r["n"])).reshape(n.shape) for r in states], axis=0)
        state.unpersist()
    w = ftrl_weights(z, n)
    weights, bias = w[:-1] * idf[:, None] * SCALE, w[-1]

    model = context.broadcast((weights, bias))

    def logits(batches):
        import pandas as pd

        for pdf in batches:
            rows = [
                (number[r.lang], (np.asarray(r.share) @ model.value[0][np.asarray(r.at, np.int64)] + model.value[1]).tolist())
                for r in pdf.itertuples(index=False)
            ]
            yield pd.DataFrame(rows, columns=["label", "logits"])

    kept = sample.where(F.col("shard") == SHARDS).mapInPandas(logits, "label int, logits array<double>")
    rows = [(r["label"], r["logits"]) for r in kept.collect()]  # a fifth of the bounded sample
    scratch.drop("sample", "counts")
    return LanguageModel(languages, weights, bias, temperature([a for a, _ in rows], [b for _, b in rows]))


def temperature(labels: list[int], logits: list[list[float]]) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not labels:
        return 1.0
    x, y = np.array(logits), np.array(labels)

    def loss(log_t: float) -> float:
        return -float(np.log(np.maximum(softmax(x / np.exp(log_t))[np.arange(len(y)), y], 1e-300)).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``score`` from whole texts; row-local."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def identify(texts):
        import pandas as pd

        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    found = identify(F.col(text).cast("string"))
    return docs.withColumn("_found", found).select(*docs.columns, "_found.lang_pred", "_found.score")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **settings) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    model = fit(docs, doc_id, text, lang, **settings)
    narrow = docs.select(docs[doc_id].alias(doc_id), docs[text].alias("body"))
    return predict(narrow, model, "body").select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "lang_pred", "score")
