"""Personal data by fixed forms and bootstrapped contextual extraction.

Entities of four fixed forms are found in every text and seed the extraction: the two words before
an entity form a lexical pattern. Other identifier-like strings (with a digit or an at sign) in the
same place are candidates. Patterns and instances form a graph scored for ``ROUNDS`` rounds: a
pattern is as reliable as the share of its distinct instances believed in, an instance as the
chance that not all its patterns err. Candidates of reliable patterns become spans of the kind of
their pattern; the fixed-form spans always stay.

Offsets count code points, ends are exclusive. Defined results: null texts are empty; rows with an
equal id and an equal text get the same spans; each row is returned. Columns other than id and text
are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicara.llm.common import Scratch, lean, pieces

KINDS = ("email", "ip", "card", "phone")
LEAST_SEEDS = 5  # distinct seeds a pattern needs
PATTERN_SCORE = 0.8
INSTANCE_SCORE = 0.8
ROUNDS = 3
LOOK_BACK = 200  # characters searched for the two words of a pattern

# An address is looked for from its at sign, so long runs without one cost nothing.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A run of digits that failed from its start fails from inside as well: only starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# A run without blank or separator is tried once, from its start, and read once.
_APART = r"\s\"'<>()\[\]{},;:=|"
_CANDIDATE = re.compile(rf"(?<![^{_APART}])[^{_APART}0-9@]*+[0-9@][^{_APART}]*+")
_WORD = re.compile(r"[^\W\d_]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, floor = [], 0
    if "@" not in text:
        return out
    for match in _DOMAIN.finditer(text):
        start = match.start()
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        if start < match.start():
            out.append((start, match.end()))
            floor = match.end()
    return out


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed forms, by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    for match in _IP.finditer(text):
        parts = match.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts):
            out.append((match.start(), 1, match.end()))
    for match in _CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((match.start(), 2, match.end()))
    for match in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", match.group())) <= 15:
            out.append((match.start(), 3, match.end()))
    return sorted(out)


def pattern_before(text: str, start: int) -> str | None:
    """The two words before a place, lower-cased, with what stands between; None without two words."""
    window = text[max(0, start - LOOK_BACK) : start]
    words = list(_WORD.finditer(window))
    if len(words) < 2 or _NOT_DIGIT.sub("", window[words[-2].start() :]):
        return None
    return re.sub(r"\s+", " ", window[words[-2].start() :].lower())


def _overlaps(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    return any(s < end and start < e for s, _, e in spans)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings of five signs or more that touch no fixed form."""
    out, at = [], 0
    for match in _CANDIDATE.finditer(text):
        start, end = match.span()
        while end > start and text[end - 1] in ".!?":
            end -= 1
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        if end - start >= 5 and not _overlaps(start, end, spans[max(at - 3, 0) : at + 4]):
            out.append((start, end))
    return out


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


@lean
def _scan(batches):
    """(key, text) to counts, fixed spans and the pattern occurrences of a row."""
    import pyarrow as pa

    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    use = pa.list_(
        pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    )
    for batch in pieces(batches):
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            spans = fixed_spans(text)
            uses = []
            for s, k, e in spans:
                if pattern := pattern_before(text, s):
                    uses.append((pattern, hashlib.md5(text[s:e].lower().encode()).hexdigest(), s, k, e))
            for s, e in candidates(text, spans):
                if pattern := pattern_before(text, s):
                    uses.append((pattern, hashlib.md5(text[s:e].lower().encode()).hexdigest(), s, -1, e))
            found = shown(spans)
            counts = [sum(1 for x in spans if x[1] == k) for k in range(4)]
            rows.append(
                (
                    *counts,
                    hashlib.sha256(found.encode()).hexdigest(),
                    [{"start": s, "kind": k, "end": e} for s, k, e in spans],
                    [{"pattern": p, "instance": i, "start": s, "kind": k, "end": e} for p, i, s, k, e in uses],
                )
            )
        kinds = [pa.int64()] * 4 + [pa.string(), span, use]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
            names=["key", "mark", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "uses"],
        )


_SCANNED = (
    "key long, mark long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<start:long,kind:int,end:long>>, "
    "uses array<struct<pattern:string,instance:string,start:long,kind:int,end:long>>"
)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fixed forms and pattern occurrences of every row; ``mark`` tells the texts of one id apart."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    narrow = docs.select(docs[doc_id].cast("long").alias("key"), body.alias("body"), F.xxhash64(body).alias("mark"))
    return narrow.mapInArrow(_scan, _SCANNED)


def induce(
    scratch: Scratch,
    scanned: DataFrame,
    least_seeds: int = LEAST_SEEDS,
    pattern_score: float = PATTERN_SCORE,
    instance_score: float = INSTANCE_SCORE,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns (pattern, kind, score) and accepted instances (pattern, kind, instance)."""
    uses = scanned.select(F.explode("uses").alias("use")).select("use.pattern", "use.instance", "use.kind")
    seeded = (
        uses.where("kind >= 0")
        .distinct()
        .groupBy("pattern", "kind")
        .agg(F.count("*").alias("seeds"))
        .where(F.col("seeds") >= least_seeds)
    )
    # a pattern stands for the kind most of its seeds have
    patterns = scratch.write(
        seeded.groupBy("pattern").agg(F.max(F.struct("seeds", -F.col("kind"))).alias("most")).select(
            "pattern", (-F.col("most.col2")).alias("kind")
        ),
        "patterns",
    )
    edges = scratch.write(
        uses.groupBy("pattern", "instance")
        .agg(F.max("kind").alias("known"))
        .join(patterns, "pattern")
        .select("pattern", "kind", "instance", (F.col("known") == F.col("kind")).alias("seed")),
        "edges",
    )
    belief = edges.groupBy("instance", "kind").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    for turn in range(rounds):
        score = (
            edges.join(belief, ["instance", "kind"])
            .groupBy("pattern", "kind")
            .agg((F.sum("belief") / F.count("*")).alias("score"))
        )
        score = scratch.write(score, f"score_{turn}")
        err = F.when(F.max(F.col("seed").cast("int")) == 1, 0.0).otherwise(
            F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        )
        belief = scratch.write(
            edges.join(score, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - err).alias("belief")), f"belief_{turn}"
        )
    accepted = score.where(F.col("score") >= pattern_score)
    found = (
        edges.where("not seed")
        .join(accepted, ["pattern", "kind"], "left_semi")
        .join(belief.where(F.col("belief") >= instance_score), ["instance", "kind"], "left_semi")
        .select("pattern", "kind", "instance")
    )
    return accepted, scratch.write(found, "found")


def extra_spans(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """(key, mark, extra): spans of accepted candidates, one row per text that has any."""
    uses = scanned.select("key", "mark", F.explode(F.filter("uses", lambda u: u["kind"] < 0)).alias("use")).select(
        "key", "mark", "use.pattern", "use.instance", "use.start", "use.end"
    )
    hits = uses.join(found, ["pattern", "instance"]).groupBy("key", "mark", "start", "end").agg(F.min("kind").alias("kind"))
    return hits.groupBy("key", "mark").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Counts of the fixed forms, the digest of their spans, and all spans, per row."""
    scratch = Scratch(docs.sparkSession, "pii")
    scanned = scratch.write(scan(docs, doc_id, text), "scanned")
    _, found = induce(scratch, scanned, **settings)
    extra = extra_spans(scanned, found).withColumnsRenamed({"key": "_key", "mark": "_mark"})
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("mark") == F.col("_mark"))
    spans = F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:long,kind:int,end:long>>")))
    return scratch.finish(
        scanned.join(extra, same, "left").select(
            F.col("key").alias(doc_id),
            *(f"n_{k}" for k in KINDS),
            "base_sha256",
            _listed(spans).alias("spans"),
            F.coalesce(F.size("extra"), F.lit(0)).alias("n_found"),
        )
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
        elif e > at:  # overlaps the span before: swallowed by it
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by its kind; other columns as they are."""
    scratch = Scratch(docs.sparkSession, "redact")
    scanned = scratch.write(scan(docs, doc_id, text), "scanned")
    _, found = induce(scratch, scanned, **settings)
    extra = scratch.write(extra_spans(scanned, found), "extra").withColumnsRenamed({"key": "_key", "mark": "_mark", "extra": "_extra"})

    @F.pandas_udf("string")
    def hide(texts, extras):
        import pandas as pd

        out = []
        for body, more in zip(texts, extras, strict=True):
            if body is None:
                out.append(None)
                continue
            spans = fixed_spans(body) + [(x["start"], x["kind"], x["end"]) for x in (more if more is not None else [])]
            out.append(masked(body, spans) if spans else body)
        return pd.Series(out, dtype=object)

    body = docs[text].cast("string")
    same = docs[doc_id].cast("long").eqNullSafe(extra["_key"]) & (F.xxhash64(F.coalesce(body, F.lit(""))) == extra["_mark"])
    joined = docs.join(extra, same, "left")
    return joined.withColumn("_hidden", hide(body, F.col("_extra"))).select(
        *[F.col("_hidden").alias(c) if c == text else docs[c] for c in docs.columns]
    )
