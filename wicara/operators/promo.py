"""Gambling-promotion pattern: configured term followed by a 2-3 digit number."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicara.functions.columns import bind
from wicara.functions.rules import join_meanings, join_patterns
from wicara.functions.text import clean_ascii
from wicara.functions.wordlists import GAMBLING_TERMS

MEANINGS = "array<struct<meaning:string,meaning_status:string,source_ids:array<string>>>"


def _clean_term(term: str) -> str:
    return re.sub("[^a-z0-9]+", " ", term.lower()).strip()


def prefix_alternatives(terms: Iterable[str]) -> str:
    """Regex alternatives of the cleaned terms, longest first."""
    cleaned = {_clean_term(term) for term in terms} - {""}
    if not cleaned:
        raise ValueError("no prefix term left after cleaning")
    # Cleaned terms are letters, digits and blanks: nothing to escape.
    return "|".join(sorted(cleaned, key=lambda term: (-len(term), term)))


def find_promotions(text: Column | str, terms: Iterable[str] = GAMBLING_TERMS) -> Column:
    """All non-overlapping ``struct(term, number)`` matches of the cleaned text.

    The text is scanned once; term and number are then read from the short matches.
    """
    alternatives = prefix_alternatives(terms)
    found = F.regexp_extract_all(
        clean_ascii(text),
        F.lit(rf"(?<![a-z0-9])(?:{alternatives})\s*[0-9]{{2,3}}(?![0-9])"),
        F.lit(0),
    )
    parts = rf"^({alternatives})\s*([0-9]{{2,3}})$"
    return F.transform(
        found,
        lambda m: F.struct(
            F.regexp_extract(m, parts, 1).alias("term"),
            F.regexp_extract(m, parts, 2).alias("number"),
        ),
    )


def verified_numbers(entries: DataFrame) -> DataFrame:
    """Reviewed meanings per number: 2-3 digits, a meaning, status ``verified``."""
    usable = entries.filter(
        F.col("number").rlike(r"\A[0-9]{2,3}\z")
        & (F.coalesce(F.col("meaning"), F.lit("")) != "")
        & (F.col("review_status") == "verified")
    )
    meaning = F.struct(
        F.col("meaning"),
        F.coalesce("meaning_status", F.lit("unknown")).alias("meaning_status"),
        F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"),
    )
    ordered = F.struct(F.col("position"), meaning.alias("m"))
    return usable.groupBy("number").agg(
        F.transform(F.array_sort(F.collect_list(ordered)), lambda e: e["m"])
        .cast(MEANINGS)
        .alias("meanings")
    )


def with_promotions(
    df: DataFrame, text: str, terms: Iterable[str] = GAMBLING_TERMS, out: str = "promotions"
) -> DataFrame:
    return bind(df, out, find_promotions(text, terms))


def promo_label(matches: Column | str) -> Column:
    return F.when(F.size(matches) > 0, F.lit("suspected_gambling_promo")).otherwise(
        F.lit("no_pattern")
    )


def with_meanings(
    df: DataFrame, row_id: str, numbers: DataFrame | None, matches: str = "promotions"
) -> DataFrame:
    """Add the verified meanings to each match; unknown numbers get an empty list.

    Only matches enter the join with the reference; they return to their row by its unique id.
    """
    none = F.array().cast(MEANINGS)
    if numbers is None:
        return df.withColumn(
            matches,
            F.transform(
                matches,
                lambda m: F.struct(m["term"].alias("term"), m["number"].alias("number"), none.alias("meanings")),
            ),
        )
    exploded = df.filter(F.size(matches) > 0).select(
        row_id, F.posexplode(matches).alias("_pos", "_match")
    ).select(row_id, "_pos", F.col("_match.term").alias("_term"), F.col("_match.number").alias("number"))
    joined = exploded.join(numbers, "number", "left")
    entry = F.struct(
        F.col("_pos"),
        F.col("_term").alias("term"),
        F.col("number"),
        F.coalesce("meanings", none).alias("meanings"),
    )
    per_row = joined.groupBy(row_id).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    kind = f"array<struct<term:string,number:string,meanings:{MEANINGS}>>"
    restored = F.transform(
        "_entries",
        lambda e: F.struct(
            e["term"].alias("term"), e["number"].alias("number"), e["meanings"].alias("meanings")
        ),
    )
    return (
        df.join(per_row, row_id, "left")
        .withColumn(matches, F.coalesce(restored, F.array().cast(kind)))
        .drop("_entries")
    )


def promo_report(df: DataFrame, matches: str = "promotions") -> DataFrame:
    """Readable outcome of the pattern; ``matches`` carry their meanings."""
    return df.select(
        "*",
        (F.size(matches) > 0).alias("suspected_gambling_promo"),
        join_patterns(matches).alias("matched_patterns"),
        join_meanings(matches).alias("verified_number_meanings"),
    )
