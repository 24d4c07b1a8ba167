"""Lexical scores and report formatting."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from wicara.functions.columns import as_col, keep_words, let
from wicara.functions.text import normalized_words, token_set_counts
from wicara.functions.wordlists import (
    KEYWORD_GROUPS,
    METER_SEVERE_BONUS,
    METER_SEVERE_TERMS,
    METER_TERMS,
    METER_TOXIC_FROM,
    PRONOUN_MAP,
)


def toxicity_meter(
    text: Column | str,
    terms: Iterable[str] = METER_TERMS,
    severe: Iterable[str] = METER_SEVERE_TERMS,
    mapping: Mapping[str, str] = PRONOUN_MAP,
) -> Column:
    """Share of offensive tokens, raised when a severe term occurs, in [0, 1] at 4 decimals."""
    terms, severe = list(terms), list(severe)

    def score(tokens: Column) -> Column:
        hits = F.size(keep_words(tokens, terms))
        share = hits.cast("double") / F.greatest(F.size(tokens), F.lit(1))
        raised = F.when(
            F.exists(tokens, lambda w: w.isin(severe)), share + F.lit(METER_SEVERE_BONUS)
        ).otherwise(share)
        return F.bround(F.least(F.lit(1.0), raised), 4)

    return let(normalized_words(text, mapping), score)


def meter_label(score: Column | str) -> Column:
    return F.when(as_col(score) >= METER_TOXIC_FROM, F.lit("toxic")).otherwise(F.lit("non_toxic"))


def keyword_features(
    text: Column | str,
    groups: Mapping[str, Iterable[str]] = KEYWORD_GROUPS,
    mapping: Mapping[str, str] = PRONOUN_MAP,
) -> Column:
    """Distinct keyword hits per mood group, in group order."""
    return token_set_counts(normalized_words(text, mapping), groups.values())


def toxic_label(flag: Column | str) -> Column:
    """0/1 (or boolean) decision -> ``non_toxic`` / ``toxic``."""
    return F.when(as_col(flag).cast("int") == 1, F.lit("toxic")).otherwise(F.lit("non_toxic"))


def or_flags(left: Column | str, right: Column | str) -> Column:
    return F.greatest(as_col(left), as_col(right))


def review_flag(rule: Column | str, primary: Column | str) -> Column:
    """1 where the rule fires and the primary decision does not."""
    return ((as_col(rule) == 1) & (as_col(primary) == 0)).cast("int")


def mood_proxy(toxic: Column | str) -> Column:
    return F.when(as_col(toxic) == 1, F.lit("angry")).otherwise(F.lit("happy"))


def sentiment_proxy(toxic: Column | str) -> Column:
    return F.when(as_col(toxic) == 1, F.lit("negative")).otherwise(F.lit("positive"))


def join_expressions(matches: Column | str) -> Column:
    return F.array_join(F.transform(as_col(matches), lambda m: m["expression"]), ", ")


def join_regions(matches: Column | str) -> Column:
    """Sorted union of the regions of all matched expressions."""
    regions = F.flatten(F.transform(as_col(matches), lambda m: m["regions"]))
    return F.array_join(F.array_sort(F.array_distinct(regions)), ", ")


def join_patterns(matches: Column | str) -> Column:
    return F.array_join(
        F.transform(as_col(matches), lambda m: F.concat_ws(" + ", m["term"], m["number"])), ", "
    )


def join_meanings(matches: Column | str) -> Column:
    """All verified meanings with their status and sources."""
    meanings = F.flatten(F.transform(as_col(matches), lambda m: m["meanings"]))
    return F.array_join(
        F.transform(
            meanings,
            lambda m: F.concat(
                m["meaning"],
                F.lit(" ("),
                m["meaning_status"],
                F.lit("; sources: "),
                F.array_join(m["source_ids"], ", "),
                F.lit(")"),
            ),
        ),
        "; ",
    )
