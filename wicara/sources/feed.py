"""Selection of public posts from a landed feed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicara.functions.columns import string_array
from wicara.functions.text import WORD
from wicara.functions.wordlists import FEED_HASHTAGS, FEED_LANG


def hashtags_of(text: Column | str) -> Column:
    """Lower-cased hashtags written in the text, without the sign."""
    value = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(f"#([{WORD}]+)"), F.lit(1))


def select_posts(
    posts: DataFrame,
    tags: Iterable[str] = FEED_HASHTAGS,
    lang: str = FEED_LANG,
    hashtags: Column | None = None,
) -> DataFrame:
    """Original posts in ``lang`` that carry one of ``tags`` and some text."""
    found = hashtags if hashtags is not None else F.transform(F.col("hashtags"), F.lower)
    keep = (
        (F.col("lang") == lang)
        & F.arrays_overlap(found, string_array([t.lower() for t in tags]))
        & (F.coalesce(F.col("text"), F.lit("")) != "")
    )
    if "is_retweet" in posts.columns:
        keep = keep & ~F.coalesce(F.col("is_retweet"), F.lit(False))
    return posts.filter(keep)


def latest_posts(posts: DataFrame, order: list[Column], max_results: int = 10) -> DataFrame:
    """At most ``max_results`` posts, as the feed request asks for."""
    return posts.orderBy(*order).limit(max_results)
