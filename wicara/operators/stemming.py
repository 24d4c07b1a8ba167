"""Stemming: confix stripping of distinct tokens against a table of roots, and texts through a dictionary."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wicara.functions.columns import words
from wicara.operators.affixes import PREFIXES, Prefix, with_candidates
from wicara.session import cut_lineage


def distinct_tokens(df: DataFrame, text: str) -> DataFrame:
    """Distinct words of all texts, the input of a stemmer."""
    return df.select(F.explode(words(text)).alias("token")).distinct()


def build_dictionary(tokens: DataFrame, stemmer: Callable[[str], str]) -> DataFrame:
    """Apply a user's word stemmer to distinct tokens; unchanged tokens need no entry."""

    @pandas_udf("string")
    def stem(batch: pd.Series) -> pd.Series:
        return batch.map(stemmer)

    return tokens.select("token", stem("token").alias("stem")).filter(F.col("token") != F.col("stem"))


def stem_tokens(
    tokens: DataFrame, roots: DataFrame, token: str = "token", root: str = "root", rules: Sequence[Prefix] = PREFIXES
) -> DataFrame:
    """(token, stem) of each distinct token: the first of its stripped forms that is a root.

    Tokens none of whose forms is a root are their own stems. All forms of a token meet the roots in
    one join, whatever the size of either side; the earliest hit is found by partial minima.
    """
    distinct = tokens.select(F.col(token).alias("token")).where(F.col(token).isNotNull()).distinct()
    forms = with_candidates(distinct, "token", rules).select("token", F.explode("candidates").alias("c"))
    order = F.struct("c.phase", "c.rank", "c.level", "c.r1", "c.r2", "c.r3", F.col("c.word").alias("word"))
    tried = forms.select("token", "c.word", order.alias("key"))
    known = roots.select(F.col(root).alias("word")).where(F.col(root).isNotNull()).distinct().withColumn("known", F.lit(True))
    hits = tried.join(known, "word", "left").groupBy("token").agg(F.min(F.when(F.col("known"), F.col("key"))).alias("key"))
    return hits.select("token", F.coalesce("key.word", "token").alias("stem"))


def stem_texts(
    df: DataFrame, text: str, row_id: str, roots: DataFrame, out: str = "text_processed", root: str = "root"
) -> DataFrame:
    """Replace each word of a text by its root; words without one stay as they are."""
    dictionary = cut_lineage(stem_tokens(distinct_tokens(df, text), roots, root=root).where("token <> stem"))
    return stem_by_dictionary(df, text, row_id, dictionary, out)


def stem_by_dictionary(
    df: DataFrame, text: str, row_id: str, dictionary: DataFrame, out: str = "text_processed"
) -> DataFrame:
    """Replace each word by its stem; words without an entry stay as they are.

    Words meet the dictionary in a join; only those with a stem return to their row, with their
    place, and are set between the runs of words that stay.
    """
    entries = dictionary.select("token", "stem").filter(F.col("token") != F.col("stem"))
    placed = df.select(row_id, F.posexplode(words(text)).alias("place", "token")).join(entries, "token")
    per_row = cut_lineage(
        placed.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("place", "stem"))).alias("_stems"))
    )
    whole = df.join(per_row, row_id, "left").withColumn("_words", words(text))
    ends = F.transform("_stems", lambda s: s["place"])
    before = F.concat(F.array(F.lit(-1)), F.slice(ends, 1, F.size(ends) - 1))
    runs = F.zip_with(
        "_stems",
        before,
        lambda s, last: F.concat(F.slice("_words", last + 2, s["place"] - last - 1), F.array(s["stem"])),
    )
    last = F.element_at(ends, -1)
    rest = F.slice("_words", last + 2, F.size("_words"))
    changed = F.concat(F.flatten(runs), rest)
    return whole.withColumn(
        out, F.array_join(F.when(F.size("_stems") > 0, changed).otherwise(F.col("_words")), " ")
    ).drop("_stems", "_words")
