"""From raw annotated comments to the cleaned modelling table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicara.functions.columns import bind
from wicara.functions.emoji import extract_emojis
from wicara.functions.lists import split_topics
from wicara.functions.text import (
    clean_unicode,
    collapse_repeats,
    is_blank,
    remove_stopwords,
    slang_normalize,
)
from wicara.functions.wordlists import SLANG_MAP
from wicara.operators.labels import fit_labels, multi_hot
from wicara.operators.quality import conflict_rows, drop_blank, drop_spam, keep_first_consistent
from wicara.operators.stemming import stem_by_dictionary, stem_texts
from wicara.schemas import require_columns


def usable_rows(df: DataFrame, text: str = "text", spam: str = "is_noise_or_spam_text") -> DataFrame:
    return drop_blank(drop_spam(df, spam), text)


def conflict_report(df: DataFrame, row_id: str, text: str = "text", label: str = "toxicity") -> DataFrame:
    """Usable rows whose text carries more than one label, for documentation."""
    return conflict_rows(usable_rows(df, text), text, label, row_id)


def distinct_comments(
    df: DataFrame, row_id: str, text: str = "text", label: str = "toxicity"
) -> DataFrame:
    """Usable rows without label conflicts, one per text."""
    return keep_first_consistent(usable_rows(df, text), text, label, row_id)


def derive_columns(
    df: DataFrame,
    text: str = "text",
    topic: str | None = "topic",
    slang: Mapping[str, str] = SLANG_MAP,
    drop_empty: bool = False,
) -> DataFrame:
    """Append emoji, cleaned text and topic list inside the row.

    ``drop_empty`` leaves out rows whose text cleans to nothing.
    """
    derived = bind(
        df.withColumn("emoji", extract_emojis(text)),
        "text_clean",
        slang_normalize(collapse_repeats(clean_unicode(text)), slang),
        (lambda cleaned: ~is_blank(cleaned)) if drop_empty else None,
    )
    return derived.withColumn("topic_list", split_topics(topic)) if topic else derived


def topic_encoder(df: DataFrame, topic: str = "topic") -> list[str]:
    """The fitted topic encoder: all topics of a table, in the order of their indicator columns."""
    return fit_labels(df.select(split_topics(topic).alias("topics")), "topics")


def process_text(
    df: DataFrame,
    row_id: str,
    stopwords: Iterable[str] | None = None,
    stems: DataFrame | None = None,
    encode_topic: bool | Sequence[str] = False,
    roots: DataFrame | None = None,
) -> DataFrame:
    """Append ``text_processed`` and, on request, the topic indicators.

    Stop-word removal and stemming are skipped where their word list, dictionary or roots are not
    given. ``stems`` is a finished dictionary (token, stem); ``roots`` (root) lets the affix rules find
    the stems.
    ``encode_topic`` may be the labels of an earlier table (``topic_encoder``): new data then gets
    the same columns.
    """
    require_columns(df, "text_clean")
    processed = F.coalesce("text_clean", F.lit(""))
    if stopwords is not None:
        processed = remove_stopwords(processed, stopwords)
    result = df.withColumn("text_processed", processed)
    if stems is not None:
        result = stem_by_dictionary(result, "text_processed", row_id, stems)
    if roots is not None:
        result = stem_texts(result, "text_processed", row_id, roots)
    if encode_topic:
        require_columns(df, "topic")
        known = None if encode_topic is True else list(encode_topic)
        result = multi_hot(result.withColumn("topic_list", split_topics("topic")), "topic_list", known)
    return result


def preprocess(
    df: DataFrame,
    row_id: str,
    stopwords: Iterable[str] | None = None,
    stems: DataFrame | None = None,
    encode_topic: bool | Sequence[str] = False,
    slang: Mapping[str, str] = SLANG_MAP,
    roots: DataFrame | None = None,
) -> DataFrame:
    """All steps; rows that clean to nothing leave before the text is processed further."""
    cleaned = derive_columns(distinct_comments(df, row_id), slang=slang, drop_empty=True)
    return process_text(cleaned, row_id, stopwords, stems, encode_topic, roots)
