"""Declared input schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wicara.functions.wordlists import CATEGORY_COLUMNS

COMMENTS = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("is_noise_or_spam_text", T.IntegerType()),
        T.StructField("toxicity", T.IntegerType()),
        T.StructField("topic", T.StringType()),
        *[T.StructField(name, T.IntegerType()) for name in CATEGORY_COLUMNS],
        T.StructField("initial_paragraph", T.StringType()),
    ]
)

LEXICON_ENTRY = T.StructType(
    [T.StructField("expression", T.StringType()), T.StructField("region", T.StringType())]
)

NUMBER_ENTRY = T.StructType(
    [
        T.StructField("number", T.StringType()),
        T.StructField("meaning", T.StringType()),
        T.StructField("meaning_status", T.StringType()),
        T.StructField("review_status", T.StringType()),
        T.StructField("source_ids", T.ArrayType(T.StringType())),
    ]
)

POSTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("hashtags", T.ArrayType(T.StringType())),
        T.StructField("is_retweet", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

ANNOTATORS = T.StructType(
    [
        T.StructField("annotator_id", T.IntegerType()),
        T.StructField("ethnicity", T.StringType()),
        T.StructField("religion", T.StringType()),
        T.StructField("disability", T.StringType()),
        T.StructField("lgbt", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("domisili", T.StringType()),
        T.StructField("pendidikan terakhir", T.StringType()),
        T.StructField("status pekerjaan", T.StringType()),
        T.StructField("president vote leaning", T.StringType()),
    ]
)


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise ValueError before any job runs if ``df`` lacks one of ``names``."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
