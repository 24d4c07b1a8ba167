"""Registration of queries and inputs derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicara.functions.wordlists import PROFANITY
from wicara.sources.files import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Words of the test texts that stand in for the lists a user would pass.
TOXIC_WORDS = (
    "trash", "clown", "idiot", "scum", "worthless", "moron", "pathetic", "loser", "stupid",
    "disgusting",
)
ENTRIES = (
    *PROFANITY,
    *[(word, "Test") for word in TOXIC_WORDS],
    ("Clown", "Stage"),
    ("and the", "Phrase"),
    ("de la", "Phrase"),
    ("of  the!", "Phrase"),
    ("of the", ""),
    ("!?", "Nowhere"),
)
PROMO_TERMS = ("the", "token", "den")
STOPWORDS = ("the", "and", "of", "de", "la", "und", "die", "que", "el", "des")
SLANG = {"the": "that one", "and": "und", "of": "and", "el": "le", "ga": "tidak", "der": "die/das"}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL of the same result."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents; ``spark.wicara.inputPartitions`` may deal small inputs to more tasks."""
    tasks = spark.conf.get("spark.wicara.inputPartitions", None)
    return read_table(spark, folder, "documents", int(tasks) if tasks else None)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated documents."""
    labels = read_table(spark, folder, "labels")
    return documents(spark, folder).join(labels, "doc_id")


def comments(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in the shape of the comment table; unlabelled ones count as clean."""
    labels = read_table(spark, folder, "labels")
    return (
        documents(spark, folder)
        .join(labels, "doc_id", "left")
        .select(
            "doc_id",
            "text",
            (1 - F.coalesce("quality", F.lit(1))).alias("is_noise_or_spam_text"),
            F.col("toxic").alias("toxicity"),
            topics().alias("topic"),
        )
    )


def topics() -> Column:
    """Comma string with stray blanks and empty items, as annotators leave them."""
    return F.concat(
        F.col("lang"),
        F.lit(", "),
        F.col("source"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(",, long ")).otherwise(F.lit(",")),
    )


TOPICS_SQL = "lang || ', ' || source || case when doc_id % 3 = 0 then ',, long ' else ',' end"
COMMENTS_SQL = f"""
select d.doc_id, d.text, 1 - coalesce(l.quality, 1) as is_noise_or_spam_text, l.toxic as toxicity,
  {TOPICS_SQL.replace('doc_id', 'd.doc_id')} as topic
from documents d left join labels l on d.doc_id = l.doc_id
"""


# --- SQL spelling of the text functions, for an engine without look-around and back-references ---


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def sql_map(mapping) -> str:
    return "map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in mapping.items()) + "}"


def ascii_sql(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g'))"


def words_sql(clean: str) -> str:
    return f"list_filter(string_split({clean}, ' '), lambda w: w <> '')"


def mapped_sql(tokens: str, mapping) -> str:
    return f"list_transform({tokens}, lambda w: coalesce({sql_map(mapping)}[w], w))"


def collapse_sql(chars: str) -> str:
    """Collapse of a character list: drop a character that continues a run of three or more."""
    return (
        f"array_to_string(list_filter({chars}, lambda c, i: c = chr(10) or not (i > 1 "
        f"and coalesce({chars}[i - 1] = c, false) "
        f"and (coalesce(i > 2 and {chars}[i - 2] = c, false) or coalesce({chars}[i + 1] = c, false)))), '')"
    )


def lexicon_sql(entries=ENTRIES) -> str:
    """Grouped lexicon ``(expression, regions, position)``."""
    values = ", ".join(f"({i}, {quoted(e)}, {quoted(r)})" for i, (e, r) in enumerate(entries))
    return (
        f"select {ascii_sql('e')} as expression, min(p) as position, "
        "coalesce(list_sort(list(distinct r) filter (where r <> '')), []) as regions "
        f"from (values {values}) t(p, e, r) where {ascii_sql('e')} <> '' group by 1"
    )


def hits_sql(source: str = "documents", row_id: str = "doc_id", text: str = "text") -> str:
    """One row per (document, matched expression)."""
    return (
        f"select d.{row_id}, x.position, x.expression, x.regions from "
        f"(select {row_id}, ' ' || {ascii_sql(text)} || ' ' as padded from {source}) d, "
        f"({lexicon_sql()}) x where contains(d.padded, ' ' || x.expression || ' ')"
    )
