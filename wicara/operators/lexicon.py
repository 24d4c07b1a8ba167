"""Profanity lexicon: grouping, exact word and phrase matching, rule features and report."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicara.functions.columns import bind, constant, keep_words, let, word_positions, words
from wicara.functions.rules import join_expressions, join_regions, toxic_label
from wicara.functions.text import clean_ascii
from wicara.functions.wordlists import PROFANITY
from wicara.operators.trie import trie_matcher
from wicara.session import cut_lineage

FIRST_WORDS = 100_000  # words that start a phrase, sent to every task
MATCHES = "array<struct<expression:string,regions:array<string>>>"

Expressions = Sequence[tuple[str, Sequence[str]]]


def default_lexicon(spark: SparkSession) -> DataFrame:
    """The built-in (expression, region) list with its order in ``position``."""
    return lexicon_frame(spark, PROFANITY)


def lexicon_frame(spark: SparkSession, entries: Iterable[tuple[str, str]]) -> DataFrame:
    rows = [(position, expression, region) for position, (expression, region) in enumerate(entries)]
    return spark.createDataFrame(rows, "position long, expression string, region string")


def group_lexicon(entries: DataFrame) -> DataFrame:
    """Clean expressions, drop empty ones and collect the sorted regions of each.

    ``position`` becomes the first position of the expression: matches are reported in it.
    """
    return (
        entries.select(
            clean_ascii("expression").alias("expression"),
            F.when(F.col("region") != "", F.col("region")).alias("region"),
            "position",
        )
        .filter(F.col("expression") != "")
        .groupBy("expression")
        .agg(
            F.sort_array(F.collect_set("region")).alias("regions"),
            F.min("position").alias("position"),
        )
    )


@dataclass
class Lexicon:
    """A grouped lexicon of any size.

    Lexicons of at most ``inline_limit`` expressions are matched by column functions, those of at most
    ``trie_limit`` expressions by a trie sent to the workers; both stay inside the row and also work
    on a stream. Larger ones are joined. The matches are the same.
    """

    grouped: DataFrame
    inline_limit: int = 2_000
    trie_limit: int = 200_000

    @classmethod
    def of(cls, entries: DataFrame | Lexicon, inline_limit: int = 2_000, trie_limit: int = 200_000) -> Lexicon:
        """The lexicon of (expression, region, position) rows."""
        return entries if isinstance(entries, Lexicon) else cls(group_lexicon(entries), inline_limit, trie_limit)

    @cached_property
    def size(self) -> int:
        """Expressions, counted up to one more than a trie may hold."""
        return self.grouped.limit(max(self.inline_limit, self.trie_limit) + 1).count()

    @property
    def small(self) -> bool:
        return self.size <= self.inline_limit

    @property
    def in_row(self) -> bool:
        """Whether matching stays inside the row."""
        return self.small or self.size <= self.trie_limit

    @cached_property
    def expressions(self) -> Expressions:
        """Expressions with their regions, in lexicon order, of a lexicon matched inside the row."""
        if not self.in_row:
            raise ValueError("this lexicon is matched by a join, not inside the row")
        rows = sorted(self.grouped.collect(), key=lambda row: (row["position"], row["expression"]))
        return [(row["expression"], list(row["regions"])) for row in rows]

    @cached_property
    def trie(self):
        """Column function that matches a cleaned text by the trie of the expressions."""
        return trie_matcher(self.grouped.sparkSession, self.expressions)

    def save(self, path: str) -> None:
        self.grouped.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Lexicon:
        return cls(spark.read.parquet(path))


def match_inline(clean: Column, expressions: Expressions) -> Column:
    """Matches of a cleaned text, in lexicon order.

    One pass over the words looks up first words of expressions in a hash set; phrases are built
    and looked up only there, so the cost hardly depends on the size of the lexicon.
    """
    none = F.array().cast(MATCHES)
    if not expressions:
        return none
    phrases = [expression for expression, _ in expressions]
    first_words = sorted({phrase.split(" ")[0] for phrase in phrases})
    sizes = sorted({phrase.count(" ") + 1 for phrase in phrases})
    table = constant([{"expression": e, "regions": list(r)} for e, r in expressions], MATCHES)

    def hits(tokens: Column) -> Column:
        grams = F.transform(
            word_positions(tokens, first_words),
            lambda i: F.array(*[F.array_join(F.slice(tokens, i, n), " ") for n in sizes]),
        )
        return keep_words(F.flatten(grams), phrases)

    def entries(found: Column) -> Column:
        listed = F.filter(table, lambda entry: F.array_contains(found, entry["expression"]))
        return F.when(F.size(found) > 0, listed).otherwise(none)

    return let(words(clean), lambda tokens: let(hits(tokens), entries))


def lexicon_hits(df: DataFrame, text: str, row_id: str, grouped: DataFrame, out: str = "matches") -> DataFrame:
    """(row_id, matches) of the rows with a match, for a lexicon of any size.

    The distinct words of each text are joined with the expressions of one word; of the longer
    n-grams, only those that start as an expression does are spelled out, if at most ``FIRST_WORDS``
    words start one. Texts themselves are not moved.
    """
    entries = grouped.withColumn("_n", F.size(F.split("expression", " ")))
    sizes = sorted(row["_n"] for row in entries.select("_n").distinct().collect())  # phrase lengths
    clean = bind(df.select(row_id, text), "_clean", clean_ascii(text)).where("_clean <> ''")
    tokens = clean.select(row_id, F.split("_clean", " ").alias("_words"))

    # plain rows, joins and hash aggregation: all of it runs as generated code
    found = []
    if 1 in sizes:
        found.append(tokens.select(row_id, F.explode(F.array_distinct("_words")).alias("expression")))
    if longer := [n for n in sizes if n > 1]:
        phrases = entries.where("_n > 1")
        places = tokens.select(row_id, "_words", F.posexplode("_words").alias("_at", "_first"))
        starts = phrases.groupBy(F.substring_index("expression", " ", 1).alias("_first")).agg(
            F.collect_set("_n").alias("_sizes")
        )
        if starts.limit(FIRST_WORDS + 1).count() <= FIRST_WORDS:
            pairs = places.join(F.broadcast(starts), "_first")
        else:  # every place may start an expression of every length
            pairs = places.withColumn("_sizes", F.array(*[F.lit(n) for n in longer]))
        pairs = pairs.select(row_id, "_words", "_at", F.explode("_sizes").alias("_n"))
        spelled = F.array_join(F.slice("_words", F.col("_at") + 1, F.col("_n")), " ")
        grams = pairs.where(F.col("_at") + F.col("_n") <= F.size("_words")).select(row_id, spelled.alias("expression"))
        found.append(grams.join(phrases.select("expression"), "expression", "left_semi").select(row_id, "expression").distinct())
    if not found:
        found.append(tokens.select(row_id, F.lit("").alias("expression")))
    hits = reduce(DataFrame.union, found).join(grouped, "expression")
    return hits.groupBy(row_id).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "expression", "regions"))),
            lambda m: F.struct(m["expression"].alias("expression"), m["regions"].alias("regions")),
        ).alias(out)
    )


def match_joined(df: DataFrame, text: str, row_id: str, grouped: DataFrame, out: str) -> DataFrame:
    """Append the matches of a lexicon of any size; they return to their row by its unique id."""
    per_row = cut_lineage(lexicon_hits(df, text, row_id, grouped, out))
    return df.join(per_row, row_id, "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast(MATCHES))
    )


def lexicon_matches(
    df: DataFrame, text: str, lexicon: DataFrame | Lexicon, row_id: str, out: str = "matches"
) -> DataFrame:
    """Append the matched expressions with their regions, in lexicon order.

    ``row_id`` is the unique id of a row.
    """
    lexicon = Lexicon.of(lexicon)
    if lexicon.small:
        return bind(df, out, match_inline(clean_ascii(text), lexicon.expressions))
    if lexicon.in_row:
        return df.withColumn(out, lexicon.trie(clean_ascii(text)))
    return match_joined(df, text, row_id, lexicon.grouped, out)


def lexicon_rule(
    df: DataFrame, text: str, lexicon: DataFrame | Lexicon, row_id: str, out: str = "rule"
) -> DataFrame:
    """Append ``struct(toxic, label, matches)``: toxic as soon as one expression matches."""
    matched = lexicon_matches(df, text, lexicon, row_id, "_matches")
    hit = F.size("_matches") > 0
    return matched.withColumn(
        out,
        F.struct(hit.alias("toxic"), toxic_label(hit).alias("label"), F.col("_matches").alias("matches")),
    ).drop("_matches")


def rule_features(matches: Column | str) -> list[Column]:
    """Hit flag and number of matched expressions."""
    column = F.col(matches) if isinstance(matches, str) else matches
    size = F.size(column)
    return [(size > 0).cast("int").alias("rule_hit"), size.alias("rule_count")]


def rule_report(df: DataFrame, matches: str = "matches") -> DataFrame:
    """Readable rule outcome: label, matched expressions and the union of their regions."""
    return df.select(
        "*",
        toxic_label(F.size(matches) > 0).alias("rule_toxicity"),
        join_expressions(matches).alias("matched_expressions"),
        join_regions(matches).alias("matched_regions"),
    )
