"""N-gram, vocabulary and TF-IDF queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicara.catalog.base import ascii_sql, documents, hits_sql, labelled, query, words_sql
from wicara.catalog.rules import METER_SQL, METER_WORDS, PRONOUNS, SEVERE_WORDS, expressions
from wicara.functions.columns import words
from wicara.functions.rules import toxicity_meter
from wicara.functions.text import clean_ascii
from wicara.operators import features
from wicara.operators.lexicon import lexicon_matches, rule_features
from wicara.sources.files import read_table

MAX_FEATURES = 20_000


def grams_sql(source: str, row_id: str, text: str = "text") -> str:
    """``(row_id, g)``: list of 1- and 2-grams over words of two or more characters."""
    return (
        f"select {row_id}, list_concat(t, list_transform(range(1, len(t)), "
        "lambda i: t[i] || ' ' || t[i + 1])) as g from "
        f"(select {row_id}, regexp_extract_all({ascii_sql(text)}, '[\\p{{L}}\\p{{N}}_]{{2,}}') as t "
        f"from {source}) q"
    )


VOCABULARY_SQL = f"""
select term, cast(sum(tf) as bigint) as corpus_frequency, count(*) as document_frequency from
  (select doc_id, term, count(*) as tf from
    (select doc_id, unnest(g) as term from ({grams_sql('documents', 'doc_id')}) a) b
  group by doc_id, term) c
group by term having count(*) >= 2 order by corpus_frequency desc, term limit {MAX_FEATURES}
"""


def grams(df, text="text"):
    return features.with_ngrams(df.withColumn("_clean", clean_ascii(text)), "_clean").drop("_clean")


def fitted(docs):
    return features.fit_tfidf(docs.select(clean_ascii("text").alias("clean")), "clean", MAX_FEATURES, 2)


@query(
    "ngrams_1_2",
    f"select doc_id, len(g) as n_grams, md5(array_to_string(g, '|')) as grams "
    f"from ({grams_sql('documents', 'doc_id')}) q",
)
def ngrams_1_2(spark, folder):
    return grams(documents(spark, folder)).select(
        "doc_id",
        F.size("ngrams").cast("long").alias("n_grams"),
        F.md5(F.array_join("ngrams", "|")).alias("grams"),
    )


@query("tfidf_vocabulary", VOCABULARY_SQL)
def tfidf_vocabulary(spark, folder):
    return features.frequent_terms(grams(documents(spark, folder)), MAX_FEATURES, 2)


@query(
    "tfidf_weights",
    f"""
with v as ({VOCABULARY_SQL}),
tf as (select doc_id, term, count(*) as tf from
  (select doc_id, unnest(g) as term from ({grams_sql('documents', 'doc_id')}) a) b group by 1, 2),
w as (select doc_id, term, tf * (ln((1 + (select count(*) from documents)) / (1 + document_frequency)) + 1)
  as w from tf join v using (term))
select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w
""",
)
def tfidf_weights(spark, folder):
    docs = documents(spark, folder)
    model = fitted(docs)
    cleaned = docs.select("doc_id", clean_ascii("text").alias("clean"))
    weights = features.tfidf_long(model.transform(cleaned, "clean"), model, "doc_id")
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "vocabulary_coverage",
    f"""
select b.item_id, coalesce(count(v.term) / nullif(count(b.term), 0), 0) as vocabulary_coverage from
  (select item_id, unnest(g) as term from ({grams_sql('benchmark', 'item_id')}) q) b
  left join ({VOCABULARY_SQL}) v on b.term = v.term group by b.item_id
""",
)
def vocabulary_coverage(spark, folder):
    model = fitted(documents(spark, folder))
    items = read_table(spark, folder, "benchmark").select("item_id", clean_ascii("text").alias("clean"))
    covered = model.transform(items, "clean", coverage="vocabulary_coverage")
    return covered.select("item_id", "vocabulary_coverage")


@query(
    "feature_assembly",
    f"""
select l.doc_id, cast(len(t.ws) as bigint) as n_words, m.score, l.quality,
  (select count(*) from ({hits_sql()}) h where h.doc_id = l.doc_id) as rule_count
from labels l join (select doc_id, {words_sql(ascii_sql('text'))} as ws from documents) t
  on l.doc_id = t.doc_id join ({METER_SQL}) m on l.doc_id = m.doc_id
""",
)
def feature_assembly(spark, folder):
    """Engineered block of each annotated text, assembled on the row itself."""
    matched = lexicon_matches(labelled(spark, folder), "text", expressions(spark), "doc_id")
    _, count = rule_features("matches")
    block = features.engineered_vector(
        [
            F.array(F.size(words(clean_ascii("text"))).cast("double")),
            F.array(toxicity_meter("text", METER_WORDS, SEVERE_WORDS, PRONOUNS)),
            F.array(F.col("quality").cast("double"), count.cast("double")),
        ]
    )
    return matched.select("doc_id", block.alias("b")).select(
        "doc_id",
        F.col("b")[0].cast("long").alias("n_words"),
        F.col("b")[1].alias("score"),
        F.col("b")[2].cast("int").alias("quality"),
        F.col("b")[3].cast("long").alias("rule_count"),
    )
