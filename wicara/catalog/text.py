"""Text cleaning, normalising and label-list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicara.catalog.base import (
    COMMENTS_SQL,
    SLANG,
    STOPWORDS,
    TOPICS_SQL,
    ascii_sql,
    collapse_sql,
    comments,
    documents,
    labelled,
    mapped_sql,
    query,
    quoted,
    sql_list,
    topics,
    words_sql,
)
from wicara.functions import lists, text
from wicara.functions.columns import words
from wicara.functions.emoji import extract_emojis, remove_emojis
from wicara.functions.wordlists import PRONOUN_MAP, SLANG_MAP
from wicara.operators import labels as label_ops
from wicara.operators import quality
from wicara.operators.stemming import distinct_tokens, stem_by_dictionary
from wicara.plans.preprocess import preprocess
from wicara.sources.files import read_table

WORD = r"[\p{L}\p{N}_]"
CHARS = "regexp_extract_all({0}, '(?s).')"
PRONOUNS = {**PRONOUN_MAP, **SLANG}
ALL_SLANG = {**SLANG_MAP, **SLANG}

# Every document gets one of these marks, so that emoji, tag and hashtag rules have work to do.
MARKS = ("\U0001f600 ok", "\U0001f44d\U0001f3fd!", "\U0001f1ee\U0001f1e9 #Merah_Putih",
         "\U0001f469‍\U0001f4bb❤️", "1️⃣ @admin_1", "no mark")


def marked(spark, folder):
    mark = F.element_at(F.array(*[F.lit(m) for m in MARKS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return documents(spark, folder).withColumn("text", F.concat("text", F.lit(" "), mark))


MARKED_SQL = (
    "(select doc_id, text || ' ' || ["
    + ", ".join(f"'{m}'" for m in MARKS)
    + "][(doc_id % 6) + 1] as text from documents)"
)


# What each mark holds as emojis and what is left of it, spelled out by hand.
EMOJIS = ("\U0001f600", "\U0001f44d\U0001f3fd", "\U0001f1ee\U0001f1e9", "\U0001f469\u200d\U0001f4bb \u2764\ufe0f",
          "1\ufe0f\u20e3", "")
BARE = (" ok", "!", " #Merah_Putih", "", " @admin_1", "no mark")
BARE_SQL = f"(select doc_id, text || ' ' || [{', '.join(quoted(b) for b in BARE)}][(doc_id % 6) + 1] as text from documents)"


def _clean_steps(value: str) -> str:
    value = f"lower(coalesce({value}, ''))"
    for pattern, replacement in (
        (r"http\S+|www\S+", " "),
        ("<[^>]+>", " "),
        (f"@{WORD}+", " "),
        (f"#({WORD}+)", r"\1"),
        (r"[^\p{L}\p{N}_\s]", " "),
    ):
        value = f"regexp_replace({value}, '{pattern}', '{replacement}', 'g')"
    return value


def unicode_sql(source: str, row_id: str, extra: str = "") -> str:
    """``(row_id, text_clean, extra)`` of the fully cleaned text."""
    extra = f", {extra}" if extra else ""
    return (
        f"select {row_id}, trim(regexp_replace({collapse_sql('cs')}, '\\s+', ' ', 'g')) as text_clean{extra} "
        f"from (select *, {CHARS.format(_clean_steps('text'))} as cs from {source}) q"
    )


@query("clean_text_ascii", f"select doc_id, {ascii_sql('text')} as text_clean from documents")
def clean_text_ascii(spark, folder):
    return documents(spark, folder).select("doc_id", text.clean_ascii("text").alias("text_clean"))


@query(
    "normalize_tokens",
    f"select doc_id, array_to_string({mapped_sql(words_sql(ascii_sql('text')), PRONOUNS)}, ' ') "
    "as text_norm from documents",
)
def normalize_tokens(spark, folder):
    return documents(spark, folder).select(
        "doc_id", text.normalize_tokens("text", PRONOUNS).alias("text_norm")
    )


@query("clean_text_unicode", unicode_sql(f"{BARE_SQL} m", "doc_id"))
def clean_text_unicode(spark, folder):
    return marked(spark, folder).select("doc_id", text.clean_unicode("text").alias("text_clean"))


@query(
    "strip_urls",
    r"select page_id, regexp_replace(url || ' ' || html, 'http\S+|www\S+', ' ', 'g') as body from pages",
)
def strip_urls(spark, folder):
    pages = read_table(spark, folder, "pages")
    return pages.select("page_id", text.strip_urls(F.concat("url", F.lit(" "), "html")).alias("body"))


@query(
    "strip_html", "select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as body from pages"
)
def strip_html(spark, folder):
    pages = read_table(spark, folder, "pages")
    return pages.select("page_id", text.strip_html("html").alias("body"))


@query(
    "strip_mentions",
    f"select doc_id, regexp_replace(text, '@{WORD}+', ' ', 'g') as body from {MARKED_SQL} m",
)
def strip_mentions(spark, folder):
    return marked(spark, folder).select("doc_id", text.strip_mentions("text").alias("body"))


@query(
    "unwrap_hashtags",
    f"select doc_id, regexp_replace(text, '#({WORD}+)', '\\1', 'g') as body from {MARKED_SQL} m",
)
def unwrap_hashtags(spark, folder):
    return marked(spark, folder).select("doc_id", text.unwrap_hashtags("text").alias("body"))


@query(
    "strip_punct",
    r"select doc_id, regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g') as body from documents",
)
def strip_punct(spark, folder):
    return documents(spark, folder).select("doc_id", text.strip_punct("text").alias("body"))


@query(
    "collapse_repeats",
    f"select doc_id, {collapse_sql('cs')} as body "
    f"from (select doc_id, {CHARS.format('text')} as cs from documents) q",
)
def collapse_repeats(spark, folder):
    return documents(spark, folder).select("doc_id", text.collapse_repeats("text").alias("body"))


@query(
    "squeeze_ws", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as body from documents"
)
def squeeze_ws(spark, folder):
    return documents(spark, folder).select("doc_id", text.squeeze_ws("text").alias("body"))


@query(
    "extract_emojis",
    f"select doc_id, [{', '.join(quoted(e) for e in EMOJIS)}][(doc_id % 6) + 1] as emoji from documents",
)
def emojis(spark, folder):
    return marked(spark, folder).select("doc_id", extract_emojis("text").alias("emoji"))


@query(
    "remove_emojis",
    f"select doc_id, text as body from {BARE_SQL} m",
)
def without_emojis(spark, folder):
    return marked(spark, folder).select("doc_id", remove_emojis("text").alias("body"))


@query(
    "slang_normalize",
    f"select doc_id, array_to_string({mapped_sql(words_sql('text_clean'), ALL_SLANG)}, ' ') as body "
    f"from ({unicode_sql('documents', 'doc_id')}) c",
)
def slang_normalize(spark, folder):
    cleaned = text.clean_unicode("text")
    return documents(spark, folder).select(
        "doc_id", text.slang_normalize(cleaned, ALL_SLANG).alias("body")
    )


@query(
    "remove_stopwords",
    f"select doc_id, array_to_string(list_filter({words_sql(ascii_sql('text'))}, "
    f"lambda w: w not in {sql_list(STOPWORDS)}), ' ') as body from documents",
)
def remove_stopwords(spark, folder):
    return documents(spark, folder).select(
        "doc_id", text.remove_stopwords(text.clean_ascii("text"), STOPWORDS).alias("body")
    )


@query(
    "stem_by_dictionary",
    f"select doc_id, array_to_string(list_transform({words_sql(ascii_sql('text'))}, "
    "lambda w: regexp_replace(w, '^(.{3,}?)(?:ing|tion|ment|keit)$', '\\1')), ' ') as stemmed "
    "from documents",
)
def stemmed(spark, folder):
    docs = documents(spark, folder).select("doc_id", text.clean_ascii("text").alias("clean"))
    # One dictionary entry per distinct word of the corpus.
    tokens = distinct_tokens(docs, "clean")
    suffix = F.regexp_replace("token", F.lit("^(.{3,}?)(?:ing|tion|ment|keit)$"), F.lit("$1"))
    dictionary = tokens.select("token", suffix.alias("stem"))
    return stem_by_dictionary(docs, "clean", "doc_id", dictionary, "stemmed").drop("clean")


@query(
    "preprocess_pipeline",
    f"""
with c as ({COMMENTS_SQL}),
u as (select * from c where is_noise_or_spam_text = 0 and text is not null and trim(text) <> ''),
bad as (select text from u group by text having count(distinct toxicity) > 1),
k as (select u.* from u where text not in (select text from bad)),
f as (select * from k where doc_id in (select min(doc_id) from k group by text)),
t as ({unicode_sql('f', 'doc_id', 'topic')}),
s as (select doc_id, topic, array_to_string({mapped_sql(words_sql('text_clean'), ALL_SLANG)}, ' ')
  as text_clean from t)
select doc_id, text_clean,
  array_to_string(list_filter(list_transform(string_split(topic, ','), lambda x: trim(x)),
    lambda x: x <> ''), '|') as topics,
  array_to_string(list_filter({words_sql('text_clean')}, lambda w: w not in {sql_list(STOPWORDS)}), ' ')
    as text_processed
from s where text_clean <> ''
""",
)
def preprocess_pipeline(spark, folder):
    done = preprocess(comments(spark, folder), "doc_id", stopwords=STOPWORDS, slang=ALL_SLANG)
    return done.select(
        "doc_id", "text_clean", F.array_join("topic_list", "|").alias("topics"), "text_processed"
    )


@query(
    "token_counts",
    f"select doc_id, len(ws) as n_tokens, len(list_distinct(ws)) as n_distinct from "
    f"(select doc_id, {words_sql(ascii_sql('text'))} as ws from documents) q",
)
def token_counts(spark, folder):
    tokens = documents(spark, folder).select("doc_id", words(text.clean_ascii("text")).alias("ws"))
    return tokens.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("ws")).cast("long").alias("n_distinct"),
    )


TOPIC_LIST_SQL = (
    f"list_filter(list_transform(string_split({TOPICS_SQL}, ','), lambda x: trim(x)), lambda x: x <> '')"
)


def topic_lists(spark, folder):
    return documents(spark, folder).select("doc_id", lists.split_topics(topics()).alias("topic"))


@query(
    "split_topics",
    f"select doc_id, len(t) as n_topics, array_to_string(t, '|') as topics "
    f"from (select doc_id, {TOPIC_LIST_SQL} as t from documents) q",
)
def split_topics(spark, folder):
    return topic_lists(spark, folder).select(
        "doc_id", F.size("topic").cast("long").alias("n_topics"), F.array_join("topic", "|").alias("topics")
    )


@query(
    "parse_list_literal",
    "select doc_id, case when doc_id % 7 = 3 then 'True|' || lang || '|None' when doc_id % 7 = 5 then '' "
    "when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then lang || '|' || source else lang end as topics from documents",
)
def parse_list_literal(spark, folder):
    # Lists as a CSV export of Python lists spells them, and text that is no list.
    quote = F.lit("'")
    literal = (
        F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("[True, '"), "lang", F.lit("', None]")))
        .when(F.col("doc_id") % 7 == 5, F.concat(F.lit("[null, '"), "lang", F.lit("']")))
        .when(F.col("doc_id") % 4 == 0, F.col("source"))
        .when(
            F.col("doc_id") % 4 == 1,
            F.concat(F.lit("["), quote, "lang", F.lit("', ' "), "source", quote, F.lit("]")),
        )
        .otherwise(F.concat(F.lit('["'), "lang", F.lit(" \", '  ']")))
    )
    parsed = lists.parse_list_literal(literal)
    return documents(spark, folder).select("doc_id", F.array_join(parsed, "|").alias("topics"))


@query(
    "topic_vocabulary",
    f"select distinct unnest({TOPIC_LIST_SQL}) as label from documents",
)
def topic_vocabulary(spark, folder):
    return quality.label_vocabulary(topic_lists(spark, folder), "topic")


_TOPIC_LABELS = ["de", "en", "es", "fr", "long", *[f"src{i}" for i in range(20)]]


@query(
    "multi_hot",
    "select doc_id, "
    + ", ".join(
        f"cast(list_contains(t, '{v}') as integer) as topic_{v}" for v in _TOPIC_LABELS
    )
    + f" from (select doc_id, {TOPIC_LIST_SQL} as t from documents) q",
)
def multi_hot(spark, folder):
    return label_ops.multi_hot(topic_lists(spark, folder), "topic").drop("topic")


WORD_LIST = "regexp_extract_all(lower(text), '[a-z]{{3,}}'{0})"


@query(
    "sparse_labels",
    f"with d as (select doc_id, list_distinct({WORD_LIST.format('')}) as ws from documents), "
    "n as (select label, row_number() over (order by md5(label || ':42')) - 1 as number from "
    "(select distinct unnest(ws) as label from d) l), "
    "p as (select doc_id, unnest(ws) as label from d), "
    "r as (select doc_id, count(*) as n_labels, string_agg(n.number::varchar, ',' order by n.number) as indices "
    "from p join n on n.label = p.label group by 1) "
    "select d.doc_id, coalesce(r.n_labels, 0) as n_labels, coalesce(md5(r.indices), '') as indices_md5 "
    "from d left join r on r.doc_id = d.doc_id",
)
def sparse_labels(spark, folder):
    """Every word of the documents as a label: far more labels than columns could hold."""
    found = F.expr(WORD_LIST.format(", 0"))
    docs = documents(spark, folder).select("doc_id", F.array_distinct(found).alias("labels"))
    made = label_ops.sparse_labels(docs, "labels", "doc_id")
    listed = F.md5(F.array_join(F.col("indices").cast("array<string>"), ","))
    return made.select(
        "doc_id",
        F.size("indices").cast("long").alias("n_labels"),
        F.when(F.size("indices") > 0, listed).otherwise(F.lit("")).alias("indices_md5"),
    )


@query(
    "proto_one_hot",
    "select doc_id, case when toxic = 1 then '1,0,1,0' else '0,1,0,1' end || "
    "case when quality = 1 then ',1' else ',0' end as proto from labels",
)
def proto_one_hot(spark, folder):
    from wicara.functions.rules import mood_proxy, sentiment_proxy
    from wicara.models.trimodel import proto_features

    rows = labelled(spark, folder).select(
        "doc_id",
        mood_proxy("toxic").alias("mood"),
        sentiment_proxy("toxic").alias("sentiment"),
        F.array("quality").alias("subtopic"),
    )
    proto = proto_features(["angry", "happy"], ["negative", "positive"])
    return rows.select("doc_id", F.array_join(proto.cast("array<int>"), ",").alias("proto"))
