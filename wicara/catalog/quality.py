"""Filter, duplicate, conflict, profile, source and feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicara.catalog.base import COMMENTS_SQL, comments, documents, query, sql_list
from wicara.functions.rules import mood_proxy, sentiment_proxy
from wicara.functions.text import safe_float
from wicara.operators import quality
from wicara.sources.feed import latest_posts, select_posts
from wicara.sources.files import json_validity, read_table


@query("spam_filter", "select doc_id, quality, toxic from labels where quality = 0")
def spam_filter(spark, folder):
    return quality.drop_spam(read_table(spark, folder, "labels"), "quality")


@query(
    "drop_empty_text",
    "select doc_id, n_chars from documents where doc_id % 3 <> 0 and trim(text) <> ''",
)
def drop_empty_text(spark, folder):
    blanked = F.when(F.col("doc_id") % 6 == 0, F.lit("  \n\t")).when(
        F.col("doc_id") % 3 != 0, F.col("text")
    )
    rows = documents(spark, folder).select("doc_id", "n_chars", blanked.alias("text"))
    return quality.drop_blank(rows).drop("text")


@query(
    "fill_defaults",
    "select d.doc_id, coalesce(l.toxic, 0) as toxicity, "
    "case when d.doc_id % 4 = 0 then '' else d.text end as text_clean "
    "from documents d left join labels l on d.doc_id = l.doc_id",
)
def fill_defaults(spark, folder):
    rows = comments(spark, folder).select(
        "doc_id",
        F.col("toxicity").cast("double").alias("toxicity"),
        F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("text_clean"),
    )
    return quality.fill_defaults(rows)


@query(
    "safe_float",
    "select event_id, case event_id % 8 when 1 then cast(value as double) "
    "when 2 then cast(regexp_extract(props, '[0-9]+', 0) as double) when 5 then 1000.0 + event_id % 10 "
    "when 6 then event_id * 100.0 else -1.0 end as number from events",
)
def safe_float_query(spark, folder):
    kind = F.col("event_id") % 8
    raw = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.col("value").cast("string"))
        .when(kind == 2, F.concat(F.lit(" "), F.regexp_extract("props", "[0-9]+", 0)))
        .when(kind == 3, F.concat("event_id", F.lit("d")))  # suffixes and other bases are no numbers
        .when(kind == 4, F.concat(F.lit("0x"), "event_id", F.lit("p3")))
        .when(kind == 5, F.concat(F.lit("1_00"), F.col("event_id") % 10))
        .when(kind == 6, F.concat("event_id", F.lit("e+2\t")))
    )
    return read_table(spark, folder, "events").select(
        "event_id", safe_float(raw, -1.0).alias("number")
    )


@query(
    "proxy_labels",
    "select doc_id, case when toxic = 1 then 'angry' else 'happy' end as mood, "
    "case when toxic = 1 then 'negative' else 'positive' end as sentiment from labels",
)
def proxy_labels(spark, folder):
    return read_table(spark, folder, "labels").select(
        "doc_id", mood_proxy("toxic").alias("mood"), sentiment_proxy("toxic").alias("sentiment")
    )


CATEGORIES_SQL = """
select d.doc_id, l.toxic as a, l.quality as b, cast(d.n_chars > 1000 as integer) as c, l.toxic
from documents d left join labels l on d.doc_id = l.doc_id
"""


def categories(spark, folder):
    labels = read_table(spark, folder, "labels")
    return documents(spark, folder).join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("toxic").alias("a"),
        F.col("quality").alias("b"),
        (F.col("n_chars") > 1000).cast("int").alias("c"),
        "toxic",
    )


@query(
    "category_count",
    f"select doc_id, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) as category_count "
    f"from ({CATEGORIES_SQL}) q",
)
def category_count(spark, folder):
    return categories(spark, folder).select(
        "doc_id", quality.row_sum(["a", "b", "c"]).alias("category_count")
    )


@query(
    "crosstab",
    "select toxic, "
    + ", ".join(f"count(*) filter (where n = {v}) as category_count_{v}" for v in range(4))
    + f" from (select toxic, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) as n from ({CATEGORIES_SQL}) q) r "
    "where toxic is not null group by toxic",
)
def crosstab(spark, folder):
    rows = categories(spark, folder).withColumn("category_count", quality.row_sum(["a", "b", "c"]))
    return quality.crosstab(rows, "toxic", "category_count", range(4))


CONFLICT_KEYS = (
    "(select o_custkey from orders group by o_custkey having count(distinct o_orderstatus) > 1)"
)


@query(
    "conflict_rows",
    f"select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey in {CONFLICT_KEYS}",
)
def conflict_rows(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return quality.conflict_rows(orders, "o_custkey", "o_orderstatus", "o_orderkey")


@query(
    "conflict_free_rows",
    f"select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey not in {CONFLICT_KEYS}",
)
def conflict_free_rows(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return quality.conflict_free_rows(orders, "o_custkey", "o_orderstatus", "o_orderkey")


@query(
    "conflict_free_texts",
    f"with c as ({COMMENTS_SQL}) select doc_id, toxicity from c where text not in "
    "(select text from c group by text having count(distinct toxicity) > 1)",
)
def conflict_free_texts(spark, folder):
    rows = comments(spark, folder).select("doc_id", "text", "toxicity")
    return quality.conflict_free_rows(rows, "text", "toxicity", "doc_id").drop("text")


@query(
    "labels_per_text",
    "select l_suppkey, count(distinct l_returnflag || l_linestatus) as n_label from lineitem group by 1",
)
def labels_per_text(spark, folder):
    rows = read_table(spark, folder, "lineitem").select(
        "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("label")
    )
    return quality.labels_per_key(rows, "l_suppkey", "label")


@query(
    "label_conflicts",
    "select o_custkey, count(distinct o_orderstatus) as n_label from orders group by o_custkey "
    "having count(distinct o_orderstatus) > 1",
)
def label_conflicts(spark, folder):
    return quality.label_conflicts(read_table(spark, folder, "orders"), "o_custkey", "o_orderstatus")


@query(
    "duplicate_count",
    "select count(*) as n_rows, count(distinct coalesce(t, '\x01')) as n_distinct, "
    "count(*) - count(distinct coalesce(t, '\x01')) as n_duplicates "
    "from (select case when doc_id % 50 <> 0 then text end as t from documents) q",
)
def duplicate_count(spark, folder):
    rows = documents(spark, folder).select(F.when(F.col("doc_id") % 50 != 0, F.col("text")).alias("t"))
    return quality.duplicate_count(rows, "t")


@query(
    "dedup_keep_first",
    "select doc_id, text, lang from documents where doc_id in "
    "(select min(doc_id) from documents group by text)",
)
def dedup_keep_first(spark, folder):
    return quality.keep_first(documents(spark, folder).select("doc_id", "text", "lang"), "text", "doc_id")


@query(
    "duplicate_rows",
    "select doc_id, lang from documents where text in "
    "(select text from documents group by text having count(*) > 1)",
)
def duplicate_rows(spark, folder):
    rows = documents(spark, folder).select("doc_id", "text", "lang")
    return quality.duplicate_rows(rows, "text", "doc_id").drop("text")


@query("value_counts", "select event_type, count(*) as n from events group by event_type")
def value_counts(spark, folder):
    return quality.value_counts(read_table(spark, folder, "events"), "event_type")


@query(
    "value_shares",
    "select p_type, round_even(count(*) / sum(count(*)) over (), 3) as share from part group by p_type",
)
def value_shares(spark, folder):
    return quality.value_shares(read_table(spark, folder, "part"), "p_type")


_PROFILE = (
    ("doc_id", "bigint"),
    ("text", "string"),
    ("is_noise_or_spam_text", "int"),
    ("toxicity", "int"),
    ("topic", "string"),
)


@query(
    "column_profile",
    " union all ".join(
        f"select '{name}' as column_name, '{kind}' as column_type, count({name}) as n_non_null, "
        f"count(*) - count({name}) as n_null from ({COMMENTS_SQL}) c"
        for name, kind in _PROFILE
    ),
)
def column_profile(spark, folder):
    return quality.column_profile(comments(spark, folder))


@query(
    "hash_sample",
    "select doc_id, lang from documents order by md5(doc_id || ':42'), doc_id limit 100",
)
def hash_sample(spark, folder):
    return quality.hash_sample(documents(spark, folder).select("doc_id", "lang"), "doc_id", 100)


@query(
    "tagged_union",
    "select doc_id as id, text, 'documents' as origin from documents union all "
    "select conv_id * 1000 + turn, text, 'conversations' from conversations",
)
def tagged_union(spark, folder):
    talk = read_table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    docs = documents(spark, folder).select(F.col("doc_id").alias("id"), "text")
    return quality.tagged_union([("documents", docs), ("conversations", talk)], "origin")


JSON_SQL = (
    "case event_id % 8 when 0 then substr(props, 1, length(props) - 1) when 1 then '[' || props || ']' "
    "when 2 then props || ' x' when 3 then cast(event_id as varchar) when 4 then props || ']  ,[{}' "
    "when 5 then chr(9) || props when 6 then props || '},' || props else props end"
)


@query(
    "jsonl_validity",
    f"select count(*) filter (where coalesce(ok, false)) as n_valid, "
    f"count(*) filter (where not coalesce(ok, false)) as n_invalid from "
    f"(select json_valid(v) and json_type(case when json_valid(v) then v end) = 'OBJECT' as ok "
    f"from (select {JSON_SQL} as v from events) e) q",
)
def jsonl_validity(spark, folder):
    kind = F.col("event_id") % 8
    line = (
        F.when(kind == 0, F.expr("substr(props, 1, length(props) - 1)"))
        .when(kind == 1, F.concat(F.lit("["), "props", F.lit("]")))
        .when(kind == 2, F.concat("props", F.lit(" x")))
        .when(kind == 3, F.col("event_id").cast("string"))
        .when(kind == 4, F.concat("props", F.lit("]  ,[{}")))
        .when(kind == 5, F.concat(F.lit("\t"), "props"))
        .when(kind == 6, F.concat("props", F.lit("},"), "props"))
        .otherwise(F.col("props"))
    )
    return json_validity(read_table(spark, folder, "events").select(line.alias("value")))


FEED_TAGS = ("src1", "src7", "src13")


@query(
    "feed_filter",
    f"select doc_id, source from documents where lang = 'en' and source in {sql_list(FEED_TAGS)} "
    "and doc_id % 4 <> 0 order by doc_id desc limit 100",
)
def feed_filter(spark, folder):
    posts = documents(spark, folder).select(
        "doc_id",
        "lang",
        "source",
        "text",
        F.array(F.upper("source"), "lang").alias("hashtags"),
        (F.col("doc_id") % 4 == 0).alias("is_retweet"),
    )
    kept = select_posts(posts, FEED_TAGS, "en")
    return latest_posts(kept, [F.desc("doc_id")], 100).select("doc_id", "source")
