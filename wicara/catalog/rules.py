"""Lexicon, meter, keyword and promotion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicara.catalog.base import (
    ENTRIES,
    PROMO_TERMS,
    SLANG,
    TOXIC_WORDS,
    ascii_sql,
    documents,
    hits_sql,
    labelled,
    lexicon_sql,
    mapped_sql,
    query,
    sql_list,
    words_sql,
)
from wicara.functions import rules
from wicara.functions.columns import words
from wicara.functions.text import clean_ascii
from wicara.functions.wordlists import KEYWORD_GROUPS, METER_SEVERE_TERMS, METER_TERMS, PRONOUN_MAP
from wicara.operators import lexicon, promo
from wicara.plans.scoring import blank_defaults, promo_table, rule_table
from wicara.sources.files import read_table

METER_WORDS = METER_TERMS + TOXIC_WORDS
SEVERE_WORDS = METER_SEVERE_TERMS + ("scum", "worthless")
PRONOUNS = {**PRONOUN_MAP, **SLANG}
GROUPS = {
    name: (*terms, *more)
    for (name, terms), more in zip(
        KEYWORD_GROUPS.items(), [("in", "on"), ("idiot", "trash"), ("die", "mit"), ("le", "un")]
    )
}
TOKENS_SQL = f"select doc_id, {mapped_sql(words_sql(ascii_sql('text')), PRONOUNS)} as ws from documents"


def expressions(spark):
    """The grouped test lexicon; the built-in list with the words the test texts contain."""
    return lexicon.Lexicon.of(lexicon.lexicon_frame(spark, ENTRIES))


def matched(spark, folder):
    return lexicon.lexicon_matches(documents(spark, folder), "text", expressions(spark), "doc_id")


@query(
    "lexicon_grouped",
    f"select {ascii_sql('p_name')} as expression, coalesce(array_to_string(list_sort(list(distinct r) "
    "filter (where r <> '')), '|'), '') as regions, min(p_partkey) as position from "
    "(select *, case when p_size % 7 = 0 then '' else p_brand end as r from part) q group by 1",
)
def lexicon_grouped(spark, folder):
    entries = read_table(spark, folder, "part").select(
        F.initcap("p_name").alias("expression"),
        F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("region"),
        F.col("p_partkey").alias("position"),
    )
    grouped = lexicon.group_lexicon(entries)
    return grouped.withColumn("regions", F.array_join("regions", "|"))


@query(
    "lexicon_rule",
    f"""
select d.doc_id, case when count(h.expression) > 0 then 'toxic' else 'non_toxic' end as label,
  count(h.expression) as n_matches
from documents d left join ({hits_sql()}) h on d.doc_id = h.doc_id group by d.doc_id
""",
)
def lexicon_rule(spark, folder):
    ruled = lexicon.lexicon_rule(documents(spark, folder), "text", expressions(spark), "doc_id")
    return ruled.select("doc_id", "rule.label", F.size("rule.matches").cast("long").alias("n_matches"))


@query(
    "lexicon_matches",
    f"select doc_id, expression, array_to_string(regions, '|') as regions from ({hits_sql()}) h",
)
def lexicon_matches(spark, folder):
    return (
        matched(spark, folder)
        .select("doc_id", F.explode("matches").alias("m"))
        .select("doc_id", "m.expression", F.array_join("m.regions", "|").alias("regions"))
    )


@query(
    "lexicon_matches_joined",
    f"""
select t.doc_id, x.expression, array_to_string(x.regions, '|') as regions
from (select doc_id, ' ' || {ascii_sql('text')} || ' ' as padded from documents) t
join (select {ascii_sql('text')} as expression, list_sort(list(distinct 'set' || (item_id % 8))) as regions
  from (select item_id, unnest(string_split(text, ' ')) as text from benchmark) b
  group by 1) x on x.expression <> '' and contains(t.padded, ' ' || x.expression || ' ')
""",
)
def lexicon_matches_joined(spark, folder):
    """A lexicon that grows with the data: all words of the benchmark texts, some of which clean to phrases."""
    entries = read_table(spark, folder, "benchmark").select(
        F.explode(F.split("text", " ")).alias("expression"),
        F.concat(F.lit("set"), F.col("item_id") % 8).alias("region"),
        F.col("item_id").alias("position"),
    )
    found = lexicon.lexicon_hits(documents(spark, folder), "text", "doc_id", lexicon.group_lexicon(entries))
    return found.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", "m.expression", F.array_join("m.regions", "|").alias("regions")
    )


def phrases_sql(source: str, row_id: str, text: str) -> str:
    """Every run of one to four words of a text, each once."""
    return (
        f"select distinct {row_id}, array_to_string(list_slice(ws, i, i + n - 1), ' ') as expression from "
        f"(select *, unnest(range(1, greatest(len(ws) - n, 0) + 2)) as i from "
        f"(select *, unnest(range(1, 5)) as n from "
        f"(select {row_id}, {words_sql(ascii_sql(text))} as ws from {source}) a) b) c where i + n - 1 <= len(ws)"
    )


@query(
    "lexicon_rule_large",
    f"""
select d.doc_id, case when count(h.expression) > 0 then 'toxic' else 'non_toxic' end as label,
  count(h.expression) as n_matches, coalesce(sum(len(string_split(h.expression, ' '))), 0)::bigint as n_words
from documents d left join (select t.doc_id, t.expression from ({phrases_sql('documents', 'doc_id', 'text')}) t
  join (select distinct expression from ({phrases_sql('benchmark', 'item_id', 'text')}) x) b
  on t.expression = b.expression) h on d.doc_id = h.doc_id group by d.doc_id
""",
)
def lexicon_rule_large(spark, folder):
    """A lexicon of all phrases of one to four words of the benchmark texts."""
    split = words(clean_ascii("text"))
    phrase = lambda n: F.transform(
        F.when(F.size("ws") >= n, F.sequence(F.lit(1), F.size("ws") - (n - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice("ws", i, n), " "),
    )
    items = read_table(spark, folder, "benchmark").select("item_id", split.alias("ws"))
    entries = items.select(
        F.explode(F.concat(*[phrase(n) for n in range(1, 5)])).alias("expression"),
        F.lit("Benchmark").alias("region"),
        F.col("item_id").alias("position"),
    )
    docs = documents(spark, folder).select("doc_id", "text")
    ruled = lexicon.lexicon_rule(docs, "text", lexicon.Lexicon.of(entries), "doc_id")
    sizes = F.transform("rule.matches", lambda m: F.size(F.split(m["expression"], " ")))
    return ruled.select(
        "doc_id",
        "rule.label",
        F.size("rule.matches").cast("long").alias("n_matches"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n).alias("n_words"),
    )


@query(
    "rule_features",
    f"select d.doc_id, cast(count(h.expression) > 0 as integer) as rule_hit, "
    f"count(h.expression) as rule_count from documents d left join ({hits_sql()}) h "
    "on d.doc_id = h.doc_id group by d.doc_id",
)
def rule_features(spark, folder):
    hit, count = lexicon.rule_features("matches")
    return matched(spark, folder).select("doc_id", hit, count.cast("long").alias("rule_count"))


RULE_REPORT_SQL = f"""
select d.doc_id,
  case when count(h.expression) > 0 then 'toxic' else 'non_toxic' end as rule_toxicity,
  coalesce(string_agg(h.expression, ', ' order by h.position), '') as matched_expressions,
  array_to_string(list_sort(list_distinct(flatten(list(coalesce(h.regions, []))))), ', ')
    as matched_regions
from documents d left join ({hits_sql()}) h on d.doc_id = h.doc_id group by d.doc_id
"""


@query("rule_report", RULE_REPORT_SQL)
def rule_report(spark, folder):
    return rule_table(documents(spark, folder).select("doc_id", "text"), expressions(spark), "doc_id").drop("text")


@query("matched_regions", f"select doc_id, matched_regions from ({RULE_REPORT_SQL}) r")
def matched_regions(spark, folder):
    return matched(spark, folder).select(
        "doc_id", rules.join_regions("matches").alias("matched_regions")
    )


@query(
    "format_matches", f"select doc_id, matched_expressions from ({RULE_REPORT_SQL}) r"
)
def format_matches(spark, folder):
    return matched(spark, folder).select(
        "doc_id", rules.join_expressions("matches").alias("matched_expressions")
    )


def meter_sql(terms=METER_WORDS, severe=SEVERE_WORDS, tokens: str = TOKENS_SQL) -> str:
    return f"""
select doc_id, case when len(ws) = 0 then 0.0 else round_even(least(1.0,
    len(list_filter(ws, lambda w: w in {sql_list(terms)})) / len(ws)
    + case when len(list_filter(ws, lambda w: w in {sql_list(severe)})) > 0
      then 0.25 else 0.0 end), 4) end as score
from ({tokens}) t
"""


METER_SQL = meter_sql()


def metered(spark, folder):
    return documents(spark, folder).select(
        "doc_id", rules.toxicity_meter("text", METER_WORDS, SEVERE_WORDS, PRONOUNS).alias("score")
    )


@query("toxicity_meter", METER_SQL)
def toxicity_meter(spark, folder):
    return metered(spark, folder)


@query(
    "toxicity_meter_label",
    f"select doc_id, case when score >= 0.2 then 'toxic' else 'non_toxic' end as label "
    f"from ({METER_SQL}) m",
)
def toxicity_meter_label(spark, folder):
    return metered(spark, folder).select("doc_id", rules.meter_label("score").alias("label"))


@query(
    "keyword_features",
    "select doc_id, "
    + ", ".join(
        f"cast(len(list_filter(list_distinct(ws), lambda w: w in {sql_list(terms)})) as double) as {name}"
        for name, terms in GROUPS.items()
    )
    + f" from ({TOKENS_SQL}) t",
)
def keyword_features(spark, folder):
    counted = documents(spark, folder).select(
        "doc_id", rules.keyword_features("text", GROUPS, PRONOUNS).alias("v")
    )
    return counted.select("doc_id", *[F.col("v")[i].alias(n) for i, n in enumerate(GROUPS)])


@query(
    "blank_defaults",
    f"""
select d.doc_id,
  case when d.doc_id % 5 = 0 then 'neutral' when l.toxic = 1 then 'angry' else 'happy' end as mood,
  case when d.doc_id % 5 = 0 then 'neutral' when l.toxic = 1 then 'negative' else 'positive' end
    as sentiment,
  case when d.doc_id % 5 = 0 then '0,0' else l.quality || ',' || l.toxic end as subtopic,
  case when d.doc_id % 5 = 0 then 0.0 else m.score end as toxicity
from documents d join labels l on d.doc_id = l.doc_id join ({METER_SQL}) m on d.doc_id = m.doc_id
""",
)
def blank_posts(spark, folder):
    blanked = labelled(spark, folder).select(
        "doc_id",
        F.when(F.col("doc_id") % 10 == 0, F.lit(" \n\t"))
        .when(F.col("doc_id") % 5 != 0, F.col("text"))
        .alias("text"),
        rules.mood_proxy("toxic").alias("mood"),
        rules.sentiment_proxy("toxic").alias("sentiment"),
        F.array("quality", "toxic").alias("subtopic"),
        rules.toxicity_meter("text", METER_WORDS, SEVERE_WORDS, PRONOUNS).alias("toxicity"),
    )
    return (
        blank_defaults(blanked, "text", 2).withColumn("subtopic", F.array_join("subtopic", ",")).drop("text")
    )


NUMBERS_SQL = """
select cast(8 + position % 60 as varchar) as number, position, p_name as meaning,
  case when position % 3 = 0 then 'unknown' else p_type end as meaning_status,
  case when position % 2 = 0 then brand || ', catalogue' else '' end as sources
from (select p_name, p_type, min(p_partkey) as position, min(p_brand) as brand from part group by all) q
where 8 + position % 60 >= 10 and position % 4 <> 1 and position % 7 <> 0 and position % 5 <> 0
"""


def number_entries(spark, folder):
    """Distinct part names as reviewed number meanings, some unreviewed, unnamed or incomplete."""
    position = F.col("position")
    names = (
        read_table(spark, folder, "part")
        .groupBy("p_name", "p_type")
        .agg(F.min("p_partkey").alias("position"), F.min("p_brand").alias("brand"))
    )
    return names.select(
        "position",
        # every fifth number ends in a line feed, which is no digit
        F.concat((8 + position % 60).cast("string"), F.when(position % 5 == 0, F.lit("\n")).otherwise("")).alias("number"),
        F.when(position % 7 != 0, F.col("p_name")).alias("meaning"),
        F.when(position % 3 != 0, F.col("p_type")).alias("meaning_status"),
        F.when(position % 4 == 1, F.lit("pending")).otherwise(F.lit("verified")).alias("review_status"),
        F.when(position % 2 == 0, F.array("brand", F.lit("catalogue"))).alias("source_ids"),
    )


@query(
    "number_reference_verified",
    f"select number, count(*) as n_meanings, string_agg(meaning || ' (' || meaning_status || "
    f"'; sources: ' || sources || ')', '; ' order by position) as meanings from ({NUMBERS_SQL}) n "
    "group by number",
)
def number_reference_verified(spark, folder):
    verified = promo.verified_numbers(number_entries(spark, folder))
    return verified.select(
        "number",
        F.size("meanings").cast("long").alias("n_meanings"),
        rules.join_meanings(F.array(F.struct("meanings"))).alias("meanings"),
    )


# Posts: the text with a promotion that names one of the catalogue's numbers in every second one.
POSTS_SQL = (
    "(select doc_id, text || case when doc_id % 2 = 0 then ' TOKEN-' || (10 + doc_id % 45) || '! "
    "the' || (doc_id % 1000) || 'x' else ' den ' || (1000 + doc_id) end as text from documents)"
)


def posts(spark, folder):
    tail = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(
            F.lit(" TOKEN-"), 10 + F.col("doc_id") % 45, F.lit("! the"), F.col("doc_id") % 1000, F.lit("x")
        ),
    ).otherwise(F.concat(F.lit(" den "), 1000 + F.col("doc_id")))
    return documents(spark, folder).select("doc_id", F.concat("text", tail).alias("text"))


def promo_sql(source: str) -> str:
    pattern = f"(?:^| )({'|'.join(PROMO_TERMS)}) {{0,2}}([0-9]{{2,3}})(?:[^0-9]|$)"
    doubled = f"replace({ascii_sql('text')}, ' ', '  ')"
    return (
        f"select doc_id, regexp_extract_all({doubled}, '{pattern}', 1) as terms, "
        f"regexp_extract_all({doubled}, '{pattern}', 2) as numbers from {source} s"
    )


@query(
    "gambling_rule",
    "select doc_id, case when len(terms) > 0 then 'suspected_gambling_promo' else 'no_pattern' end "
    f"as label, len(terms) as n_matches from ({promo_sql(POSTS_SQL)}) p",
)
def gambling_rule(spark, folder):
    found = promo.with_promotions(posts(spark, folder), "text", PROMO_TERMS)
    return found.select(
        "doc_id",
        promo.promo_label("promotions").alias("label"),
        F.size("promotions").cast("long").alias("n_matches"),
    )


PROMO_ROWS_SQL = f"""
select doc_id, i, terms[i] as term, numbers[i] as number
from (select *, unnest(range(1, len(terms) + 1)) as i from ({promo_sql(POSTS_SQL)}) p) q
"""
MEANINGS_SQL = f"""
select number, count(*) as n, string_agg(meaning || ' (' || meaning_status || '; sources: ' || sources || ')',
  '; ' order by position) as meanings from ({NUMBERS_SQL}) n group by number
"""


def with_verified(spark, folder):
    found = promo.with_promotions(posts(spark, folder), "text", PROMO_TERMS)
    return promo.with_meanings(found, "doc_id", promo.verified_numbers(number_entries(spark, folder)))


@query(
    "gambling_matches",
    f"select r.doc_id, r.term, r.number, coalesce(m.n, 0) as n_meanings from ({PROMO_ROWS_SQL}) r "
    f"left join ({MEANINGS_SQL}) m on r.number = m.number",
)
def gambling_matches(spark, folder):
    return (
        with_verified(spark, folder)
        .select("doc_id", F.explode("promotions").alias("m"))
        .select("doc_id", "m.term", "m.number", F.size("m.meanings").cast("long").alias("n_meanings"))
    )


@query(
    "gambling_report",
    f"""
select d.doc_id, cast(count(r.term) > 0 as integer) as suspected,
  coalesce(string_agg(r.term || ' + ' || r.number, ', ' order by r.i), '') as matched_patterns,
  coalesce(string_agg(m.meanings, '; ' order by r.i), '') as verified_number_meanings
from documents d left join ({PROMO_ROWS_SQL}) r on d.doc_id = r.doc_id
left join ({MEANINGS_SQL}) m on r.number = m.number
group by d.doc_id
""",
)
def gambling_report(spark, folder):
    report = promo_table(
        posts(spark, folder),
        "doc_id",
        promo.verified_numbers(number_entries(spark, folder)),
        terms=PROMO_TERMS,
    )
    return report.select(
        "doc_id",
        F.col("suspected_gambling_promo").cast("int").alias("suspected"),
        "matched_patterns",
        "verified_number_meanings",
    )


RULE_FLAG_SQL = f"""
select l.doc_id, l.quality, l.toxic, cast(count(h.expression) > 0 as integer) as rule
from labels l join documents d on l.doc_id = d.doc_id left join ({hits_sql()}) h
  on l.doc_id = h.doc_id group by all
"""


def ruled_labels(spark, folder):
    found = lexicon.lexicon_matches(labelled(spark, folder), "text", expressions(spark), "doc_id")
    return found.select(
        "doc_id", "lang", "source", "quality", "toxic", (F.size("matches") > 0).cast("int").alias("rule")
    )


@query(
    "or_and_review_flags",
    "select doc_id, greatest(toxic, rule) as either, "
    f"cast(rule = 1 and toxic = 0 as integer) as review from ({RULE_FLAG_SQL}) f",
)
def or_and_review_flags(spark, folder):
    return ruled_labels(spark, folder).select(
        "doc_id",
        rules.or_flags("toxic", "rule").alias("either"),
        rules.review_flag("rule", "toxic").alias("review"),
    )


@query(
    "rule_review_count",
    f"select count(*) as n_rows, cast(sum(cast(rule = 1 and quality = 0 as integer)) as bigint) as n_review "
    f"from ({RULE_FLAG_SQL}) f",
)
def rule_review_count(spark, folder):
    return ruled_labels(spark, folder).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(rules.review_flag("rule", "quality")).alias("n_review")
    )


@query(
    "decision_policy",
    "select doc_id, case when toxic = 1 then 'toxic' else 'non_toxic' end as toxicity_final, "
    "cast(rule = 1 and toxic = 0 as integer) as rule_review, "
    f"greatest(toxic, rule) as or_experimental_prediction from ({RULE_FLAG_SQL}) f",
)
def decision_policy(spark, folder):
    from wicara.models.toxicity import decision_policy as decide

    decided = decide(ruled_labels(spark, folder), "toxic", "rule")
    return decided.select(
        "doc_id",
        rules.toxic_label("final_prediction").alias("toxicity_final"),
        "rule_review",
        "or_experimental_prediction",
    )


# Labels are the lexicon words, their probability the share of a text's lexicon hits.
_TOP = ("the", "and", "of", "de", "la", "der", "die", "el")


@query(
    "top_k_labels",
    f"""
with w as (select doc_id, unnest({words_sql(ascii_sql('text'))}) as w from documents),
n as (select doc_id, count(*) as n from w group by doc_id),
p as (select d.doc_id, t.label, coalesce(round(count(w.w) / max(n.n), 4), 0) as p
  from documents d cross join (select unnest([{', '.join(f"'{t}'" for t in _TOP)}]) as label) t
  left join n on d.doc_id = n.doc_id left join w on d.doc_id = w.doc_id and w.w = t.label
  group by d.doc_id, t.label),
r as (select *, row_number() over (partition by doc_id order by p desc, label) as k from p)
select doc_id, string_agg(label || ' (' || printf('%.2f', round_even(p, 2)) || ')', ', ' order by k)
  as top_labels
from r where k <= 3 group by doc_id
""",
)
def top_k_labels(spark, folder):
    from wicara.functions.lists import top_labels

    tokens = documents(spark, folder).select("doc_id", words(clean_ascii("text")).alias("ws"))

    def share(term):
        hits = F.size(F.filter("ws", lambda w: w == F.lit(term)))
        return F.round(hits / F.greatest(F.size("ws"), F.lit(1)), 4)

    shares = F.array(*[share(term) for term in _TOP])
    ranked = tokens.select("doc_id", shares.alias("p"))
    return ranked.select("doc_id", F.array_join(top_labels("p", _TOP, 3), ", ").alias("top_labels"))
