"""Stemming queries: planted affixes around the words of all documents, half of the words being roots."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicara.catalog.base import documents, query, quoted
from wicara.functions.columns import bind
from wicara.operators import affixes, stemming
from wicara.session import cut_lineage

# Affixes put around the words of the documents, chosen by hash; {0} is the word, {1} all but its first letter.
FRAMES = (
    "me{0}", "mem{1}kan", "men{1}", "meng{0}kan", "meny{1}i", "ber{0}", "ber{0}an", "di{0}kannya", "ke{0}an", "ter{0}lah",
    "pe{0}", "per{0}annya", "memper{0}i", "se{0}nya", "peng{1}an", "{0}pun",
)
WORD = "[a-z]{3,}"


def words_of(docs):
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))


def framed(word: str) -> str:
    """SQL, the same in both dialects: the word in the frame its hash names."""
    cases = []
    for n, frame in enumerate(FRAMES):
        parts = [quoted(p) if p not in "01" else (word, f"substr({word}, 2)")[int(p)] for p in frame.replace("{", "|").replace("}", "|").split("|") if p]
        cases.append(f"when '{n:x}' then concat({', '.join(parts)})")
    return f"case substr(md5({word}), 2, 1) {' '.join(cases)} end"


IS_ROOT = "substr(md5(word), 1, 1) < '8'"


def _prefix_rows() -> str:
    rows = [f"({n}, {quoted(r.kind)}, {quoted(r.start)}, {quoted(r.follow)}, {quoted(r.put)}, {quoted(r.after)})" for n, r in enumerate(affixes.PREFIXES, 1)]
    return f"(values {', '.join(rows)}) r(n, kind, start, follow, put, after)"


def _off(word: str, endings, least: int = affixes.LEAST_STEM) -> str:
    cases = [f"when ends_with({word}, '{e}') and length({word}) >= {len(e) + least} then left({word}, length({word}) - {len(e)})" for e in endings]
    return f"case {' '.join(cases)} end"


FORBIDDEN = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in affixes.FORBIDDEN)
FIRST = " or ".join(f"(starts_with(token, '{a}') and ends_with(token, '{b}'))" for a, b in affixes.PREFIX_FIRST)
FITS = f"""starts_with(f.word, r.start) and length(f.word) >= length(r.start) + {affixes.LEAST_LEFT}
  and (r.follow = '' or contains(r.follow, substr(f.word, length(r.start) + 1, 1)))
  and (r.after = '' or starts_with(substr(f.word, length(r.start) + 2), r.after)) and f.kind <> r.kind"""
TAKEN = "r.put || substr(f.word, length(r.start) + 1) as word, r.kind"


def stem_sql(tokens: str, roots: str) -> str:
    """CTEs ending in ``stems`` (token, stem) for the tables of tokens and roots."""
    derived = "\n  union all ".join(
        f"select token, 0, {3 + k}, {_off('d', [e])}, '{e}' from s2" for k, e in enumerate(affixes.DERIVATIONS)
    )
    return f"""
t as ({tokens}), roots as ({roots}), r as (select * from {_prefix_rows()}),
s0 as (select token from t where length(token) >= {affixes.SHORTEST}),
s1 as (select token, {_off('token', affixes.PARTICLES)} as p from s0),
s2 as (select token, p, {_off('coalesce(p, token)', affixes.POSSESSIVES)} as s, coalesce(s, p, token) as d from s1),
forms as (select token, 0 as phase, 0 as rank, token as word, '' as ending from t
  union all select token, 0, 1, p, '' from s2 union all select token, 0, 2, s, '' from s2
  union all {derived}),
f0 as (select token, case when {FIRST} then rank when rank > 2 then rank - 10 else -rank end as rank, word, ending, '' as kind
  from forms where word is not null and length(token) >= {affixes.SHORTEST}),
f1 as (select token, rank, 1 as level, r.n as r1, 0 as r2, 0 as r3, ending, {TAKEN} from f0 f join r on {FITS}
  and (r.kind, f.ending) not in ({FORBIDDEN})),
f2 as (select token, rank, 2 as level, f.r1, r.n as r2, 0 as r3, ending, {TAKEN} from f1 f join r on {FITS}),
f3 as (select token, rank, 3 as level, f.r1, f.r2, r.n as r3, ending, {TAKEN} from f2 f join r on {FITS}),
tried as (select token, phase, rank, 0 as level, 0 as r1, 0 as r2, 0 as r3, word from forms where word is not null
  union all select token, 1, rank, level, r1, r2, r3, word from f1
  union all select token, 1, rank, level, r1, r2, r3, word from f2
  union all select token, 1, rank, level, r1, r2, r3, word from f3),
hits as (select token, word, row_number() over (partition by token order by phase, rank, level, r1, r2, r3) as place
  from tried where word in (select root from roots)),
stems as (select t.token, coalesce(h.word, t.token) as stem from t left join hits h on h.token = t.token and h.place = 1)"""


WORDS_SQL = f"words as (select unnest(regexp_extract_all(lower(text), '{WORD}')) as word from documents)"
ROOTS_SQL = f"select distinct word as root from words where {IS_ROOT}"


@query(
    "stem_tokens",
    f"with {WORDS_SQL}, {stem_sql(f'select distinct {framed("word")} as token from words', ROOTS_SQL)} select token, stem from stems",
)
def stem_tokens(spark, folder):
    return stem_framed(words_of(documents(spark, folder)))


def stem_framed(words):
    """Tokens made of the distinct words, by the roots among these."""
    found = cut_lineage(words.distinct())
    roots = found.where(IS_ROOT).select(F.col("word").alias("root"))
    # bound: the optimizer would drop the distinct below the next one and frame every occurrence of a word
    return stemming.stem_tokens(bind(found, "token", F.expr(framed("word"))), roots)


@query(
    "stem_texts",
    f"with {WORDS_SQL}, {stem_sql('select distinct word as token from words', ROOTS_SQL)}, "
    f"p as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from (select doc_id, "
    f"regexp_extract_all(lower(text), '{WORD}') as ws from documents) d), "
    "j as (select p.doc_id, string_agg(s.stem, ' ' order by i) as stemmed from p join stems s on s.token = p.word group by 1) "
    "select d.doc_id, coalesce(j.stemmed, '') as stemmed from documents d left join j on j.doc_id = d.doc_id",
)
def stem_texts(spark, folder):
    docs = documents(spark, folder)
    plain = docs.select("doc_id", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), " ").alias("plain"))
    roots = words_of(docs).distinct().where(IS_ROOT).select(F.col("word").alias("root"))
    return stemming.stem_texts(plain, "plain", "doc_id", roots, "stemmed").select("doc_id", "stemmed")
