"""Registered queries of the subpackage, each over its whole table, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from wicara.llm import alignment, bpe, chat, collocation, decontaminate, embed, langid, minhash, packing, pii, rollup, tokenfile, warc
from wicara.llm.common import Scratch, table
from wicara.llm.hashing import SHINGLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


REACH_SQL = """
reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
parts as (select u, min(v) as low from reach group by u)
"""
EMBED_SQL = f"""
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e
  from embeddings where vec_id is not null and label is not null),
links as (select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
{REACH_SQL},
degrees as (select u, count(*) as n from links group by u)
select t.vec_id, coalesce(d.n, 0) as n_links, least(t.vec_id, coalesce(p.low, t.vec_id)) as component_id,
  t.vec_id <= coalesce(p.low, t.vec_id) as kept
from embeddings t left join degrees d on t.vec_id = d.u left join parts p on t.vec_id = p.u
"""


@query("op1_nn_descent_near_dedup", EMBED_SQL)
def nn_descent_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found, recall = embed.near_duplicates(table(spark, folder, "embeddings"))
    if recall < embed.RECALL:
        raise RuntimeError(f"links are missing: audited recall {recall:.4f}, target {embed.RECALL}")
    return found


@query("op2_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from p),
g as (select payload_digest, max(page_id) as last_page from d where payload_bytes >= 1000 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when d.page_id <> g.last_page then 'revisit' else 'response' end as record_type,
  case when d.page_id <> g.last_page then g.last_page end as refers_to
from d left join g on d.payload_digest = g.payload_digest and d.payload_bytes >= 1000
"""


@query("op3_warc_index_merge", WARC_SQL)
def warc_index_merge(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.capture_index(table(spark, folder, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Words end at ASCII blanks; the revision counts only words with a letter or digit.
WORD, SOLID, LETTERS = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D\p{L}\p{N}]*[\p{L}\p{N}][^\x20\x09-\x0D]*", r"\p{L}+"
ROLLUP_SQL = f"""
with d as (select min(doc_id) over (partition by coalesce(text, '')) as first_id, doc_id, source, lang,
  coalesce(text, '') as text from documents),
k as (select source, lang, len(regexp_extract_all(text, '{SOLID}')) as words,
  len(regexp_extract_all(text, '{LETTERS}')) as letters from d where doc_id = first_id),
t as (select source, lang, 'words-1' as tokenizer, words as n from k
  union all select source, lang, 'letters-1', letters from k)
select source, lang, tokenizer, count(*) as n_docs, cast(sum(n) as bigint) as n_tokens from t group by 1, 2, 3
"""


@query("op4_token_rollup", ROLLUP_SQL)
def token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Load all counts, delete exact copies, revise word counts, and commit the deletes once more."""
    scratch = Scratch(spark, "rollup")
    body = F.coalesce("text", F.lit(""))
    count = lambda pattern: F.regexp_count(body, F.lit(pattern)).cast("long")
    counts = scratch.write(
        table(spark, folder, "documents").select(
            "doc_id",
            "source",
            "lang",
            F.md5(body.cast("binary")).alias("digest"),
            count(WORD).alias("words"),
            count(SOLID).alias("solid"),
            count(LETTERS).alias("letters"),
        ),
        "counts",
    )
    first = scratch.write(
        counts.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "first"
    )
    copies = counts.join(first, "digest").where("doc_id <> first_id")
    both = lambda rows, op: rollup.changes(rows, "words-1", op, F.col("words")).unionByName(
        rollup.changes(rows, "letters-1", op, F.col("letters"))
    )
    kept = counts.join(copies.select("doc_id"), "doc_id", "left_anti")
    totals = rollup.TokenRollup(spark, scratch.path("totals"))
    totals.commit("load", both(counts, rollup.INSERT))
    totals.commit("drop copies", both(copies, rollup.DELETE))
    totals.commit("solid words", rollup.changes(kept.where("solid <> words"), "words-1", rollup.REVISE, F.col("solid")))
    totals.commit("drop copies", both(copies, rollup.DELETE))
    return scratch.finish(totals.totals())


@query("op5_spaced_seed_decontamination")
def spaced_seed_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contaminated(docs, benchmark, short_items=True)


@query("op6_bootstrapped_pii")
def bootstrapped_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


@query("op7_bpe_pair_index")
def bpe_pair_index(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_context_mixing_token_files")
def context_mixing_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.token_index(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# Both texts of the added conversation say this.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


_ESCAPED = r"regexp_replace(body, '<(\\*)\|', '<\1\\|', 'g')"
CHAT_SQL = rf"""
with t as (select conv_id, turn, role, coalesce(text, '') as body from conversations
  union all select -1, i, case i when 0 then 'user' else 'assistant' end, '{CONTROL_TEXT}' from range(2) r(i)),
s as (select *, length(role) + length({_ESCAPED}) + {len(chat.START + chat.END) + 1} as size from t),
p as (select *, sum(size) over (partition by conv_id order by turn, role, body rows unbounded preceding) as upto from s)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn, role, body)) as turns_sha256,
  cast(coalesce(sum(length(body)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(body, '' order by turn, role, body) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars, count(*) filter (where role = 'assistant') as n_examples,
  cast(coalesce(sum(upto) filter (where role = 'assistant'), 0) as bigint) as example_chars
from p group by conv_id
"""


@query("op9_prefix_target_chat", CHAT_SQL)
def prefix_target_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).selectExpr(
        "-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{CONTROL_TEXT}' as text"
    )
    scratch = Scratch(spark, "chat")
    formatted, targets = chat.write_examples(turns.unionByName(added), scratch)
    return scratch.finish(chat.conversation_digests(formatted, targets))


MINHASH_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, case when len(ws) >= {SHINGLE} then list_transform(range(1, len(ws) - {SHINGLE - 2}),
  lambda i: array_to_string(ws[i : i + {SHINGLE - 1}], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')]
  else [] end as gs from w),
s as (select distinct doc_id, unnest(gs) as shingle from g),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as u, b.doc_id as v, count(*) as i from s a join s b on a.shingle = b.shingle
  and a.doc_id <> b.doc_id group by 1, 2),
links as (select u, v from common join n x on x.doc_id = u join n y on y.doc_id = v where 100 * i >= 75 * (x.n + y.n - i)),
{REACH_SQL}
select g.doc_id, coalesce(n.n, 0) as n_shingles, least(g.doc_id, coalesce(p.low, g.doc_id)) as component_id,
  g.doc_id <= coalesce(p.low, g.doc_id) as kept
from g left join n on n.doc_id = g.doc_id left join parts p on p.u = g.doc_id
"""


@query("op10_minhash_near_dedup", MINHASH_SQL)
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op11_diagonal_alignment")
def diagonal_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_documents(table(spark, folder, "documents"), *paths)


COLLOCATION_SQL = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
s as (select lang, ws, unnest(range(1, {collocation.LONGEST + 1})) as m from w),
i as (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from s),
f as (select lang, array_to_string(ws[i : i + m - 1], ' ') as phrase, m, count(*) as a from i group by 1, 2, 3),
t as (select lang, sum(a) as n from f where m = 1 group by 1),
c as (select lang, phrase, m, a, string_split(phrase, ' ') as ws from f where m > 1 and a >= {collocation.LEAST}),
k as (select *, unnest(range(1, m)) as k from c),
q as (select k.lang, k.phrase, k.m, k.a, k.k, x.a as l, y.a as r, t.n,
  (1000::hugeint * k.a * t.n) // (x.a::hugeint * y.a) as score from k join t on t.lang = k.lang
  join f x on x.lang = k.lang and x.phrase = array_to_string(k.ws[: k.k], ' ')
  join f y on y.lang = k.lang and y.phrase = array_to_string(k.ws[k.k + 1 :], ' ')),
b as (select *, row_number() over (partition by lang, phrase order by score, k) as place from q),
o as (select lang, a as f, ws, unnest(range(2, m)) as m from c),
e as (select lang, f, ws, m, unnest(range(1, len(ws) - m + 2)) as i from o),
h as (select lang, array_to_string(ws[i : i + m - 1], ' ') as phrase, max(f) as f from e group by 1, 2),
r as (select b.lang, b.phrase, b.a, b.l, b.r, b.n, b.score, row_number() over (partition by b.lang
  order by b.score desc, b.a desc, b.phrase) as rank from b left join h on h.lang = b.lang and h.phrase = b.phrase
  where b.place = 1 and (h.f is null or 100 * h.f < {collocation.SHARE} * b.a))
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from r where rank <= {collocation.TOP}
"""


@query("op12_collocation_automata", COLLOCATION_SQL)
def collocation_automata(spark: SparkSession, folder: str) -> DataFrame:
    return collocation.collocations(table(spark, folder, "documents"))


@query("op13_cost_balanced_packing")
def cost_balanced_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_index(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
