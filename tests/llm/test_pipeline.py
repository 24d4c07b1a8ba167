from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from wicara.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": ["ba", "lo", "mi", "ta"], "bb": ["trx", "kst", "ße", "wun"]}
r = random.Random(4)


def prose(lang, words=60):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.choice([2, 3, 4, 5]))) for _ in range(words))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with one case for each stage, and what has to become of them."""
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose("aa", 20)) for i in range(5)]
    docs, gone, changed = [], set(), {}
    for i in range(60):
        lang = "ab"[i % 2] * 2
        docs.append((i, prose(lang), lang, "s", 0))
    copy = docs[8][1].split()
    copy[30] = "changed"
    for i, text in ((100, docs[8][1]), (101, " ".join(copy)), (102, docs[8][1].upper())):
        docs.append((i, text, "bb", "s", 0))
        gone.add(i)
    for i, text in ((200, "1234 !? 99"), (201, ""), (202, None)):
        docs.append((i, text, "aa", "s", 0))
        gone.add(i)
    for i, (_, item) in enumerate(items):
        words = item.split()
        words[3 + i] = "other"
        docs.append((300 + i, f"{prose('aa', 30)} {' '.join(words)} {prose('aa', 30)}", "aa", "s", 0))
        gone.add(300 + i)
    for i in range(3):
        head, tail = prose("aa", 20), prose("aa", 20)
        docs.append((400 + i, f"{head} me{i}@example.com {tail}", "aa", "s", 0))
        changed[400 + i] = f"{head} [EMAIL] {tail}"
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, gone, changed


def test_run_equals_the_planted_result(spark, planted):
    folder, docs, gone, changed = planted
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, *_ in docs:
        if i not in gone:
            ids = library.encode(changed.get(i, text), add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((x["doc_id"], x["n_tokens"], x["ids_sha256"]) for x in got) == sorted(want)


def test_stages_keep_the_columns_of_documents(spark, planted):
    folder, docs, _, _ = planted
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "minhash_near_dedup", "benchmark_decontamination", "personal_data", "bpe_encoding",
    ]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], f"{SCHEMA}, key string, component_id int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).columns == frame.columns


def test_stages_take_an_empty_table(spark, planted):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), planted[0]).collect() == []


def test_registered_queries():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES)


def test_null_ids_and_repeated_rows(spark, tmp_path):
    one, two, three, item = prose("aa"), prose("aa"), prose("bb"), prose("aa", 20)
    bad, clean = f"{prose('bb', 30)} {item}", prose("bb")
    rows = [(None, one), (7, one), (3, one), (4, two), (4, two), (None, three), (None, three), (None, bad), (9, f"{prose('aa')} {item}"), (None, clean)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], SCHEMA)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated):
        docs = stage(spark, docs, str(tmp_path))
    got = sorted(((x["doc_id"], x["text"]) for x in docs.collect()), key=str)
    assert got == sorted([(3, one), (4, two), (None, three), (None, clean)], key=str)
