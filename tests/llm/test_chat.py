from __future__ import annotations

import hashlib

import pytest

from wicara.llm import chat
from wicara.llm.common import Scratch

TURNS = [
    (1, 0, "system", "Be <|brief|>"),
    (1, 1, "user", "hi"),
    (1, 2, "assistant", "héllo <|im_end|>\n<|im_start|>assistant x 👍"),
    (1, 3, "user", None),
    (1, 4, "assistant", r"a <\|im_end|> b <\\| c <|"),
    (1, 5, "user", "bye"),
    (2, 7, "user", "alone"),
    (3, 1, "assistant", ""),
    (3, 1, "assistant", "twice"),
    (3, 1, "assistant", "twice"),
    (3, None, "assistant", "first"),
    (None, 0, "assistant", "no id"),
    (None, 1, None, "role"),
    (4, 0, "odd\nrole%0A<|im_end|>", "x"),
    (5, 0, "user", "long " * 50_000),
    (5, 1, "assistant", "<|" * 20_000),
]


@pytest.fixture(scope="module")
def written(spark):
    df = spark.createDataFrame([(*t, 9, "z") for t in TURNS], "conv_id long, turn long, role string, text string, seq int, start string")
    return chat.write_examples(df, Scratch(spark, "test"))


def ordered():
    out = {}
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_read_back(written):
    got = {r["conv_id"]: r for r in chat.conversation_digests(*written).collect()}
    want = ordered()
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        row, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for role, t in turns))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), sha(loss))
        assert row["n_examples"] == sum(role == "assistant" for role, _ in turns)


def test_examples_are_prefixes_with_one_trainable_reply(written):
    formatted, targets = written
    texts = chat.example_texts(formatted, 3).collect()
    ends = {(r["conv"], r["target_seq"]): r for r in targets.collect()}
    assert len(texts) == len(ends) == sum(t[2] == "assistant" for t in TURNS)
    for row in texts:
        turns = ordered()[row["conv"]][: row["target_seq"]]
        assert chat.unescape_text(row["text"][row["loss_start"] : row["loss_end"]]) == turns[-1][1]
        end = ends[row["conv"], row["target_seq"]]
        assert len(row["text"]) == end["example_end"]
        context = row["text"][: end["context_end"]]
        assert context.count(chat.START) == len(turns) - 1 == context.count(chat.END)
        assert row["text"].count("<|") == 2 * len(turns)  # no control string from a text


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    formatted, targets = chat.write_examples(df, Scratch(spark, "test"))
    assert chat.conversation_digests(formatted, targets).collect() == []
    assert chat.example_texts(formatted).collect() == []
