from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from wicara.llm import pii

FORMS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m)) <= 19 and checks(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m)) <= 15),
]


def digits(text):
    return re.sub("[^0-9]", "", text)


def checks(number):
    total = sum(int(d) for d in number[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in number[-2::-2])
    return total % 10 == 0


def plain(text):
    found = []
    for k, (_, form, ok) in enumerate(FORMS):
        found += [(m.start(), k, m.end()) for m in form.finditer(text) if ok(m.group())]
    return sorted(found)


def test_fixed_forms_equal_plain_patterns():
    r = random.Random(2)
    parts = ["a@b.c", "x.y+z@q-r.co.uk", "@", "a@b", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "00012.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0199", "+44 20 7946 0958", "+1 ((((", "12", "-", ".", " ", "é", "\n", "+", "99999999999999999999", "a@b.c@d.e"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        assert pii.fixed_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "+1" + "(" * 400_000, "1." * 200_000, "a." * 200_000 + "@"):
        pii.fixed_spans(text)


def test_masking():
    assert pii.masked("to a@b.c or 1.2.3.4!", pii.fixed_spans("to a@b.c or 1.2.3.4!")) == "to [EMAIL] or [IP]!"
    assert pii.masked("0123456789", [(2, 1, 5), (4, 2, 8)]) == "01[IP]89"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i}. please call me at +1 (212) 555-0{i:03d} today") for i in range(40)]
    rows += [(100 + i, f"really call me at 555.0{i:03d}x{i} soon; the room is R2D{i}00 there") for i in range(5)]
    rows += [(200, None), (201, ""), (202, "clean words only"), (203, "bob@example.com bob@example.com"), (203, "bob@example.com bob@example.com"), (None, "9.8.7.6"), (205, "w " * 300_000 + "9.8.7.6")]
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, base int, key string")


def test_base_spans_and_bootstrapped_identifiers(docs):
    got = pii.personal_data(docs).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for row in got:
        spans = plain(texts[row["doc_id"]])
        listed = ",".join(f"{FORMS[k][0]}:{s}:{e}" for s, k, e in spans)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in spans) for i in range(4)]
        assert set(filter(None, listed.split(","))) <= set(row["spans"].split(","))
    extra = {r["doc_id"]: r["spans"] for r in got if r["n_found"]}
    assert sorted(extra) == [100, 101, 102, 103, 104]  # known place, unseen form; the room number stays
    for i, spans in extra.items():
        kind, s, e = spans.split(":")
        assert kind == "phone" and texts[i][int(s) : int(e)] == f"555.0{i - 100:03d}x{i - 100}"


def test_redaction_keeps_rows_and_columns(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by_id[3] == "text 3. please call me at [PHONE] today"
    assert by_id[100].startswith("really call me at [PHONE] soon; the room is R2D000")
    assert by_id[200] is None and by_id[202] == "clean words only"


def test_empty_table(docs):
    assert pii.personal_data(docs.where("false")).collect() == []
    assert pii.redact(docs.where("false")).collect() == []


def test_candidates_of_long_runs_take_linear_time():
    began = time.perf_counter()
    assert pii.candidates("a" * 40_000, []) == []
    assert pii.candidates("語" * 40_000 + " x1234", []) == [(40_001, 40_006)]
    assert pii.candidates("a" * 40_000 + "1", []) == [(0, 40_001)]
    assert time.perf_counter() - began < 5


def test_candidates_are_whole_runs():
    r = random.Random(6)
    run = re.compile(r"[^\s\"'<>()\[\]{},;:=|]+")
    for _ in range(4000):
        text = "".join(r.choice("ab12@é .!-,:=|'\"()[]{}<>;\n") for _ in range(r.randrange(40)))
        runs = [(m.start(), m.start() + len(m.group().rstrip(".!?"))) for m in run.finditer(text) if re.search("[0-9@]", m.group())]
        assert pii.candidates(text, []) == [(s, e) for s, e in runs if e - s >= 5]
