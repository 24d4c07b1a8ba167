from __future__ import annotations

import hashlib
import random

import pytest

from wicara.llm import warc
from wicara.llm.common import Scratch

LONG = "x" * 998 + "é"
PAGES = [
    (1, "http://www.Example.com/a?b=1#c", LONG),
    (2, "https://example.com/a?b=1", LONG),
    (9, "http://b.example.com", LONG),
    (3, "http://example.com/a", "x" * 999),
    (4, "http://example.com/a", "x" * 999),
    (5, None, None),
    (6, "ftp://h:81/p\r\nX: y", ""),
    (7, "http://t.org/", "WARC/1.1\r\nWARC-Type: fake\r\n\r\nbody\r\n\r\n" * 40),
    (8, "", "\r\n\r\n"),
    (9, "http://b.example.com", LONG),
    (None, "http://n.org/", LONG),
    (None, "http://n.org/", LONG),
    (10, "http://big.org/" + "p" * 5000, "é" * 700_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "z", 1) for p in PAGES], "page_id long, url string, html string, file string, page int")


@pytest.mark.parametrize("files", [1, 4])
def test_read_back(pages, files):
    got = warc.capture_index(pages, files=files, partitions=3).collect()
    want = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        same = [p for p, _, h in PAGES if h == html and p is not None]
        revisit = page is not None and len(body) >= 1000 and page != max(same)
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    order = [(r["urlkey"], r["captured"], r["file"], r["position"]) for r in sorted(got, key=lambda r: r["part"])]
    assert order == sorted(order)
    keys = {r["page_id"]: r["urlkey"] for r in got}
    assert keys[1] == keys[2] == "com,example)/a?b=1"


def test_archive_is_a_sequence_of_records(spark, pages):
    path = warc.write_archives(pages, Scratch(spark, "test"), 1)
    (data,) = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    records = list(warc.parse_records(data))
    assert len(records) == len(PAGES)
    for offset, head, payload in records:
        assert data[offset:].startswith(b"WARC/1.1\r\n") and int(head["Content-Length"]) == len(payload)
    with pytest.raises(ValueError):
        list(warc.parse_records(data[5:]))


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.randrange(50) for _ in range(r.choice([0, 1, 30]))) for _ in range(k)]
        assert list(warc.loser_tree_merge([iter(x) for x in runs], lambda v: v)) == sorted(v for x in runs for v in x)


def test_empty_table(pages):
    assert warc.capture_index(pages.where("false")).collect() == []
