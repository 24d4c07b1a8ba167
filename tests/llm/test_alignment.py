from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wicara.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("seed", range(30))
def test_align_equals_overlaps(seed):
    """Groups and links against every pair of byte ranges."""
    r = random.Random(seed)
    total = r.randrange(1, 120)
    share = r.choice([0, 0.1, 0.5, 1])
    common = [i for i in range(1, total) if r.random() < 0.7]
    a = sorted({*(i for i in common if r.random() > share / 2), *r.sample(range(1, total + 1), int(share * total / 3)), total})
    b = sorted({*(i for i in common if r.random() > share / 2), *r.sample(range(1, total + 1), int(share * total / 3)), total})
    cut_a, cut_b, link_a, link_b = alignment.align(a, b)
    both = sorted(set(a) & set(b))
    assert [a[i - 1] for i in cut_a] == [b[i - 1] for i in cut_b] == both
    ranges = lambda ends: list(zip([0, *ends[:-1]], ends, strict=True))
    want = [(i, j) for i, (s, e) in enumerate(ranges(a)) for j, (t, f) in enumerate(ranges(b)) if s < f and t < e]
    assert sorted(zip(link_a, link_b, strict=True)) == want


class Library:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(i): i for i in letters}
        self.byte |= {chr(256 + n): i for n, i in enumerate(i for i in range(256) if i not in set(letters))}

    def tokens(self, text):
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        data = (" " + text).encode()
        if not text or b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
            return [], []
        return a, b


def brute_force(rows):
    lib, found, counts = Library(), [], Counter()
    for key, text in rows:
        a, b = lib.tokens(text or "")
        place = lambda ts: [(i, sum(len(x) for _, x in ts[:k]), sum(len(x) for _, x in ts[: k + 1])) for k, (i, _) in enumerate(ts)]
        pa, pb = place(a), place(b)
        links = [(i, j) for i, s, e in pa for j, t, f in pb if s < f and t < e]
        ends = sorted({e for _, _, e in pa} & {f for _, _, f in pb})
        groups = [
            ",".join(str(i) for i, s, e in pa if lo <= s and e <= hi) + "|" + ",".join(str(j) for j, t, f in pb if lo <= t and f <= hi)
            for lo, hi in zip([0, *ends[:-1]], ends)
        ]
        counts.update(set(links))
        found.append((key, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [
        (key, na, nb, len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "",
         sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links))
        for key, na, nb, groups, links in found
    ]


ODD = ["", None, " ", "\n", "a", "  two  blanks ", " \n x", "\n\nA b,\n c.", "<|endoftext|><s>", "<0x41> ▁x", "tab\there", "a b　c",
       "\x00\x1c\x85", "日本語 text, é. 'tis don't I'll,", "x.y.z... (a)", "²." , "naïve; café: Ünïcödé!?", "😀👍🏽 ok", "á é", "\r\n", "1,234.5"]


def rows_of(seed):
    r = random.Random(seed)
    words = ["the", "House", "cat", "été", "über", "12", "x1", "日本", "don't", "a" * 30, "_", "_.", "##", "İ", "Ω"]
    marks = [" ", " ", " ", "  ", "\n", ", ", ". ", "! ", "?", ";", "\n\n ", "\t", "-", "'s "]
    weights = [9, 9, 9, 2, 2, 3, 3, 1, 1, 1, 1, 0.2, 1, 1]
    texts = ["".join(r.choice(words) + r.choices(marks, weights)[0] for _ in range(r.randrange(20))) for _ in range(60)]
    return [(i if i % 7 else None, t) for i, t in enumerate([*ODD, *texts, texts[0]])]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("sent,part,limit", [(10**6, 10**6, 10**6), (0, 25, 20)])
def test_equals_brute_force(spark, seed, sent, part, limit):
    rows = rows_of(seed)
    df = spark.createDataFrame([(*t, 1, "c", "k") for t in rows], "doc_id long, text string, n_a int, codes string, key string")
    got = alignment.align_documents(df.repartition(3), A, B, sent_pairs=sent, part=part, limit=limit)
    order = lambda rs: sorted(rs, key=lambda r: (r[0] is not None, r))
    assert order(tuple(r) for r in got.collect()) == order(brute_force(rows))


def test_long_chunks_are_forgotten(monkeypatch):
    """Texts with other white space are chunks of their own and do not stay in memory."""
    monkeypatch.setattr(alignment, "CHARS", 5_000)
    aligner = alignment.Aligner(A, B)
    texts = [f"a tab\there, {i} " * 100 for i in range(40)] + ["plain words"]
    want = brute_force([(None, t) for t in texts])
    for text, row in zip(texts, want, strict=True):
        assert aligner.texts_aligned([text])[0][:5] == row[1:6]
        assert sum(map(len, aligner.index)) == aligner.chars <= 5_000


def test_one_very_long_text(spark):
    text = "A long text, with words; and 'marks'!\n" * 60_000 + "q" * 50_000
    lib = Library()
    df = spark.createDataFrame([(1, text), (2, text), (3, "A")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.align_documents(df, A, B, part=500_000).collect()}
    assert got[1][1:] == got[2][1:]
    assert got[1]["n_a"] == len(lib.a.encode(" " + text, add_special_tokens=False).ids) and got[1]["n_b"] == len(lib.b.encode(text))
    assert got[3]["count_sum"] == 3 * got[3]["n_links"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(df, A, B).collect() == []
