"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a slice of a partition are laid out as one chain of symbols. An index maps
every mergeable pair to all its positions in the slice; active ranks are applied in ascending
order to whole position lists, and only the lists of the neighbouring pairs are updated.

Null and empty texts have no ids. Rows are kept one for one, repeated ids and texts included.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from wicara.llm.common import lean, pieces, slices, small_batches, split_words

SLICE = 8_000_000  # characters whose distinct words are encoded together
KEPT = 60_000  # words a Python worker remembers between slices
NO_RANK = np.int64(1 << 40)
END_MARKS = ".,;:!?"
SLOTS = 1 << 18  # of the table of mergeable pairs


def in_class(kind: str) -> str:
    """Ranges of the characters of a general category (its first letter), for use inside brackets."""
    ranges: list[list[int]] = []
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(chr(i))[0] == kind:
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@functools.cache
def piece_pattern() -> re.Pattern:
    """The vocabulary's split rule: contractions, runs of letters, single digits, runs of other marks."""
    letters, numbers = in_class("L"), in_class("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^ {letters}{numbers}]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {b: chr(b) for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in stand_in):
        stand_in[b] = chr(256 + i)
    return [stand_in[b] for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab = data["model"]["vocab"]
        suffix = data["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = [""] * (max(*vocab.values(), *self.special.values(), 0) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.numerals = list(map(str, range(len(self.tokens))))
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        pairs = {}
        for rank, (a, b) in enumerate(data["model"]["merges"]):
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        rows = sorted((a << 20 | b, rank, new, a, b) for (a, b), (rank, new) in pairs.items())
        # open addressing: a fifth of the slots hold a pair, so few lookups need a second one
        self.slot_keys, self.slot_ranks = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int64)
        keys = np.array([r[0] for r in rows], np.int64)
        for key, rank, slot in zip(keys.tolist(), [r[1] for r in rows], self._slot(keys).tolist(), strict=True):
            while self.slot_keys[slot] >= 0:
                slot = (slot + 1) & (SLOTS - 1)
            self.slot_keys[slot], self.slot_ranks[slot] = key, rank
        self.rules = {r[1]: r[2:] for r in rows}
        self.split = piece_pattern().findall
        strings = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None

    @functools.cached_property
    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, new token) by pair, for merges sign by sign."""
        return {(a, b): (rank, new) for rank, (new, a, b) in self.rules.items()}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        slot = self._slot(key)
        found = self.slot_keys[slot]
        ranks = np.where(found == key, self.slot_ranks[slot], NO_RANK)
        open_at = np.flatnonzero((found != key) & (found >= 0))
        while len(open_at):
            slot[open_at] = (slot[open_at] + 1) & (SLOTS - 1)
            found = self.slot_keys[slot[open_at]]
            hit = found == key[open_at]
            ranks[open_at[hit]] = self.slot_ranks[slot[open_at[hit]]]
            open_at = open_at[~hit & (found >= 0)]
        return ranks

    @staticmethod
    def _slot(key):
        return (key * 0x2545F4914F6CDD1D >> 40) & (SLOTS - 1)

    def pieces(self, word: str) -> list[str]:
        """Normalised parts of a run without white space."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        word = word.replace("Σ", "σ").lower()  # lower case is taken sign by sign
        return [word] if word.isalpha() else self.split(word)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece, all pieces merged together through the pair index."""
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        if not lengths.sum():
            return [[] for _ in raw]
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        final = ends[lengths > 0] - 1
        symbol[final] = self.last[data[final]]
        size = len(symbol)
        after = np.arange(1, size + 1, dtype=np.int32)
        after[final] = -1
        before = np.arange(-1, size - 1, dtype=np.int32)
        before[0] = -1
        before[final[:-1] + 1] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        odd: list[np.ndarray] = []

        def add(positions: np.ndarray, current: int) -> None:
            ranks = self.rank_of(symbol[positions], symbol[after[positions]])
            found = ranks < NO_RANK
            positions, ranks = positions[found], ranks[found]
            if not len(ranks):
                return
            if current >= 0 and (early := ranks < current).any():
                odd.append(positions[early])
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(part)

        add(np.flatnonzero(after >= 0), -1)
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            new, a, b = self.rules[rank]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            right = after[at]
            live = (symbol[at] == a) & (right >= 0)
            live &= symbol[right] == b
            at, right = at[live], right[live]
            if a == b and len(at) > 1:  # of a run of equal symbols every other pair merges
                fresh = np.r_[True, at[1:] != right[:-1]]
                order = np.arange(len(at))
                first = np.maximum.accumulate(np.where(fresh, order, 0))
                live = (order - first) % 2 == 0
                at, right = at[live], right[live]
            if not len(at):
                continue
            beyond = after[right]
            symbol[at] = new
            symbol[right] = -1
            after[at] = beyond
            ahead = beyond >= 0
            before[beyond[ahead]] = at[ahead]
            behind = before[at]
            add(np.unique(np.concatenate([behind[behind >= 0], at[ahead]])), rank)
        kept = symbol >= 0
        flat = symbol[kept].tolist()
        counts = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])].tolist()
        out = [flat[s:e] for s, e in zip(counts[:-1], counts[1:], strict=True)]
        if odd:  # a merge opened a pair of lower rank: these pieces need sign-by-sign order
            for i in np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist():
                out[i] = self.encode_one(raw[i])
        return out

    def encode_one(self, data: bytes) -> list[int]:
        """One piece, always merging the leftmost pair of the lowest rank."""
        symbols = [int(self.inner[b]) for b in data]
        if symbols:
            symbols[-1] = int(self.last[data[-1]])
        while len(symbols) > 1:
            best = min((self.pairs.get(p, (NO_RANK, 0))[0], i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if best[0] == NO_RANK:
                break
            i = best[1]
            symbols[i : i + 2] = [self.pairs[symbols[i], symbols[i + 1]][1]]
        return symbols

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of runs without white space; strings of special tokens get their own ids."""
        pieces: dict[str, int] = {}
        number = pieces.setdefault
        plan: list[tuple[int, ...]] = []  # numbers of pieces; specials as negative numbers
        for word in words:
            if "<|" in word and self.marks:
                row: list[int] = []
                for part in self.marks.split(word):
                    if part in self.special:
                        row.append(-1 - self.special[part])
                    elif part:
                        row += [number(p, len(pieces)) for p in self.pieces(part)]
                plan.append(tuple(row))
                continue
            low = word.lower() if word.isascii() else ""
            if low.isalpha():
                plan.append((number(low, len(pieces)),))
            elif low[:-1].isalpha() and low[-1] in END_MARKS:  # the common case of the split rule
                plan.append((number(low[:-1], len(pieces)), number(low[-1], len(pieces))))
            else:
                plan.append(tuple([number(p, len(pieces)) for p in self.pieces(word)]))
        ids = self.encode_pieces(list(pieces))
        return [
            ids[row[0]] if len(row) == 1 and row[0] >= 0 else [i for n in row for i in (ids[n] if n >= 0 else (-1 - n,))]
            for row in plan
        ]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_words(split_words(text)) for i in ids]

    def decode(self, ids) -> str:
        """Token strings joined by a blank, as a tokenizer without a decoder step returns them."""
        return " ".join([self.tokens[i] for i in ids])


_LOADED: dict[str, WordBpe] = {}
_WORDS: dict[str, dict[str, tuple[str, int, str]]] = {}


def vocabulary(path: str) -> WordBpe:
    """The vocabulary at ``path``, read once in each Python process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def shown(bpe: WordBpe, words: list[str]) -> Iterator[tuple[str, tuple[str, int, str]]]:
    for word, ids in zip(words, bpe.encode_words(words), strict=True):
        yield word, (" ".join([bpe.numerals[i] for i in ids]), len(ids), bpe.decode(ids))


def groups(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Runs of (row, slices of its text) with about ``size`` characters; long texts get several."""
    group, chars = [], 0
    for key, text in rows:
        for i, part in enumerate(slices(text or "", size)):
            group.append((key, i == 0, part))
            chars += len(part) + 200
            if chars > size:
                yield group
                group, chars = [], 0
    if group:
        yield group


def encoded(batches, path: str, size: int = SLICE):
    """Arrow batches (id, text) to (id, n_tokens, ids_sha256, decoded_sha256)."""
    import pyarrow as pa

    bpe = vocabulary(path)
    kept = _WORDS.setdefault(path, {})

    def rows():
        for batch in pieces(batches):
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    def pack(done):
        names = ("key", "n_tokens", "ids_sha256", "decoded_sha256")
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=list(names)
        )

    state = None  # (key, tokens so far, hash of ids, hash of decoded text)
    for group in groups(rows(), size):
        fresh: set[str] = set()
        for _, _, part in group:  # split again below: the words of a slice are not held, only their kinds
            fresh.update(split_words(part))
        fresh -= kept.keys()
        own = dict(shown(bpe, list(fresh)))
        done = []
        for key, first, part in group:
            words = split_words(part)
            if first:
                if state:
                    done.append((state[0], state[1], state[2].hexdigest(), state[3].hexdigest()))
                state = [key, 0, hashlib.sha256(), hashlib.sha256()]
            if not words:
                continue
            found = [kept.get(w) or own[w] for w in words]
            lead = " " if state[1] else ""
            state[2].update((lead + " ".join([f[0] for f in found])).encode())
            state[3].update((lead + " ".join([f[2] for f in found])).encode())
            state[1] += sum([f[1] for f in found])
        if len(kept) < KEPT:
            kept.update(itertools.islice(own.items(), KEPT - len(kept)))
        if done:
            yield pack(done)
    if state:
        yield pack([(state[0], state[1], state[2].hexdigest(), state[3].hexdigest())])


def encode_digests(docs: DataFrame, vocab: str, doc_id: str = "doc_id", text: str = "text", size: int = SLICE) -> DataFrame:
    """Encode and decode every whole text; digests of ids and decoded text per row.

    Row-local: no shuffle, memory bounded by one slice of about ``size`` characters (or the longest run
    without blanks). Smaller slices share fewer words: less memory, more time. ``vocab`` is the path of
    the tokenizer file on every worker. Columns other than the two named are not read.
    """
    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    small_batches(docs.sparkSession)
    narrow = docs.select(docs[doc_id].cast("long").alias("key"), docs[text].cast("string").alias("body"))
    return narrow.mapInArrow(lean(lambda batches: encoded(batches, vocab, size)), schema).withColumnRenamed("key", doc_id)


def token_ids(docs: DataFrame, vocab: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array) of every text, by the same method."""

    def run(batches):
        import pyarrow as pa

        bpe = vocabulary(vocab)
        for batch in pieces(batches):
            texts = [split_words(t or "") for t in batch.column(1).to_pylist()]
            words = list(set().union(*texts))
            look = dict(zip(words, bpe.encode_words(words), strict=True))
            ids = [[i for w in words for i in look[w]] for words in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    narrow = docs.select(docs[doc_id].cast("long").alias("key"), docs[text].cast("string").alias("body"))
    return narrow.mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", doc_id)
