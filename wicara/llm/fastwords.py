"""Ids of texts with a word-end BPE vocabulary, each distinct word encoded once.

Plain texts (printable ASCII and Latin letters, no special token strings) are cut by the vocabulary's
split rule into words: runs of letters, runs of signs and single digits. What stands between white space
and holds an apostrophe is one word, which the rule cuts further. Equal words of many texts are found by
sorting their bytes, so that Python meets each once. The merges are restated as byte ranks with a zero
byte for the end of a piece, so thousands of unknown pieces are encoded in one call. All other texts go
to the tokenizers library.
"""

from __future__ import annotations

import itertools
import json
import re

import numpy as np

from wicara.llm.bpe import byte_letters
from wicara.llm.tokenfile import tokenizer

_LETTER = "a-zß-öø-ÿ"  # what lower() leaves of the letters below
_OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]|<\\|")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^ \t\n\r0-9{_LETTER}]+")
_ALLOWED = np.zeros(256, bool)  # bytes of plain texts; 0xC3 leads the letters and two signs
_ALLOWED[[9, 10, 13, *range(32, 127), *range(128, 192), 0xC3]] = True


def all_plain(texts: list[str]) -> bool:
    """Whether no text holds anything ``_OTHER`` looks for (a quick check of all bytes at once)."""
    joined = "\n".join(texts)
    if "<|" in joined:
        return False
    data = np.frombuffer(joined.encode(), np.uint8)
    signs = (data[1:] == 0x97) | (data[1:] == 0xB7)
    return bool(_ALLOWED[data].all()) and not bool((signs & (data[:-1] == 0xC3)).any())


def byte_ranks(path: str) -> tuple[dict[bytes, int], np.ndarray]:
    """(rank by bytes, id by rank): bytes, bytes at the end of a piece, then merges in their order."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    value = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}

    def raw(token: str) -> bytes:
        ended = token.endswith(suffix)
        body = token[: -len(suffix)] if ended else token
        return b"".join([value[c] for c in body]) + (b"\0" if ended else b"")

    letters = [*value, *(c + suffix for c in value)]
    ranks: dict[bytes, int] = {}
    ids: list[int] = []
    for token in [*letters, *(a + b for a, b in model["merges"])]:
        if ranks.setdefault(raw(token), len(ids)) == len(ids):
            ids.append(vocab[token])
    return ranks, np.array(ids, np.int64)


class _Numbers(dict):
    """Numbers by word; an unknown word gets the next one."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


_SPACE, _LETTERS, _DIGIT, _SIGN = range(4)
_KIND = np.full(256, _SIGN, np.uint8)  # of bytes of plain texts in lower case
_KIND[: ord(" ") + 1], _KIND[ord("0") : ord("9") + 1], _KIND[ord("a") : ord("z") + 1], _KIND[128:] = _SPACE, _DIGIT, _LETTERS, _LETTERS
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of 8 bytes


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values of the runs ``at``, in turn."""
    sizes = sizes[at]
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts[at] - before, sizes) + np.arange(int(sizes.sum()))]


def _words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of plain texts, each at least once; for each occurrence its place there; occurrences in each text."""
    joined = "\n" + "\n".join(texts) + "\n"
    data = np.frombuffer((joined.lower() + "\n" * 16).encode(), np.uint8)
    lengths = np.fromiter(map(len, texts if joined.isascii() else map(str.encode, texts)), np.int64, len(texts))
    kinds = _KIND.take(data)
    quotes = np.flatnonzero(data == ord("'"))
    if len(quotes):
        edges = np.flatnonzero(np.diff(kinds == _SPACE)) + 1
        for i in np.unique(np.searchsorted(edges[::2], quotes, "right") - 1).tolist():
            kinds[edges[2 * i] : edges[2 * i + 1]] = _LETTERS
    edges = np.flatnonzero((kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)) + 1
    solid = kinds[edges] != _SPACE
    starts, sizes = edges[solid], np.diff(edges, append=len(data))[solid]
    counts = np.diff(np.searchsorted(starts, np.cumsum(np.append(0, lengths + 1))))
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    first = eight[starts] & _FIRST[np.minimum(sizes, 8)]
    second = eight[starts + 8] & _FIRST[np.clip(sizes - 8, 0, 8)]
    long = _Numbers()
    for i in np.flatnonzero(sizes > 16).tolist():
        first[i], second[i] = long[data[starts[i] : starts[i] + sizes[i]].tobytes()], _FIRST[8]  # no word has these bytes
    order = np.argsort(first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F))
    first, second = first[order], second[order]
    new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[: len(order)]
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    order = order[new]
    distinct = _gather(data, starts, sizes + 1, order)
    distinct[np.cumsum(sizes[order] + 1) - 1] = ord("\n")
    return distinct.tobytes().decode().split(), at, counts


class FastWordIds:
    """Ids of whole texts. Beyond ``LIMIT`` words or ``CHARS`` characters only those met more than once stay known."""

    LIMIT = 400_000
    CHARS = 20_000_000
    TOGETHER = 4_000_000  # characters looked up together

    def __init__(self, path: str):
        import tiktoken

        ranks, self.id_of = byte_ranks(path)
        self.ends = np.zeros(len(self.id_of), bool)
        for data, rank in ranks.items():
            self.ends[rank] = len(data) > 1 and data[-1] == 0
        self.encoder = tiktoken.Encoding("pieces", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={})
        self.library = tokenizer(path)
        self.index, self.chars = _Numbers(), 0
        self.ids, self.sizes, self.met = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        cut = [_PIECE.findall(w) if "'" in w else (w,) for w in words]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        found = np.array(self.encoder.encode_ordinary("\0".join(itertools.chain.from_iterable(cut)) + "\0"), np.int64)
        sizes = np.diff(np.flatnonzero(self.ends[found]), prepend=-1)
        sizes = np.add.reduceat(sizes, np.cumsum(counts) - counts)
        self.ids = np.concatenate([self.ids, self.id_of[found].astype(np.uint16)])
        self._place(np.concatenate([self.sizes, sizes]), np.concatenate([self.met, np.zeros(len(sizes), np.int64)]))

    def _place(self, sizes: np.ndarray, met: np.ndarray) -> None:
        self.sizes, self.met, self.starts = sizes, met, np.cumsum(sizes) - sizes

    def _forget(self) -> None:
        kept = np.flatnonzero(self.met > 1)
        words = list(self.index)
        self.ids = _gather(self.ids, self.starts, self.sizes, kept)
        self.index = _Numbers((words[i], n) for n, i in enumerate(kept.tolist()))
        self.chars = sum(map(len, self.index))
        self._place(self.sizes[kept], self.met[kept] // 2)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        words, at, counts = _words(texts)
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[at]
        if len(self.index) > known:
            fresh = list(itertools.islice(self.index, known, None))
            self.chars += sum(map(len, fresh))
            self._learn(fresh)
        self.met += np.bincount(at, minlength=len(self.met))
        ids = _gather(self.ids, self.starts, self.sizes, at)
        ends = np.concatenate([[0], np.cumsum(self.sizes[at])])[np.cumsum(np.append(0, counts))]
        if len(self.index) > self.LIMIT or self.chars > self.CHARS:
            self._forget()
        return [ids[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        held, chars = [], 0
        plain = all_plain([t for t in texts if t])
        for i, text in enumerate(texts):
            if not text:
                continue
            if not plain and _OTHER.search(text):
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)
                continue
            held.append(i)
            chars += len(text)
            if chars > self.TOGETHER:
                self._into(out, texts, held)
                held, chars = [], 0
        self._into(out, texts, held)
        return out

    def _into(self, out: list, texts: list, held: list[int]) -> None:
        for i, ids in zip(held, self._plain([texts[i] for i in held]), strict=True):
            out[i] = ids
