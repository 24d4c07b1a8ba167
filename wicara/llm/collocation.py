"""Phrases that occur together more often than their parts, counted with weighted acyclic automata.

1. Words are counted per language. 2. Pairs of words that reach ``least`` are counted by hash. Both
only serve to skip n-grams that cannot reach ``least``: no n-gram is more frequent than its words or
pairs. They are sent as bit filters of ``Bounds.filter_bits`` bits, whose false hits cost time, not results.
3. Each shard (a run of words of one language in a partition) sorts its remaining n-grams and builds
count automata from them, one per prefix range: all n-grams with the same first word, and for the at
most 1,000 words with a thousandth of all words each, the same first character of the second word.
4. The automata of a range are united and their weights summed; words join as automata of their own.
5. Every cut of every phrase is looked up by composing its parts with the automata of their ranges.

Defined results: null texts are empty, null languages ``und``; rows that repeat count again; texts of
any length are read in parts that never cut a word or an n-gram; equal scores are ordered by count, then
by phrase in byte order; an empty table gives no phrase. Columns other than the two are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wicara.llm.automata import Automaton, build, unite
from wicara.llm.common import Scratch, lean, pieces

LEAST = 100  # occurrences of a phrase
LONGEST = 5  # words
TOP = 2000  # phrases of each language
SHARE = 100  # percent of a phrase's occurrences inside a longer one at which it is dropped


@dataclass(frozen=True)
class Bounds:
    """What a task holds at a time; no result depends on these."""

    filter_bits: int = 1 << 25
    shard: int = 1 << 21  # words
    words: int = 500_000  # distinct words counted before they are handed on
    pairs: int = 1 << 22  # pairs counted before they are handed on
    part: int = 4_000_000  # bytes split into words
    together: int = 64  # automata united


_BREAK = 0xFF  # in no UTF-8 text: ends a piece
_SIGNS = bytearray(range(256))
for _c in range(0x41, 0x5B):
    _SIGNS[_c] = _c + 32
for _c in (*b".,;:!?", *range(0x0A, 0x0E)):
    _SIGNS[_c] = _BREAK
_SIGNS[9] = 32
_SIGNS = bytes(_SIGNS)


def word_parts(text: bytes, part: int) -> Iterator[list[bytes]]:
    """Words and piece ends of a text, in parts of about ``part`` bytes."""
    data = text.translate(_SIGNS)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > part:
            found = [i for i in (data.find(b" ", at + part), data.find(b"\xff", at + part)) if i >= 0]
            end = min(found, default=end)
        yield [w for w in data[at:end].replace(b"\xff", b" \xff ").split(b" ") if w]
        at = end


def by_language(batches) -> Iterator[tuple[str, bytes]]:
    """(language, texts joined by line feeds, which end a piece) of Arrow batches (language, text)."""
    for batch in pieces(batches):
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            yield lang, "\n".join(some).encode()


def _count_words(bounds: Bounds):
    @lean
    def run(batches):
        import pyarrow as pa

        counts: dict[str, Counter] = {}

        def rows():
            for lang, found in counts.items():
                found.pop(b"\xff", None)
                words = pa.array(list(found), pa.binary()).cast(pa.string())
                langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(words), np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [langs, words, pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"]
                )

        for lang, text in by_language(batches):
            for words in word_parts(text, bounds.part):
                counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > bounds.words:
                yield from rows()
                counts = {}
        yield from rows()

    return run


def bit_filter(hashes: DataFrame, column: str, size: int) -> bytes:
    """Bits of all values of a long column, ``size`` (a power of two) in all, whatever the number of rows."""
    slot = F.col(column).bitwiseAND(F.lit(size - 1))
    blocks = (
        hashes.select(F.shiftright(slot, 15).alias("block"), slot.bitwiseAND(F.lit(32767)).alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()  # at most size / 32768 rows of 4 KB
    )
    out = bytearray(size // 8)
    for row in blocks:
        out[row["block"] * 4096 : row["block"] * 4096 + len(row["bits"])] = row["bits"]
    return bytes(out)


def hits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def word_hash(lang: str, word: bytes) -> int:
    """The same as xxhash64 of ``lang``, a tab and the word in SQL."""
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode() + b"\t" + word, 42)


class FrequentWords(dict):
    """Numbers from 1 of the words of a language that pass the filter; 0 for all others."""

    def __init__(self, lang: str, bits: np.ndarray, bounds: Bounds):
        super().__init__({b"\xff": 0})
        self.lang, self.bits, self.bounds = lang, bits, bounds
        self.words: list[bytes] = [b""]
        self.hashes: list[int] = [0]

    def __missing__(self, word: bytes) -> int:
        value = word_hash(self.lang, word)
        slot = value & (len(self.bits) * 8 - 1)
        number = 0
        if self.bits[slot >> 3] >> (slot & 7) & 1:
            number = len(self.words)
            self.words.append(word)
            self.hashes.append(value)
        self[word] = number
        return number

    def numbers(self, text: bytes) -> np.ndarray:
        """Numbers of the words of a text in turn, 0 also where a piece ends."""
        if len(self) > 2 * self.bounds.words:  # rare words are looked up again
            for word in [w for w, i in self.items() if not i]:
                del self[word]
            self[b"\xff"] = 0
        parts = [np.fromiter(map(self.__getitem__, words), np.int32, len(words)) for words in word_parts(text, self.bounds.part)]
        return np.concatenate([*parts, np.zeros(1, np.int32)])


def pair_hashes(numbers: np.ndarray, words: FrequentWords) -> tuple[np.ndarray, np.ndarray]:
    """(places where two frequent words follow one another, hash of each pair)."""
    at = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
    of = np.array(words.hashes, np.uint64)
    x = of[numbers[at]] * np.uint64(0x9E3779B97F4A7C15) + of[numbers[at + 1]]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return at, x ^ x >> np.uint64(29)


def _count_pairs(filters, bounds: Bounds):
    @lean
    def run(batches):
        import pyarrow as pa

        bits = np.frombuffer(filters.value, np.uint8)
        index: dict[str, FrequentWords] = {}
        held, count = [], 0

        def rows():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for lang, text in by_language(batches):
            words = index.setdefault(lang, FrequentWords(lang, bits, bounds))
            _, keys = pair_hashes(words.numbers(text), words)
            held.append(keys)
            count += len(keys)
            if count > bounds.pairs:
                yield rows()
                held, count = [], 0
        if held:
            yield rows()

    return run


def shard_ngrams(numbers: np.ndarray, linked: np.ndarray, words: list[bytes]) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """Sorted distinct runs of linked words, ``LONGEST`` at most, with their counts.

    Each place gives the longest run that starts there; shorter n-grams are the starts of these.
    """
    at = np.flatnonzero(linked)
    padded = np.concatenate([linked, np.zeros(LONGEST, bool)])
    used = np.unique(np.concatenate([numbers[at], numbers[at + 1]]))
    order = sorted(used.tolist(), key=words.__getitem__)
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    rows = np.zeros((len(at), LONGEST), np.int64)
    rows[:, 0], rows[:, 1] = rank[numbers[at]], rank[numbers[at + 1]]
    goes_on = np.ones(len(at), bool)
    for k in range(2, LONGEST):
        goes_on = goes_on & padded[at + k - 1]
        rows[goes_on, k] = rank[numbers[at[goes_on] + k]]
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, int)
    counts = np.diff(np.append(new, len(rows)))
    by_rank = [b"", *[words[i] for i in order]]
    for row, n in zip(rows[new].tolist(), counts.tolist(), strict=True):
        yield tuple([by_rank[i] for i in row if i]), n


class Ranges:
    """Prefix ranges of n-grams: the first word, and the second one's first character after hot words."""

    def __init__(self, hot: set[tuple[str, str]]):
        self.hot = {(lang, word.encode()) for lang, word in hot}

    def of(self, lang: str, ngram: tuple[bytes, ...]) -> bytes:
        if len(ngram) > 1 and (lang, ngram[0]) in self.hot:
            return ngram[0] + b" " + ngram[1].decode()[0].encode()
        return ngram[0]


RANGE = "lang string, prefix binary, automaton binary"


def _range_batch(rows: list[tuple[str, bytes, bytes]]):
    import pyarrow as pa

    langs, prefixes, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(prefixes, pa.binary()), pa.array(data, pa.binary())],
        names=["lang", "prefix", "automaton"],
    )


def split_ranges(lang: str, ngrams, ranges: Ranges, counted_from: int = 2) -> Iterator[tuple[str, bytes, bytes]]:
    """One automaton of each prefix range of sorted n-grams."""
    prefix, held = None, []
    for ngram, n in ngrams:
        own = ranges.of(lang, ngram)
        if own != prefix and held:
            yield lang, prefix, build(held, counted_from).to_bytes()
            held = []
        prefix = own
        held.append((ngram, n))
    if held:
        yield lang, prefix, build(held, counted_from).to_bytes()


def _build_shards(word_filter, pair_filter, ranges: Ranges, bounds: Bounds):
    @lean
    def run(batches):
        word_bits, pair_bits = np.frombuffer(word_filter.value, np.uint8), np.frombuffer(pair_filter.value, np.uint8)
        index: dict[str, FrequentWords] = {}
        held: dict[str, list[np.ndarray]] = {}

        def shard(lang: str):
            numbers, words = np.concatenate(held.pop(lang)), index[lang]
            at, keys = pair_hashes(numbers, words)
            linked = np.zeros(len(numbers), bool)
            linked[at[hits(pair_bits, keys)]] = True
            rows = []
            for row in split_ranges(lang, shard_ngrams(numbers, linked, words.words), ranges):
                rows.append(row)
                if len(rows) >= 2000:
                    yield _range_batch(rows)
                    rows = []
            if rows:
                yield _range_batch(rows)

        for lang, text in by_language(batches):
            words = index.setdefault(lang, FrequentWords(lang, word_bits, bounds))
            held.setdefault(lang, []).append(words.numbers(text))
            if sum(map(len, held[lang])) > bounds.shard:
                yield from shard(lang)
        for lang in list(held):
            yield from shard(lang)

    return run


def _word_automata(ranges: Ranges):
    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = [
                (lang, *next(split_ranges(lang, [((word.encode(),), n)], ranges, 1))[1:])
                for lang, word, n in zip(*columns, strict=True)
            ]
            if rows:
                yield _range_batch(rows)

    return run


def _unite(least: int, bounds: Bounds):
    @lean
    def run(batches):
        key, held, rows = None, [], []
        for batch in batches:
            for lang, prefix, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (lang, prefix) != key:
                    if held:
                        rows.append((*key, unite(held, least).to_bytes()))
                    key, held = (lang, prefix), []
                held.append(Automaton.from_bytes(data))
                if len(held) >= bounds.together:
                    held = [unite(held)]
            if len(rows) >= 1000:
                yield _range_batch(rows)
                rows = []
        if held:
            rows.append((*key, unite(held, least).to_bytes()))
        if rows:
            yield _range_batch(rows)

    return run


@lean
def _phrases(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            out += [(lang, b" ".join(p).decode(), n) for p, n in Automaton.from_bytes(data).paths() if len(p) > 1]
        if out:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)],
                names=["lang", "phrase", "a"],
            )


QUESTION = "lang string, prefix binary, part binary, phrase string, a long, cut int, side int"


def _questions(ranges: Ranges):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for lang, phrase, a in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = tuple(phrase.encode().split(b" "))
                for k in range(1, len(words)):
                    for side, part in enumerate((words[:k], words[k:])):
                        out.append((lang, ranges.of(lang, part), b" ".join(part), phrase, a, k, side))
            if out:
                types = (pa.string(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.int32())
                names = ["lang", "prefix", "part", "phrase", "a", "cut", "side"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names
                )

    return run


@lean
def _compose(batches):
    """Rows of a range in order: its automaton, then the parts asked for, sorted."""
    import pyarrow as pa

    key, automaton = None, None

    def answers(asked):
        counts = list(automaton.compose([tuple(r["part"].split(b" ")) for r in asked])) if asked else []
        return [(r["lang"], r["phrase"], r["a"], r["cut"], r["side"], n) for r, n in zip(asked, counts, strict=True)]

    for batch in batches:
        out, asked = [], []
        for row in batch.to_pylist():
            if (row["lang"], row["prefix"]) != key:
                out += answers(asked)
                key, automaton, asked = (row["lang"], row["prefix"]), Automaton([()]), []
            if row["automaton"] is not None:
                automaton = Automaton.from_bytes(row["automaton"])
            else:
                asked.append(row)
        out += answers(asked)
        if out:
            types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            names = ["lang", "phrase", "a", "cut", "side", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def count_words(texts: DataFrame, bounds: Bounds) -> DataFrame:
    """(lang, word, n) of every word."""
    return texts.mapInArrow(_count_words(bounds), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_automata(texts: DataFrame, words: DataFrame, scratch: Scratch, least: int, bounds: Bounds) -> tuple[DataFrame, Ranges]:
    """One automaton of each prefix range, with the n-grams of ``least`` occurrences or more."""
    context = texts.sparkSession.sparkContext
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= least)
    # at most 1,000 words can have a thousandth of all words each
    hot = frequent.where(F.col("n") * 1000 >= total).select("lang", "word").collect() if total else []
    ranges = Ranges({(r["lang"], r["word"]) for r in hot})
    hashed = frequent.select(F.xxhash64(F.concat("lang", F.lit("\t"), "word")).alias("hash"))
    word_filter = context.broadcast(bit_filter(hashed, "hash", bounds.filter_bits))
    pairs = texts.mapInArrow(_count_pairs(word_filter, bounds), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pair_filter = context.broadcast(bit_filter(pairs.where(F.col("n") >= least), "pair", bounds.filter_bits))
    shards = texts.mapInArrow(_build_shards(word_filter, pair_filter, ranges, bounds), RANGE)
    single = frequent.select("lang", "word", "n").mapInArrow(_word_automata(ranges), RANGE)
    dealt = shards.unionByName(single).repartition("lang", "prefix").sortWithinPartitions("lang", "prefix")
    united = scratch.write(dealt.mapInArrow(_unite(least, bounds), RANGE), "united")
    word_filter.destroy()
    pair_filter.destroy()
    return united, ranges


def look_up_parts(phrases: DataFrame, united: DataFrame, ranges: Ranges) -> DataFrame:
    """(lang, phrase, a, cut, l, r): counts of the first ``cut`` words and of the rest."""
    asked = phrases.select("lang", "phrase", "a").mapInArrow(_questions(ranges), QUESTION)
    both = united.unionByName(asked, allowMissingColumns=True)
    dealt = both.repartition("lang", "prefix").sortWithinPartitions("lang", "prefix", "part")  # nulls, the automata, first
    answers = dealt.mapInArrow(_compose, "lang string, phrase string, a long, cut int, side int, n long")
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("n")))
    return answers.groupBy("lang", "phrase", "a", "cut").agg(side(0).alias("l"), side(1).alias("r"))


def inside_longer(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase) of those with ``share`` percent of their occurrences or more inside a longer one."""
    words = F.split("phrase", " ")
    long = phrases.where(F.size(words) > 2).select("lang", F.col("a").alias("f"), words.alias("w"))
    sized = long.select("lang", "f", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    starts = sized.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    parts = starts.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("f").alias("f"))
    held = phrases.join(parts, ["lang", "phrase"])
    return held.where(100 * F.col("f") >= share * F.col("a")).select("lang", "phrase")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    share: int = SHARE,
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """The ``top`` phrases of each language by how much more often they occur than their parts suggest."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "collocation")
    texts = docs.select(
        F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("body"),
    )
    words = scratch.write(count_words(texts, bounds), "words")
    united, ranges = count_automata(texts, words, scratch, least, bounds)
    phrases = scratch.write(united.mapInArrow(_phrases, "lang string, phrase string, a long"), "phrases")
    cuts = look_up_parts(phrases, united, ranges).join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang")
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    scored = cuts.withColumns({"above": F.lit(1000) * wide("a", 18) * wide("n", 15), "below": wide("l", 18) * wide("r", 18)})
    best = scored.select("lang", "phrase", "a", "n", F.struct(F.expr("above div below").alias("score"), "cut", "l", "r").alias("c"))
    lowest = best.groupBy("lang", "phrase", "a", "n").agg(F.min("c").alias("c"))
    kept = lowest.join(inside_longer(phrases, share), ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "n", "c.l", "c.r", "c.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return scratch.finish(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
