"""Token files: ids compressed by an adaptive context-mixing coder.

Texts are tokenized in id order and cut into blocks of ``BLOCK`` ids that are coded independently,
each from a reset model and with checksums. Within a block, the id that last followed the two ids
before (order 2), the id that last followed the id before (order 1) and the id last seen with the
same low byte (order 0) are predicted. An entropy coder (rANS) writes which prediction holds; the low
bytes of ids that neither order 2 nor order 1 names and the high bytes that order 0 does not name
follow as they are. The chance of each outcome mixes the counts of the joint context, of order 2, of
order 1 and of order 0, weighted by how well each has foretold the outcomes so far, and is renewed
after the steps in ``RENEWALS``. All blocks of a chunk are coded side by side, one id of each at a
time, in integer arithmetic; the arrays of a step are as narrow as their values allow.

A block holds the number of coder words, the number of low bytes, the coder's state (high word first)
and words, the low bytes and the high bytes, filled up to whole words.

A chunk is self-contained: a fixed head, document ids, lengths, blocks, and a checksum; Spark's text
writer ends it with a line feed, which belongs to the format. Files hold chunks in id order.

Defined results: null and empty texts hold the end id alone; null ids come first; rows that repeat
an id are documents of their own, in text order. Columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wicara.llm.common import Scratch, lean

BLOCK = 2048
RENEWALS = frozenset((63, 255, 767, 1407))
CHUNK = 4096 * BLOCK  # ids that start a new chunk
BITS2, BITS1 = 8, 8  # slots of a block's tables, as powers of two
END_ID = 2
LARGEST_ID = (1 << 16) - 2
MAGIC = b"WTK3"
_HEAD = struct.Struct("<4sQQQII")  # magic, bytes after the head, documents, ids, block size, blocks
_NONE = np.int32(((1 << 16) - 1) << 2)
# The coder's state holds 16 to 32 bits between steps, chances have 12, words 16.
_FLOOR, _WORD, _CHANCE, _SPARE = np.uint32(1 << 16), np.uint32(16), np.uint32(12), np.uint32(20)
_LOW_CHANCE, _LOW_WORD, _ALL = np.uint32(4095), np.uint32(65535), np.uint32(4096)
_MOST_WORDS = BLOCK * 12 // 16 + 2  # that the coder writes for a block


def _added(counts: np.ndarray, axis: int) -> np.ndarray:
    return counts.sum(axis=axis, keepdims=True, dtype=np.int32)


class Model:
    """Prediction tables of ``lanes`` blocks and the mixed chances of the four outcomes."""

    def __init__(self, lanes: int):
        self.all = self.lanes = lanes
        self.each = np.arange(lanes, dtype=np.int64)
        self.base2, self.base1, self.base0 = self.each << BITS2, (lanes << BITS2) + (self.each << BITS1), self.each << 8
        self.table = np.full(lanes * ((1 << BITS2) + (1 << BITS1)), _NONE, np.int32)  # id << 2 | sureness
        self.recent = np.zeros(lanes * 256, np.uint8)
        self.last1, self.last2 = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16)
        # Of each sureness of order 2, of order 1, outcome and block:
        self.counts = np.zeros((4, 4, 4, lanes), np.uint16)
        self.seen = np.zeros((4, 4, 4, lanes), np.int32)
        self.shares = np.empty((4, 4, 4, lanes), np.uint32)  # start << 16 | share
        self.limits = np.empty((4, 4, lanes, 4), np.uint16)  # where outcomes 1 to 3 begin
        self.credit = np.full((4, lanes), 16, np.int32)
        quarter = np.full((1, 1, 4, lanes), 1024, np.int32)
        self.chances = [quarter] * 4
        self._share(np.broadcast_to(quarter, (4, 4, 4, lanes)))

    def narrow(self, lanes: int) -> None:
        """Go on with the first ``lanes`` blocks."""
        self.lanes = lanes
        for name in ("each", "base2", "base1", "base0", "last1", "last2", "credit", "seen"):
            setattr(self, name, getattr(self, name)[..., :lanes])
        self.chances = [c[..., :lanes] for c in self.chances]

    def renew(self) -> None:
        """Credit each order for the outcomes since the last renewal and mix the chances anew."""
        counts = self.counts[..., : self.lanes].astype(np.int32)
        fresh, self.seen = counts - self.seen, counts
        by1, new1 = _added(counts, 0), _added(fresh, 0)
        views = (counts, _added(counts, 1), by1, _added(by1, 1))
        news = (fresh, _added(fresh, 1), new1, _added(new1, 1))
        for order, (view, new) in enumerate(zip(views, news, strict=True)):
            gain = (new * self.chances[order]).reshape(-1, self.lanes).sum(axis=0, dtype=np.int32) >> 8
            self.credit[order] = (self.credit[order] >> 1) + gain + 4
            self.chances[order] = (view * 4 + 1) * 4096 // (_added(view, 2) * 4 + 4)
        weights = self.credit * 60 // self.credit.sum(axis=0, dtype=np.int32) + 1
        self._share(sum(p * w for p, w in zip(self.chances, weights, strict=True)))

    def _share(self, mixed: np.ndarray) -> None:
        """Chances of 1 to 4093 parts in 4096 for the outcomes of each context."""
        upto = np.cumsum(mixed, axis=2, dtype=np.int32)
        ends = upto * 4092 // upto[:, :, 3:] + np.arange(1, 5, dtype=np.int32)[:, None]
        starts = np.concatenate([np.zeros_like(ends[:, :, :1]), ends[:, :, :3]], axis=2)
        self.shares[..., : self.lanes] = starts << 16 | ends - starts
        self.limits[:, :, : self.lanes] = ends.transpose(0, 1, 3, 2)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and entries of order 2 and order 1 for the next id of each block, and how sure they are."""
        one = self.last1 * np.uint16(40503)
        two = one + self.last2 * np.uint16(60493)
        at = np.empty((2, self.lanes), np.int64)
        np.add(self.base2, two >> np.uint16(16 - BITS2), out=at[0])
        np.add(self.base1, one >> np.uint16(16 - BITS1), out=at[1])
        entries = self.table.take(at)
        sure = entries.astype(np.uint8) & np.uint8(3)
        return at, entries, sure[0] << np.uint8(2) | sure[1]

    def place(self, context: np.ndarray) -> np.ndarray:
        """Where the contexts, or contexts and outcomes, of the blocks are in the arrays of chances."""
        return context * np.int64(self.all) + self.each

    def update(self, ids: np.ndarray, placed: np.ndarray, apart: np.ndarray, at: np.ndarray, at0: np.ndarray, coded: np.ndarray) -> None:
        """Learn the ids; ``placed`` are entries of them, ``apart`` the bits in which the entries found differ."""
        counts = self.counts.reshape(-1)
        count = counts.take(coded)
        count += 1
        counts[coded] = count
        self.table[at] = np.minimum(apart + 1, 3) * (apart < 4) + placed
        self.recent[at0] = (ids >> np.uint16(8)).astype(np.uint8)
        self.last2, self.last1 = self.last1, ids


def _by_step(rows: np.ndarray) -> np.ndarray:
    """The transpose, its width a multiple of 8 bytes; those move together, as rows lie far apart."""
    each = 8 // rows.itemsize
    words = np.ascontiguousarray(rows.view(np.uint64).T).view(rows.dtype)
    return words.reshape(-1, len(rows), each).swapaxes(1, 2).reshape(-1, len(rows))


def _by_lane(grid: np.ndarray) -> np.ndarray:
    """The transpose of what ``_by_step`` gives."""
    each = 8 // grid.itemsize
    words = np.ascontiguousarray(grid.reshape(-1, each, grid.shape[1]).swapaxes(1, 2)).view(np.uint64)
    return np.ascontiguousarray(words[:, :, 0].T).view(grid.dtype)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of all blocks in turn, words of each block) of a flat array of ids."""
    if not len(ids):
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    count, full = -(-len(ids) // BLOCK), len(ids) // BLOCK
    rest = len(ids) - full * BLOCK
    steps = BLOCK if full else rest
    rows = np.zeros((count, steps + 7 & -8), np.uint16)
    if full:
        rows[:full] = ids[: full * BLOCK].reshape(full, BLOCK)
    rows[full:, :rest] = ids[full * BLOCK :]
    grid = _by_step(rows)
    outcomes, shares = np.zeros(grid.shape, np.uint8), np.zeros(grid.shape, np.uint32)
    model = Model(count)
    for step in range(steps):
        if full and step == rest > 0:
            model.narrow(full)
        x = grid[step, : model.lanes]
        at, entries, context = model.predict()
        at0 = model.base0 + x.astype(np.uint8)
        placed = x.astype(np.int32) << 2
        apart = entries ^ placed
        hit = (apart < 4).view(np.uint8)
        known = (model.recent.take(at0) == x >> np.uint16(8)).view(np.uint8)
        outcome = np.minimum(3 - known, 3 - 2 * hit[1]) * (1 - hit[0])
        coded = model.place(context << np.uint8(2) | outcome)
        outcomes[step, : model.lanes] = outcome
        shares[step, : model.lanes] = model.shares.take(coded)
        model.update(x, placed, apart, at, at0, coded)
        if step in RENEWALS:
            model.renew()

    state = np.full(count, _FLOOR, np.uint32)
    out, begin = np.zeros((count, _MOST_WORDS), np.uint16), np.full(count, _MOST_WORDS, np.int64)
    for step in range(steps - 1, -1, -1):  # last outcome first, so that it is read last
        now = state if step < rest or not rest else state[:full]
        start, share = shares[step, : len(now)] >> _WORD, shares[step, : len(now)] & _LOW_WORD
        large = np.flatnonzero(now >= share << _SPARE)
        if len(large):
            begin[large] -= 1
            out[large, begin[large]] = now[large].astype(np.uint16)
            now[large] >>= _WORD
        now += now // share * (_ALL - share) + start

    outcomes = _by_lane(outcomes)
    spelled, unknown = outcomes >= 2, outcomes == 3
    lows, highs = rows.astype(np.uint8)[spelled], (rows >> np.uint16(8)).astype(np.uint8)[unknown]
    n_low, n_high = spelled.sum(axis=1), unknown.sum(axis=1)
    heads = np.stack([_MOST_WORDS - begin, n_low, state >> _WORD, state & _LOW_WORD], axis=1).astype("<u2")
    out = out.astype("<u2", copy=False)
    parts, low, high = [], 0, 0
    for i, (first, a, b) in enumerate(zip(begin.tolist(), n_low.tolist(), n_high.tolist(), strict=True)):
        parts += (heads[i], out[i, first:], lows[low : low + a], highs[high : high + b], b"\0" * (a + b & 1))
        low, high = low + a, high + b
    return np.frombuffer(b"".join(parts), "<u2"), 4 + _MOST_WORDS - begin + (n_low + n_high + 1) // 2


def decode_blocks(words: np.ndarray, sizes: np.ndarray, total: int) -> np.ndarray:
    """The ids that ``encode_blocks`` was given."""
    if not total:
        return np.zeros(0, np.uint16)
    count, full = len(sizes), total // BLOCK
    rest = total - full * BLOCK
    steps = BLOCK if full else rest
    grid = np.zeros((steps + 7 & -8, count), np.uint16)
    words = np.concatenate([words, np.zeros(1, np.uint16)]).astype("<u2", copy=False)
    plain = words.view(np.uint8)
    first = np.cumsum(sizes, dtype=np.int64) - sizes
    state = words[first + 2].astype(np.uint32) << _WORD | words[first + 3]
    next_word = first + 4
    next_low = (next_word + words[first]) * 2
    next_high = next_low + words[first + 1]
    model = Model(count)
    for step in range(steps):
        if full and step == rest > 0:
            model.narrow(full)
            state, next_word, next_low, next_high = state[:full], next_word[:full], next_low[:full], next_high[:full]
        at, entries, context = model.predict()
        inner = state & _LOW_CHANCE
        limits, seek = model.limits.view(np.uint64).take(model.place(context)).view(np.uint16).reshape(-1, 4), inner.astype(np.uint16)
        outcome = (seek >= limits[:, 0]).view(np.uint8) + (seek >= limits[:, 1]).view(np.uint8) + (seek >= limits[:, 2]).view(np.uint8)
        coded = model.place(context << np.uint8(2) | outcome)
        share = model.shares.take(coded)
        state = (state >> _CHANCE) * (share & _LOW_WORD) + inner - (share >> _WORD)
        small = np.flatnonzero(state < _FLOOR)
        if len(small):
            place = next_word[small]
            state[small] = state[small] << _WORD | words[place]
            next_word[small] = place + 1
        low, unknown = plain.take(next_low), (outcome == 3).view(np.uint8)
        known = model.recent.take(model.base0 + low)
        high = known ^ (known ^ plain.take(next_high)) * unknown
        next_low += outcome >> 1
        next_high += unknown
        x = grid[step, : model.lanes]
        np.bitwise_or(high.astype(np.uint16) << np.uint16(8), low, out=x)
        named = (entries >> 2).astype(np.uint16)
        np.copyto(x, named[1], where=outcome == 1)
        np.copyto(x, named[0], where=outcome == 0)
        placed = x.astype(np.int32) << 2
        model.update(x, placed, entries ^ placed, at, model.base0 + x.astype(np.uint8), coded)
        if step in RENEWALS:
            model.renew()
    return _by_lane(grid)[:, :steps].reshape(-1)[:total]


def pack_chunk(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One chunk: head, then id flags, document ids, lengths, block sizes, block checksums, words, checksum."""
    if len(ids) and int(ids.max()) > LARGEST_ID:
        raise ValueError(f"ids above {LARGEST_ID} do not fit this format")
    words, sizes = encode_blocks(ids)
    sums = [zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)]
    body = b"".join(
        (
            np.array([k is not None for k in keys], np.uint8).tobytes(),
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            lengths.astype("<u8").tobytes(),
            sizes.astype("<u4").tobytes(),
            np.array(sums, "<u4").tobytes(),
            words.astype("<u2").tobytes(),
        )
    )
    head = _HEAD.pack(MAGIC, len(body) + 4, len(keys), len(ids), BLOCK, len(sizes))
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def unpack_chunks(data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, lengths, ids) of every chunk of a file; raises on a wrong checksum."""
    at = 0
    while at < len(data):
        magic, size, docs, total, block, blocks = _HEAD.unpack_from(data, at)
        end = at + _HEAD.size + size
        if magic != MAGIC or block != BLOCK or zlib.crc32(data[at : end - 4]) != struct.unpack_from("<I", data, end - 4)[0]:
            raise ValueError(f"damaged chunk at offset {at}")
        place = at + _HEAD.size

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal place
            found = np.frombuffer(data, kind, count, place)
            place += found.nbytes
            return found

        flags, keys, lengths = read("u1", docs), read("<i8", docs), read("<u8", docs).astype(np.int64)
        sizes, sums = read("<u4", blocks).astype(np.int64), read("<u4", blocks)
        ids = decode_blocks(read("<u2", int(sizes.sum())), sizes, total)
        wide = ids.astype("<u4")
        for i, want in enumerate(sums.tolist()):
            if zlib.crc32(wide[i * BLOCK : (i + 1) * BLOCK].tobytes()) != want:
                raise ValueError(f"damaged block {i} of the chunk at offset {at}")
        yield [k if f else None for k, f in zip(keys.tolist(), flags.tolist(), strict=True)], lengths, wide
        at = end + 1  # the writer's line feed


_lean = functools.partial(lean, block=32 << 20, spare=128 << 20)  # the steps of a chunk use arrays of like sizes

_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizers library's tokenizer at ``path``, loaded once in each Python process."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _TOKENIZERS[path] = made
    return _TOKENIZERS[path]


_KNOWN: dict[str, object] = {}


def _write_chunks(path: str, end_id: int):
    @_lean
    def run(batches):
        import pyarrow as pa

        from wicara.llm.fastwords import FastWordIds  # it needs the tokenizer above

        if path not in _KNOWN:
            _KNOWN[path] = FastWordIds(path)
        words, keys, parts, held = _KNOWN[path], [], [], 0

        def chunk():
            ids = np.concatenate(parts)
            packed = pack_chunk(keys, np.fromiter(map(len, parts), np.int64, len(parts)), ids)
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["value"])

        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                piece = batch.slice(first, 1024)
                for key, ids in zip(piece.column(0).to_pylist(), words.encode(piece.column(1).to_pylist()), strict=True):
                    keys.append(key)
                    parts.append(np.append(ids, np.uint16(end_id)))
                    held += len(ids) + 1
                    if held >= CHUNK:
                        yield chunk()
                        keys, parts, held = [], [], 0
        if keys:
            yield chunk()

    return run


def write_token_files(docs: DataFrame, vocab: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Tokenize every whole text in id order and write token files below ``path``."""
    rows = docs.select(docs[doc_id].cast("long").alias("key"), docs[text].cast("string").alias("body"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "body")
    chunks = ordered.mapInArrow(_write_chunks(vocab, end_id), "value binary")
    chunks.select(F.col("value").cast("string")).write.mode("overwrite").text(path)


@_lean
def _read_files(batches):
    import pyarrow as pa

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            before, seq = 0, 0
            for keys, lengths, ids in unpack_chunks(content.as_buffer().to_pybytes()):
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(keys)),
                        pa.array(np.arange(seq, seq + len(keys))),
                        pa.array(keys, pa.int64()),
                        pa.array(before + ends - lengths),
                        pa.array(lengths),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["file", "seq", "key", "place", "n_tokens", "ids_crc32"],
                )
                before += int(lengths.sum())
                seq += len(keys)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, key, place, n_tokens, ids_crc32) of every document; ``place`` counts within its file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read_files, "file string, seq long, key long, place long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, vocab: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the token files, read them back, and place every document among all ids."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokenfile")
    write_token_files(docs, vocab, scratch.path("files"), doc_id, text, end_id)
    rows = scratch.write(read_token_files(spark, f"{scratch.root}/files"), "rows")
    totals = rows.groupBy("file").agg(
        F.min(F.struct(F.col("key").isNotNull(), "key")).alias("first"), F.sum("n_tokens").alias("total")
    )  # one row per file
    upto = W.orderBy("first", "file").rowsBetween(W.unboundedPreceding, -1)
    files = totals.select("file", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("before"))
    return scratch.finish(
        rows.join(files, "file").select(
            F.col("key").alias(doc_id), (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
        )
    )
