"""Cost-balanced packing of token sequences.

A document of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (projections, then attention within the
document). Documents of at least a whole sequence first give off full sequences. What is left of each
is assigned by descending cost to the sequence of lowest cost that still has room for all of it;
where none has, the lowest-cost sequence with any room takes as much as fits and the rest is assigned
next. The room of a group of documents equals its tokens: full sequences, and powers of two for the
remainder, so nothing is padded.

Documents are packed where they are read, in groups of about ``GROUP`` tokens of one partition: no
shuffle, and a group's size does not depend on the table. Ids are those of the tokenizers library.

Defined results: null and empty texts are the end id alone; rows that repeat an id are documents of
their own; very long texts span many sequences; an empty table gives no sequence. Columns other than
id and text are not read. Sequence ids grow within a partition and are unique, not dense.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wicara.llm.common import Scratch, lean, pieces, small_batches
from wicara.llm.fastwords import FastWordIds

CAPACITY = 2048
GROUP = 512 * CAPACITY
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 2048  # a full sequence's attention costs as much as its projections
PIECE = "doc_id long, start long, length long, offset long, doc_tokens long"


def cost(tokens: np.ndarray) -> np.ndarray:
    """Estimated cost of documents (or pieces) of these lengths."""
    tokens = np.asarray(tokens, np.float64)
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def rooms(tokens: int, capacity: int) -> np.ndarray:
    """Sequence sizes that hold exactly ``tokens``: full ones, then descending powers of two."""
    rest = tokens % capacity
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([capacity] * (tokens // capacity) + powers, np.int64)


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (document, start, length, sequence, offset), one for each piece of these documents."""
    lengths = np.asarray(lengths, np.int64)
    full = lengths // capacity
    whole = np.repeat(np.arange(len(lengths)), full)
    count = len(whole)
    first = np.cumsum(full) - full
    start = (np.arange(count) - first[whole]) * capacity
    wide = np.stack([whole, start, np.full(count, capacity), np.arange(count), np.zeros(count, np.int64)], axis=1)
    left = lengths - full * capacity
    room = rooms(int(left.sum()), capacity)
    used, spent = np.zeros(len(room), np.int64), np.zeros(len(room))
    out = []
    for doc in np.argsort(-cost(left), kind="stable").tolist():
        at, need = int(full[doc]) * capacity, int(left[doc])
        while need:
            fits = room >= need
            if not fits.any():
                fits = room > 0
            best = int(np.where(fits, spent, np.inf).argmin())
            size = min(need, int(room[best]))
            out.append((doc, at, size, count + best, int(used[best])))
            room[best] -= size
            used[best] += size
            spent[best] += LINEAR * size + QUADRATIC * size * size
            at += size
            need -= size
    return np.concatenate([wide, np.array(out, np.int64).reshape(-1, 5)])


_KNOWN: dict[str, FastWordIds] = {}


def _pack(vocab: str, end_id: int, capacity: int, group: int):
    @lean
    def run(batches):
        import pyarrow as pa

        if vocab not in _KNOWN:
            _KNOWN[vocab] = FastWordIds(vocab)
        words, held, keys, tokens = _KNOWN[vocab], [], [], 0
        names = ["sequence_id", "n_tokens", "ids", "pieces"]
        next_id = TaskContext.get().partitionId() << 33

        def flush():
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            rows = assign(lengths, capacity)
            rows = rows[np.lexsort((rows[:, 4], rows[:, 3]))]
            doc, start, length, sequence, offset = rows.T
            flat, begin = np.concatenate(held), np.cumsum(lengths) - lengths
            source = np.repeat(begin[doc] + start - (np.cumsum(length) - length), length) + np.arange(len(flat))
            cuts = np.flatnonzero(np.diff(sequence, prepend=-1))
            sizes = np.add.reduceat(length, cuts)
            ends = (np.concatenate([[0], np.cumsum(sizes)]) * 2).astype(np.int32)
            ids = pa.Array.from_buffers(
                pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat[source].astype("<u2").tobytes())]
            )
            key = pa.array(keys, pa.int64()).take(pa.array(doc))
            fields = [pa.array(c) for c in (start, length, offset, lengths[doc])]
            items = pa.StructArray.from_arrays([key, *fields], names=["doc_id", "start", "length", "offset", "doc_tokens"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(rows)), pa.int32()), items)
            numbers = pa.array(next_id + np.arange(len(sizes)))
            return pa.RecordBatch.from_arrays([numbers, pa.array(sizes), ids, lists], names=names)

        for batch in pieces(batches):
            for key, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                keys.append(key)
                held.append(np.append(ids, np.uint16(end_id)))
                tokens += len(ids) + 1
                if tokens >= group:
                    done = flush()
                    next_id += done.num_rows
                    yield done
                    held, keys, tokens = [], [], 0
        if held:
            yield flush()

    return run


def pack_documents(
    docs: DataFrame,
    vocab: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    group: int = GROUP,
) -> DataFrame:
    """One row per sequence: id, tokens, ids (16 bits each) and the pieces of documents in it, by offset."""
    small_batches(docs.sparkSession)
    narrow = docs.select(docs[doc_id].cast("long").alias("key"), docs[text].cast("string").alias("body"))
    schema = f"sequence_id long, n_tokens long, ids binary, pieces array<struct<{PIECE.replace(' ', ': ').replace(',:', ',')}>>"
    return narrow.mapInArrow(_pack(vocab, end_id, capacity, group), schema)


@lean
def _digests(batches):
    import pyarrow as pa

    for batch in pieces(batches):
        lists, ids = batch.column("pieces"), batch.column("ids")
        items = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        wide = [np.frombuffer(b.as_buffer(), "<u2").astype("<u4") for b in ids]
        start, size = items.field("offset").to_numpy(), items.field("length").to_numpy()
        sums = [
            zlib.crc32(wide[r][s : s + n].tobytes()) for r, s, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)
        ]
        sequence = batch.column("sequence_id").take(pa.array(row))
        yield pa.RecordBatch.from_arrays(
            [*items.flatten(), pa.array(sums, pa.int64()), sequence],
            names=["doc_id", "start", "length", "offset", "doc_tokens", "ids_crc32", "sequence_id"],
        )


def packed_pieces(sequences: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per piece of a document, read from packed sequences, with a checksum of its ids."""
    found = sequences.select("sequence_id", "ids", "pieces").mapInArrow(_digests, f"{PIECE}, ids_crc32 long, sequence_id long")
    return found.withColumnRenamed("doc_id", doc_id)


def pack_index(docs: DataFrame, vocab: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the packed sequences, read them back, and list the pieces they hold."""
    scratch = Scratch(docs.sparkSession, "packing")
    return packed_pieces(scratch.write(pack_documents(docs, vocab, doc_id, text), "sequences"), doc_id)
