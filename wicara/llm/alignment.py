"""Alignment of two tokenizers' tokens by their byte offsets.

Both token sequences of a text end at increasing byte offsets. ``align`` walks them with diagonal run
skipping: at the current shift between the two indices it compares ranges of both end arrays, doubling
them while they are equal and halving them after a miss, so a stretch of one-to-one tokens is jumped.
Where the ends differ, the side that is behind advances until both end together; that irregular group
updates the shift. Byte ranges of a group overlap exactly along this walk.

A text is cut where both tokenizers always break: before a blank or line feed after another character,
and between a letter and a mark. Each distinct chunk is tokenized and aligned once for all the texts of a
worker that hold it. Texts with other white space are one chunk. Documents keep their distinct
linked id pairs; these are counted over all documents, and every document adds up the counts.

Defined results: null and empty texts, and texts one of the tokenizers does not reproduce, have no
tokens: zeros and an empty digest. Rows that repeat an id or a text are documents of their own. Equal
counts of an A id's pairs are all highest. Texts of any length are read in parts; an empty table gives no
rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicara.llm.bpe import byte_letters
from wicara.llm.common import Scratch, lean, pieces, small_batches

PART = 4_000_000  # characters of a text aligned at a time
TOGETHER = 1_000_000  # characters whose chunks are looked up together
LIMIT = 250_000  # chunks a worker remembers; beyond it only those met more than once stay
CHARS = 20_000_000  # characters of these chunks, likewise
PAIRS = 1 << 22  # pairs counted before they are handed on
SENT_PAIRS = 4_000_000  # pair counts sent to every worker (about 50 MB); more are joined
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = ".,;:!?"
_OTHER_SPACE = re.compile(r"[^\S \n]")
_PLAIN = re.compile("[\n -~À-ÖØ-öø-ÿ]*")
_CUT = re.compile("(?<=[^ \n])[ \n]")


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(index after each group in a, the same in b, links' indices in a, the same in b) of two end lists.

    Both lists are strictly increasing and have the same last value.
    """
    cut_a: list[int] = []
    cut_b: list[int] = []
    link_a: list[int] = []
    link_b: list[int] = []
    i, j, size = 0, 0, len(a)
    while i < size:
        if a[i] == b[j]:
            run, step = 1, 2
            while i + run < size:  # probe ranges of doubled size along the diagonal
                step = min(step, size - i - run)
                if a[i + run : i + run + step] != b[j + run : j + run + step]:
                    break
                run, step = run + step, step * 2
            else:
                step = 0
            while step := step // 2:  # the rest of the run lies in the range that differed
                if a[i + run : i + run + step] == b[j + run : j + run + step]:
                    run += step
            link_a.extend(range(i, i + run))
            link_b.extend(range(j, j + run))
            i, j = i + run, j + run
            cut_a.extend(range(i - run + 1, i + 1))
            cut_b.extend(range(j - run + 1, j + 1))
            continue
        x, y = a[i], b[j]
        link_a.append(i)
        link_b.append(j)
        while x != y:  # an irregular group: j - i is the new shift after it
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
            link_a.append(i)
            link_b.append(j)
        i, j = i + 1, j + 1
        cut_a.append(i)
        cut_b.append(j)
    return cut_a, cut_b, link_a, link_b


class Tokens:
    """The two tokenizers, the bytes of their tokens, and where a text may be cut."""

    def __init__(self, byte_vocab: str, piece_model: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(byte_vocab, encoding="utf-8") as file:
            data = json.load(file)
        value = {letter: i for i, letter in enumerate(byte_letters())}
        special = {t["id"] for t in data["added_tokens"]}
        ranks = {bytes(value[c] for c in t): i for t, i in data["model"]["vocab"].items() if i not in special}
        self.a_bytes = [b""] * (max(ranks.values(), default=0) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the split rule
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.library = Tokenizer.from_file(byte_vocab)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)
        ]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in names):
            raise ValueError("a piece of the vocabulary reaches over a blank or a line end")
        self.a_sizes = np.fromiter(map(len, self.a_bytes), np.int64)
        self.b_sizes = np.fromiter(map(len, self.b_bytes), np.int64)
        joined = re.compile(f"[{_LETTERS}][{re.escape(_MARKS)}]")
        marked = any(joined.search(p) for p in names)
        before_mark = "" if marked else f"[ \n]*[{_LETTERS}]+(?=[{re.escape(_MARKS)}])|"
        self.chunks = re.compile(before_mark + "[ \n]*[^ \n]+|[ \n]+").findall

    def encode_a(self, chunks: list[str]) -> list[list[int]]:
        """Byte-level ids of chunks; those that start and end like words of a text are encoded in one text."""
        out: list[list[int]] = [[]] * len(chunks)
        together = []
        for i, chunk in enumerate(chunks):
            if chunk[-1] in " \n" or not _PLAIN.fullmatch(chunk):
                out[i] = self.library.encode(chunk, add_special_tokens=False).ids
            else:
                together.append(i)
        if together:
            # a chunk without a blank before it follows a line feed, whose token is dropped
            lead = np.array([chunks[i][0] not in " \n" for i in together], np.int64)
            text = "".join(["\n" + chunks[i] if n else chunks[i] for i, n in zip(together, lead.tolist(), strict=True)])
            ids = self.fast(text)
            ends = np.cumsum(self.a_sizes[ids])
            sizes = np.fromiter((len(chunks[i].encode()) for i in together), np.int64) + lead
            cuts = np.concatenate([[0], np.searchsorted(ends, np.cumsum(sizes)) + 1])
            for i, s, e in zip(together, (cuts[:-1] + lead).tolist(), cuts[1:].tolist(), strict=True):
                out[i] = ids[s:e]
        return out

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """Piece ids of chunks; the tokenizer puts a blank before every text it is given."""
        asked, drop = [], []
        for chunk in chunks:
            if chunk[0] == " " and len(chunk) > 1:
                asked.append(chunk[1:])
                drop.append(0)
            else:  # behind a line feed nothing joins what is before
                asked.append(chunk if chunk[0] == "\n" else "\n" + chunk)
                drop.append(1 if chunk[0] == "\n" else 2)
        found = self.pieces.encode(asked, num_threads=1)
        return [ids[n:] if n else ids for ids, n in zip(found, drop, strict=True)]

    def align_chunks(self, chunks: list[str]) -> Iterator[tuple[list[int], list[int], str | None, list[tuple[int, int]]]]:
        """(A ids, B ids, groups as text or None where bytes differ, linked id pairs) of each chunk."""
        of_a, of_b = self.encode_a(chunks), self.encode_b(chunks)
        fits = []
        for chunk, a, b in zip(chunks, of_a, of_b, strict=True):
            data = chunk.encode()
            fits.append(b"".join([self.a_bytes[i] for i in a]) == data and b"".join([self.b_bytes[i] for i in b]) == data)
        a = [i for ids, fit in zip(of_a, fits, strict=True) if fit for i in ids]
        b = [i for ids, fit in zip(of_b, fits, strict=True) if fit for i in ids]
        cut_a, cut_b, link_a, link_b = align(np.cumsum(self.a_sizes[a]).tolist(), np.cumsum(self.b_sizes[b]).tolist()) if a else ([], [], [], [])
        text_a, text_b = list(map(str, a)), list(map(str, b))
        groups, at_a, at_b = [], 0, 0
        for x, y in zip(cut_a, cut_b, strict=True):
            if x - at_a == 1 == y - at_b:
                groups.append(f"{text_a[at_a]}|{text_b[at_b]}")
            else:
                groups.append(",".join(text_a[at_a:x]) + "|" + ",".join(text_b[at_b:y]))
            at_a, at_b = x, y
        links = list(zip([a[i] for i in link_a], [b[i] for i in link_b], strict=True))
        group, end_a, link = 0, 0, 0
        for own_a, own_b, fit in zip(of_a, of_b, fits, strict=True):
            if not fit:
                yield own_a, own_b, None, []
                continue
            end_a += len(own_a)
            first = group
            while group < len(cut_a) and cut_a[group] <= end_a:
                group += 1
            count = len(own_a) + len(own_b) - (group - first)
            yield own_a, own_b, ";".join(groups[first:group]), links[link : link + count]
            link += count


class _Numbers(dict):
    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        return number


class Aligner:
    """Alignments of texts, each known chunk looked up."""

    def __init__(self, byte_vocab: str, piece_model: str, limit: int = LIMIT):
        self.tokens, self.limit = Tokens(byte_vocab, piece_model), limit
        self.width = len(self.tokens.b_bytes)
        if len(self.tokens.a_bytes) * self.width >= 1 << 32:
            raise ValueError("pairs of ids need more than 32 bits")
        self.index, self.chars = _Numbers(), 0
        self.texts: list[str | None] = []
        self.shape = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.codes, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        shape, codes = [], []
        for a, b, text, links in self.tokens.align_chunks(chunks):
            self.texts.append(text)
            shape.append((len(a), len(b), len(a) + len(b) - len(links), len(links)))
            codes += [x * self.width + y for x, y in links]
        self.shape = np.concatenate([self.shape, np.array(shape, np.int64)])
        self.codes = np.concatenate([self.codes, np.array(codes, np.uint32)])
        self.met = np.concatenate([self.met, np.zeros(len(chunks), np.int64)])

    def _links(self, at: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.shape[:, 3])
        sizes = self.shape[at, 3]
        before = np.cumsum(sizes) - sizes
        return self.codes[np.repeat(ends[at] - sizes - before, sizes) + np.arange(int(sizes.sum()))]

    def _forget(self) -> None:
        kept = np.flatnonzero(self.met > 1)
        chunks = list(self.index)
        self.codes = self._links(kept)
        self.index = _Numbers((chunks[i], n) for n, i in enumerate(kept.tolist()))
        self.chars = sum(map(len, self.index))
        self.texts = [self.texts[i] for i in kept.tolist()]
        self.shape, self.met = self.shape[kept], self.met[kept] // 2

    def parts(self, texts: list[str]) -> list[tuple[np.ndarray, str | None, np.ndarray, np.ndarray]]:
        """(shape, groups as text, distinct pair codes, their counts) of each text; None as text where bytes differ."""
        found = [self.tokens.chunks(t) if not _OTHER_SPACE.search(t) else [t] for t in texts]
        known, counts = len(self.index), list(map(len, found))
        at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(found)), np.int64, sum(counts))
        if len(self.index) > known:
            fresh = list(itertools.islice(self.index, known, None))
            self.chars += sum(map(len, fresh))
            self._learn(fresh)
        self.met += np.bincount(at, minlength=len(self.met))
        owner = np.repeat(np.arange(len(texts)), counts)
        cuts = np.cumsum([0, *counts])
        upto = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.shape[at], axis=0)])
        shapes = upto[cuts[1:]] - upto[cuts[:-1]]
        keys = np.repeat(owner, self.shape[at, 3]) << 32 | self._links(at).astype(np.int64)
        keys, counted = np.unique(keys, return_counts=True)
        ends = np.searchsorted(keys, np.arange(len(texts) + 1) << 32)
        codes, numbers, out = (keys & 0xFFFFFFFF).astype(np.uint32), at.tolist(), []
        for i in range(len(texts)):
            own = [self.texts[n] for n in numbers[cuts[i] : cuts[i + 1]]]
            text = None if None in own else ";".join(own)
            out.append((shapes[i], text, codes[ends[i] : ends[i + 1]], counted[ends[i] : ends[i + 1]]))
        if len(self.index) > self.limit or self.chars > CHARS:
            self._forget()
        return out

    def texts_aligned(self, texts: list[str | None], part: int = PART, together: int = TOGETHER) -> list[tuple]:
        """(A tokens, B tokens, groups, links, digest, codes, counts) of each whole text."""
        out: list[tuple] = [(0, 0, 0, 0, "", b"", b"")] * len(texts)
        held, chars = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > part and not _OTHER_SPACE.search(text):
                out[i] = self._long(" " + text, part)
                continue
            held.append(i)
            chars += len(text)
            if chars > together:
                self._into(out, texts, held)
                held, chars = [], 0
        if held:
            self._into(out, texts, held)
        return out

    def _into(self, out: list, texts: list, held: list[int]) -> None:
        for i, (shape, text, codes, counts) in zip(held, self.parts([" " + texts[i] for i in held]), strict=True):
            if text is not None:
                digest = hashlib.sha256(text.encode()).hexdigest()
                out[i] = (*shape.tolist(), digest, codes.astype("<u4").tobytes(), counts.astype("<u4").tobytes())

    def _long(self, text: str, size: int) -> tuple:
        shape, digest, codes, counts, start = np.zeros(4, np.int64), hashlib.sha256(), [], [], 0
        while start < len(text):
            cut = _CUT.search(text, start + size)
            end = cut.start() if cut else len(text)
            ((own, groups, pairs, times),) = self.parts([text[start:end]])
            if groups is None:
                return (0, 0, 0, 0, "", b"", b"")
            digest.update(((";" if start else "") + groups).encode())
            shape, start = shape + own, end
            codes.append(pairs)
            counts.append(times)
        every, place = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, place, np.concatenate(counts))
        return (*shape.tolist(), digest.hexdigest(), every.astype("<u4").tobytes(), total.astype("<u4").tobytes())


_LOADED: dict[tuple, Aligner] = {}
ROW = "key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, counts binary"


def _align_rows(byte_vocab: str, piece_model: str, part: int, limit: int):
    @lean
    def run(batches):
        import pyarrow as pa

        name = (byte_vocab, piece_model, limit)
        if name not in _LOADED:
            _LOADED[name] = Aligner(*name)
        types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in ROW.split(", ")]
        for batch in pieces(batches):
            rows = _LOADED[name].texts_aligned(batch.column(1).to_pylist(), part)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return run


@lean
def _count_pairs(batches):
    """Documents of each pair code, counted in the partition as far as ``PAIRS`` codes are at hand."""
    import pyarrow as pa

    def rows(held):
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "docs"])

    held, count = [], 0
    for batch in pieces(batches):
        for data in batch.column(0):
            held.append(np.frombuffer(data.as_buffer(), "<u4"))
            count += len(held[-1])
        if count > PAIRS:
            yield rows(held)
            held, count = [], 0
    if held:
        yield rows(held)


SUMS = "key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def _add_up(sent):
    @lean
    def run(batches):
        import pyarrow as pa

        codes, docs, best = (np.frombuffer(d, t) for d, t in zip(sent.value, ("<u4", "<i8", "?"), strict=True))
        for batch in pieces(batches):
            own = [np.frombuffer(d.as_buffer(), "<u4") for d in batch.column("codes")]
            times = [np.frombuffer(d.as_buffer(), "<u4") for d in batch.column("counts")]
            ends = np.cumsum([0, *map(len, own)])
            n = np.concatenate([*times, np.zeros(0, "<u4")]).astype(np.int64)
            at = np.searchsorted(codes, np.concatenate([*own, np.zeros(0, "<u4")]))
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (n * best[at], n * docs[at])] if len(codes) else [ends * 0] * 2
            added = [pa.array((s[ends[1:]] - s[ends[:-1]]).astype(np.int64)) for s in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *added], names=[c.split()[0] for c in SUMS.split(", ")])

    return run


def _spell_pairs(batches):
    import pyarrow as pa

    for batch in pieces(batches):
        own = [np.frombuffer(d.as_buffer(), "<u4") for d in batch.column("codes")]
        times = [np.frombuffer(d.as_buffer(), "<u4") for d in batch.column("counts")]
        row = np.repeat(batch.column("row").to_numpy(), list(map(len, own)))
        flat = [np.concatenate([*x, np.zeros(0, "<u4")]).astype(np.int64) for x in (own, times)]
        yield pa.RecordBatch.from_arrays([pa.array(row), *map(pa.array, flat)], names=["row", "code", "times"])


def aligned_rows(
    docs: DataFrame, byte_vocab: str, piece_model: str, doc_id: str = "doc_id", text: str = "text", part: int = PART, limit: int = LIMIT
) -> DataFrame:
    """Shape, digest, distinct linked pairs and their counts of every whole text. Row-local."""
    small_batches(docs.sparkSession)
    narrow = docs.select(docs[doc_id].cast("long").alias("key"), docs[text].cast("string").alias("body"))
    return narrow.mapInArrow(_align_rows(byte_vocab, piece_model, part, limit), ROW)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(code, docs, best): documents that hold a pair linked, and whether its A id has none held by more."""
    counts = rows.select("codes").mapInArrow(_count_pairs, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs"))
    counts = counts.withColumn("a", F.expr(f"code div {width}"))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("code", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align_documents(
    docs: DataFrame,
    byte_vocab: str,
    piece_model: str,
    doc_id: str = "doc_id",
    text: str = "text",
    sent_pairs: int = SENT_PAIRS,
    part: int = PART,
    limit: int = LIMIT,
) -> DataFrame:
    """One row per document: tokens, groups and links of both tokenizers, and how common its links are."""
    import sentencepiece

    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    rows = scratch.write(aligned_rows(docs, byte_vocab, piece_model, doc_id, text, part, limit), "rows")
    width = sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()
    pairs = scratch.write(pair_counts(rows, width), "pairs")
    plain = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if pairs.count() <= sent_pairs:
        table = pairs.toArrow().sort_by("code")
        columns = [table.column(c).to_numpy().astype(t) for c, t in (("code", "<u4"), ("docs", "<i8"), ("best", "?"))]
        sent = spark.sparkContext.broadcast([c.tobytes() for c in columns])
        found = rows.select(*plain, "codes", "counts").mapInArrow(_add_up(sent), SUMS)
    else:
        # rows are numbered in a written table, so that the numbers stay when a task is run again
        numbered = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        spelled = numbered.select("row", "codes", "counts").mapInArrow(_spell_pairs, "row long, code long, times long")
        best = F.when(F.col("best"), F.col("times")).otherwise(0)
        sums = spelled.join(pairs, "code").groupBy("row").agg(F.sum(best).alias("n_best"), F.sum(F.expr("times * docs")).alias("count_sum"))
        found = numbered.join(sums, "row", "left").select(*plain, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])
    return scratch.finish(found.withColumnRenamed("key", doc_id))
