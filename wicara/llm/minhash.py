"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has a fixed number of coordinates. In the first rounds every element of a set is hashed to
a random coordinate, in the later rounds to one given coordinate, and a coordinate keeps its
smallest (round, value); each set therefore fills every coordinate, with the concentration of
independent samples. Bands of coordinates name buckets. Members of a bucket whose sketches are
alike are spanned by edges, whose components are clusters; all pairs of a cluster are verified on
their full shingle sets, and only links that span its groups are put out. Buckets and clusters are
compared in pairs of blocks, so neither the rows put out nor the work of a task grow with the square
of a group.

Defined results: null, empty and blank texts have an empty set and link with nothing. Repeated rows
of one id are one document, linked through any of its texts; each row is returned. A null id gets a
null component and is kept. Columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicara.llm.common import Scratch, lean
from wicara.llm.graph import components, grouped, spanning
from wicara.llm.hashing import PLACES, mix, shingle_sets, text_slices

COORDINATES = 128
ROWS = 4  # coordinates of a band: a pair of similarity 0.75 misses all 32 bands with chance 5e-6
BITS = 2  # bits kept of each coordinate to rule out pairs before their sets are fetched
FARTHEST = 51  # differing coordinates (of those bits); six deviations above a similarity of 0.75
PERCENT = 75
BLOCK = 512  # members of a bucket or cluster on one side of a comparison
BLOCK_SHINGLES = 400_000  # shingles on one side of a comparison
_SALTS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sketches(sets: list[np.ndarray], size: int = COORDINATES) -> np.ndarray:
    """(sets, coordinates) values; every coordinate of a non-empty set is filled."""
    shift, low = np.uint64(64 - size.bit_length() + 1), np.uint64((1 << 56) - 1)
    out = np.full((len(sets), size), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    open_rows = [i for i, s in enumerate(sets) if len(s)]
    for turn in range(2 * size):
        if not open_rows:
            break
        if turn == 0 or turn % 4 == 0 or turn >= size:
            elements = np.concatenate([sets[i] for i in open_rows])
            rows = np.repeat(np.array(open_rows, np.int64) * size, [len(sets[i]) for i in open_rows])
        value = mix(elements ^ _SALTS[turn])
        place = (value >> shift).astype(np.int64) if turn < size else turn - size
        np.minimum.at(flat, rows + place, (value & low) | np.uint64(turn << 56))
        full = out[open_rows].max(axis=1) != np.iinfo(np.uint64).max
        if full.any() and (turn % 4 == 3 or turn == 0 or turn >= size or full.all()):
            open_rows = [r for r, f in zip(open_rows, full.tolist(), strict=True) if not f]
            if turn == 0 and open_rows:
                elements = np.concatenate([sets[i] for i in open_rows])
                rows = np.repeat(np.array(open_rows, np.int64) * size, [len(sets[i]) for i in open_rows])
    return out


@lean
def _sketch_batches(batches):
    import pyarrow as pa

    weights = PLACES[:ROWS]
    numbers = np.arange(COORDINATES // ROWS, dtype=np.uint64) * PLACES[-1]
    places = np.arange(COORDINATES // 4, dtype=np.uint64) * np.uint64(BITS)
    for batch in batches:
        for first, data, bounds in text_slices(batch.column(1)):
            sets = shingle_sets(data, bounds)
            n = len(sets)
            grid = sketches(sets)
            bands = mix((grid.reshape(n, -1, ROWS) * weights).sum(axis=2, dtype=np.uint64) + numbers)
            short = (mix(grid) & np.uint64((1 << BITS) - 1)).reshape(n, 4, -1)
            bits = (short << places).sum(axis=2, dtype=np.uint64)
            sums = [(s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)) for s in sets]
            column = lambda a, k: pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1).view(np.int64)), k).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, n),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([a for a, _ in sums], np.uint64).view(np.int64)),
                    pa.array(np.array([b for _, b in sums], np.uint64).view(np.int64)),
                    column(bands, COORDINATES // ROWS),
                    column(bits, 4),
                ],
                names=["key", "n", "set_a", "set_b", "bands", "bits"],
            )


@lean
def _set_batches(batches):
    """(key, cluster, blocks, text) with the text's sorted shingle hashes in its place."""
    import pyarrow as pa

    for batch in batches:
        for first, data, bounds in text_slices(batch.column(3)):
            sets = shingle_sets(data, bounds)
            kept = [batch.column(i).slice(first, len(sets)) for i in range(3)]
            members = pa.array([s.tobytes() if len(s) else None for s in sets], pa.binary())
            rows = pa.RecordBatch.from_arrays([*kept, members], names=["key", "cluster", "blocks", "members"])
            yield rows.filter(members.is_valid())


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("key"), docs[text].cast("string").alias("body"))


def _edges(rows: list[tuple[int, int]]):
    import pyarrow as pa

    u, v = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


_PAIRED = 0x5555555555555555


def _alike(a: list[int], b: list[int]) -> bool:
    """Whether the kept bits of two sketches allow the similarity."""
    odd = 0
    for x, y in zip(a, b, strict=True):
        z = x ^ y
        odd += ((z | z >> 1) & _PAIRED).bit_count()
    return odd <= FARTHEST


@lean
def _bucket_edges(batches):
    """Members (key, bits) of a block pair of a bucket to edges that span those with alike sketches."""
    out = []
    for _, rows in grouped(batches, 3):
        if len(rows) <= 4:
            whole = [(k, [x & 0xFFFFFFFFFFFFFFFF for x in bits]) for k, bits in rows]
            for i, (k, bits) in enumerate(whole):
                out += [(k, other) for other, more in whole[:i] if k != other and _alike(bits, more)]
        else:
            names = np.array([k for k, _ in rows], np.int64)
            bits = np.array([b for _, b in rows], np.int64).view(np.uint64)
            odd = np.zeros((len(rows), len(rows)), np.int32)
            for i in range(bits.shape[1]):
                z = bits[:, None, i] ^ bits[None, :, i]
                odd += np.bitwise_count((z | z >> np.uint64(1)) & np.uint64(_PAIRED))
            near = odd <= FARTHEST
            np.fill_diagonal(near, False)
            out += spanning(names, near)
        if len(out) > 5000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    sizes = np.array([len(s) for s in sets])
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    flags = np.zeros(int(places.max()) + 1, np.int32)
    out = np.empty((len(sets), len(sets)), np.int64)
    for i, (s, e) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
        flags[places[s:e]] = 1
        out[i] = np.add.reduceat(flags[places], ends - sizes)
        flags[places[s:e]] = 0
    return out


@lean
def _cluster_links(batches):
    """Sets (key, members) of a block pair of a cluster to links that span those similar enough."""
    for _, rows in grouped(batches, 3):
        if len(rows) < 2:
            continue
        names = np.array([k for k, _ in rows], np.int64)
        sets = [np.frombuffer(m, np.int64) for _, m in rows]
        sizes = np.array([len(s) for s in sets], np.int64)
        shared = _shared(sets)
        near = 100 * shared >= PERCENT * (sizes[:, None] + sizes[None, :] - shared)
        np.fill_diagonal(near, False)
        if found := spanning(names, near):
            yield _edges(found)


def _in_blocks(rows: DataFrame, group: str, blocks: str, value: str) -> DataFrame:
    """Rows (group, blocks, key, value) dealt to all pairs of blocks of their group, sorted by pair.

    A pair of blocks holds the rows of both, so each pair of rows meets, and no group of any size
    is gathered in one task.
    """
    placed = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col(blocks)).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return (
        pairs.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", value)
        .repartition(group, "i", "j")
        .sortWithinPartitions(group, "i", "j", "key")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = _narrow(docs, doc_id, text)
    schema = "key long, n long, set_a long, set_b long, bands array<long>, bits array<long>"
    sketch = scratch.write(texts.mapInArrow(_sketch_batches, schema), "sketch")

    # equal sets are one class, named by its smallest id
    classes = scratch.write(
        sketch.where("n > 0 and key is not null").groupBy("set_a", "set_b", "n").agg(F.min("key").alias("rep")), "classes"
    )
    first = sketch.join(classes.select(F.col("rep").alias("key"), "set_a", "set_b"), ["key", "set_a", "set_b"], "left_semi")
    reps = first.dropDuplicates(["key", "set_a"])

    # buckets with several members; their members with alike sketches form clusters
    filed = reps.select("key", F.explode("bands").alias("bucket"))
    buckets = scratch.write(
        filed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select(
            "bucket", F.ceil(F.col("size") / F.lit(BLOCK)).alias("blocks")
        ),
        "buckets",
    )
    members = scratch.write(filed.join(buckets, "bucket"), "members").join(reps.select("key", "bits"), "key")
    alike = _in_blocks(members, "bucket", "blocks", "bits").mapInArrow(_bucket_edges, "u long, v long")
    clusters = scratch.write(components(scratch, alike, "alike"), "clusters")
    scratch.drop("members", "buckets")

    # inside a cluster all full sets are compared
    counted = clusters.join(sketch.where("n > 0").select(F.col("key").alias("node"), "n"), "node")
    sizes = counted.groupBy("component").agg(
        F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).alias("blocks")
    )
    placed = scratch.write(
        clusters.join(sizes, "component").select(F.col("node").alias("key"), F.col("component").alias("cluster"), "blocks"), "placed"
    )
    sets = texts.join(placed, "key").select("key", "cluster", "blocks", "body").mapInArrow(
        _set_batches, "key long, cluster long, blocks long, members binary"
    )
    links = _in_blocks(sets, "cluster", "blocks", "members").mapInArrow(_cluster_links, "u long, v long")

    # one id with several texts joins the classes of all of them
    repeated = sketch.where("n > 0").groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1 and key is not null")
    owned = sketch.join(repeated, "key", "left_semi").join(classes, ["set_a", "set_b", "n"])
    links = links.unionByName(owned.select(F.col("key").alias("u"), F.col("rep").alias("v")))
    found = components(scratch, links, "links")

    rows = sketch.select("key", "n", "set_a", "set_b").join(classes, ["set_a", "set_b", "n"], "left")
    out = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "key")
    return scratch.finish(
        out.select(
            F.col("key").alias(doc_id),
            F.col("n").alias("n_shingles"),
            F.when(F.col("key").isNotNull(), component).alias("component_id"),
            (F.col("key").isNull() | (F.col("key") == component)).alias("kept"),
        )
    )
