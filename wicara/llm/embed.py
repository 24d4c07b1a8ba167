"""Near-duplicate embeddings by NN-descent.

Vectors are compared only within their group (equal label and dimension). Equal vectors are one
class. A neighbour graph starts from windows of classes sorted by random-hyperplane signatures and is
refined by joins of neighbours of neighbours until few lists change. Links also span the groups met on the way, so that a
list saturated with links loses no group. Lists of linked classes are then enlarged to their whole
component, compared in blocks, which counts the links beyond a saturated list exactly.

The recall of the links is audited against brute force on a bounded set of classes of every size of
group. Audited links never enter the result. A class counts by the share of its links that are met, and the
recall is that of the worst part: classes in groups of like size with like numbers of links. So a hot
group hides no missed pair. Below the target the graph gets further signatures, shifted windows and
rounds that split their joins anew; the recall reached is returned with the result.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors
without label or id, link with nothing. Rows that repeat an id share its component, each row counts
the links of its own vector. A null id has a null component and is kept. Columns other than the
three named are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wicara.llm.common import Scratch, lean
from wicara.llm.graph import components, grouped, spanning

COSINE = 0.98
NEIGHBOURS = 6
SIGNATURES = 6
BITS = 48
WINDOW = 256  # classes of consecutive signatures compared with each other
LOCAL = 48  # members of a local join
BLOCK = 512  # members of one side of a block comparison
ROUNDS = 4
SETTLED = 0.002  # share of list entries below which a round of changes ends the descent
AUDITED = 512  # classes of one size of group
SPAN = 3.0  # stands for the cosine of an edge that only says: reachable by links
RECALL = 0.98
RESTARTS = 6


def unit(vectors: list[bytes]) -> np.ndarray:
    """Rows of unit length in double precision."""
    rows = np.frombuffer(b"".join(vectors), np.float32).reshape(len(vectors), -1).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@lean
def _usable(batches):
    """(key, embedding, label) to (key, group, vec) of the vectors that can be compared."""
    import pyarrow as pa

    for batch in batches:
        keys, groups, vecs = [], [], []
        for key, values, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is None or label is None or not values or None in values:
                continue
            row = np.array(values, np.float32)
            size = np.linalg.norm(row.astype(np.float64))
            if np.isfinite(row).all() and size > 0:
                keys.append(key)
                groups.append(f"{label}/{len(row)}")
                vecs.append((row + np.float32(0)).tobytes())  # one zero, not two
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(groups, pa.string()), pa.array(vecs, pa.binary())], names=["key", "grp", "vec"]
        )


def _best(ids: list[int], sims: np.ndarray, floor: np.ndarray, count: int) -> list[tuple[int, int, float]]:
    """For each member its ``count`` nearest others above its floor."""
    count = min(count, len(ids) - 1)
    if count < 1:
        return []
    near = np.argpartition(-sims, count - 1, axis=1)[:, :count]
    got = np.take_along_axis(sims, near, axis=1)
    rows, columns = np.nonzero(got > floor[:, None])
    return [(ids[i], ids[j], s) for i, j, s in zip(rows.tolist(), near[rows, columns].tolist(), got[rows, columns].tolist(), strict=True)]


def _edges(rows: list[tuple[int, int, float]]):
    import pyarrow as pa

    u, v, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["u", "v", "sim"])


def _compared(ids: list[int], vecs: list[bytes], floors: np.ndarray):
    rows = unit(vecs)
    sims = rows @ rows.T
    np.fill_diagonal(sims, -2.0)
    spans = [(u, v, SPAN) for u, v in spanning(np.array(ids), sims >= COSINE)]
    return _edges(_best(ids, sims, floors, NEIGHBOURS) + spans)


def _signer(first: int):
    def run(batches):
        import pyarrow as pa

        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = 1 << np.arange(BITS, dtype=np.int64)[::-1]
        for batch in batches:
            rep, grp, vec = (c.to_pylist() for c in batch.columns)
            for dim, part in groupby(sorted(range(len(rep)), key=lambda i: len(vec[i])), lambda i: len(vec[i])):
                at = list(part)
                rows = unit([vec[i] for i in at])
                for tree in range(first, first + SIGNATURES):
                    if (tree, dim) not in planes:
                        planes[tree, dim] = np.random.Generator(np.random.PCG64([tree, dim])).standard_normal((rows.shape[1], BITS))
                    signs = ((rows @ planes[tree, dim]) > 0).astype(np.int64) @ weights
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([tree] * len(at), pa.int32()),
                            pa.array([grp[i] for i in at]),
                            pa.array(signs),
                            pa.array([rep[i] for i in at], pa.int64()),
                            pa.array([vec[i] for i in at], pa.binary()),
                        ],
                        names=["tree", "grp", "sign", "rep", "vec"],
                    )

    return run


def _window_neighbours(size: int, shift: int):
    @lean
    def run(batches):
        for _, rows in _windowed(batches, size, shift):
            _, ids, vecs = zip(*rows, strict=True)
            yield _compared(list(ids), list(vecs), np.full(len(ids), -2.0))

    return run


def _windowed(batches, size: int, shift: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Windows of sorted rows of one (tree, group), never a whole group; the first is ``shift`` rows shorter."""
    held, rows, room = None, [], size - shift
    for batch in batches:
        listed = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for row in listed:
            if rows and (row[:2] != held or len(rows) == room):
                yield held, rows
                rows, room = [], size if row[:2] == held else size - shift
            held = row[:2]
            rows.append(row[2:])
    if rows:
        yield held, rows


def _nearest(edges: DataFrame) -> DataFrame:
    """The best ``NEIGHBOURS`` distinct neighbours of every class, with their rank."""
    best = W.partitionBy("u").orderBy(F.desc("sim"), "v")
    distinct = edges.where(F.col("sim") < SPAN).groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return distinct.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEIGHBOURS)


def _start(classes: DataFrame, restart: int) -> DataFrame:
    """Neighbours within windows of sorted signatures; every restart has its own planes and shift."""
    shift = WINDOW * restart // (RESTARTS + 1)
    signed = classes.select("rep", "grp", "vec").mapInArrow(
        _signer(restart * SIGNATURES), "tree int, grp string, sign long, rep long, vec binary"
    )
    order = ["tree", "grp", "sign", "rep"]
    dealt = signed.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_window_neighbours(WINDOW, shift), "u long, v long, sim double")


@lean
def _local_join(batches):
    for _, rows in grouped(batches, 2):
        ids, floors, vecs = zip(*rows, strict=True)
        if len(ids) > 1:
            yield _compared(list(ids), list(vecs), np.array(floors))


def _refine(graph: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """Better neighbours found among the neighbours of a class, itself included; each turn splits them anew."""
    both = (
        graph.select(F.col("u").alias("center"), F.col("v").alias("member"))
        .unionByName(graph.select(F.col("v").alias("center"), F.col("u").alias("member")))
        .unionByName(graph.select(F.col("u").alias("center"), F.col("u").alias("member")))
        .distinct()
    )
    floors = graph.groupBy("u").agg(
        F.when(F.count("*") >= NEIGHBOURS, F.min("sim")).otherwise(F.lit(-2.0)).alias("floor")
    )
    members = classes.select(F.col("rep").alias("member"), "vec").join(floors.withColumnRenamed("u", "member"), "member")
    parts = both.groupBy("center").agg(F.ceil(F.count("*") / F.lit(LOCAL)).cast("int").alias("parts"))
    dealt = (
        both.join(parts, "center")
        .select("center", F.pmod(F.xxhash64("member", F.lit(turn)), F.col("parts")).cast("int").alias("part"), "member")
        .join(members, "member")
        .select("center", "part", "member", "floor", "vec")
    )
    ordered = dealt.repartition("center", "part").sortWithinPartitions("center", "part", "member")
    return ordered.mapInArrow(_local_join, "u long, v long, sim double")


def descend(
    scratch: Scratch, classes: DataFrame, restart: int, before: DataFrame | None = None, rounds: int = ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph (u, v, sim, rank) after refinement, and links (u, v) that span its groups."""
    name = f"descent{restart}"
    found = scratch.write(_start(classes, restart), f"{name}_found0")
    links = found.where(F.col("sim") == SPAN).select("u", "v").distinct()
    own = found.unionByName(before.select("u", "v", "sim")) if before else found
    graph = scratch.write(_nearest(own), f"{name}_graph0")
    total = graph.count()
    for turn in range(1, rounds + 1):
        better = scratch.write(_refine(graph, classes, restart * (rounds + 1) + turn), f"{name}_found{turn}")
        links = links.unionByName(better.where(F.col("sim") == SPAN).select("u", "v").distinct())
        after = scratch.write(_nearest(graph.select("u", "v", "sim").unionByName(better)), f"{name}_graph{turn}")
        changed = after.join(graph.select("u", "v"), ["u", "v"], "left_anti").count()
        scratch.drop(f"{name}_graph{turn - 1}")
        graph = after
        if changed <= SETTLED * total:
            break
    links = links.unionByName(graph.where(F.col("sim") >= COSINE).select("u", "v")).distinct()
    links = scratch.write(links, f"{name}_links")
    scratch.drop(*(n for n in list(scratch.names) if n.startswith(f"{name}_found")))
    return graph, links


@lean
def _block_counts(batches):
    """Links of the members of one block with those of another: (rep, links), copies counted."""
    import pyarrow as pa

    for (_, i, j), rows in grouped(batches, 3):
        ids, sides, copies, vecs = zip(*rows, strict=True)
        a = unit(list(vecs))
        side, weight, ids = np.array(sides), np.array(copies), np.array(ids)
        left = side == i
        right = side == j
        near = (a[left] @ a[right].T) >= COSINE
        if i == j:
            np.fill_diagonal(near, False)
        counts = near @ weight[right]
        found = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[left][found], pa.int64()), pa.array(counts[found], pa.int64())], names=["rep", "links"])


def _enlarged(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(rep, links): every member of a component compared with the whole component, in blocks."""
    placed = classes.join(found.withColumnRenamed("node", "rep"), "rep")
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    side = placed.join(sizes, "component").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = side.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["component", "i", "j", "rep", "side", "copies", "vec"]
    ordered = other.select("component", F.col("side").alias("i"), F.col("other").alias("j"), "rep", "side", "copies", "vec")
    turned = other.where("side <> other").select(
        "component", F.col("other").alias("i"), F.col("side").alias("j"), "rep", "side", "copies", "vec"
    )
    dealt = ordered.unionByName(turned).select(*columns).repartition("component", "i", "j")
    return (
        dealt.sortWithinPartitions("component", "i", "j", "rep")
        .mapInArrow(_block_counts, "rep long, links long")
        .groupBy("rep")
        .agg(F.sum("links").alias("links"))
    )


def _sample(scratch: Scratch, classes: DataFrame) -> list:
    """Up to ``AUDITED`` classes (rep, grp, vec, part) of every size of group, chosen by hash."""
    part = F.greatest(F.ceil(F.log2(F.count("*") / F.lit(WINDOW)) / 2), F.lit(0)).cast("int").alias("part")
    parts = scratch.write(classes.groupBy("grp").agg(part), "sizes")
    chosen = []
    for row in parts.select("part").distinct().collect():  # grows with the logarithm of the largest group
        of = classes.join(parts.where(F.col("part") == row["part"]), "grp")
        chosen += of.orderBy(F.xxhash64("rep"), "rep").limit(AUDITED).select("rep", "grp", "vec", "part").collect()
    return chosen


def _recall(scratch: Scratch, classes: DataFrame, chosen: list, found: DataFrame, name: str) -> float:
    """The least mean share of links met, over parts of the chosen classes of like groups and numbers of links."""
    by_group: dict[str, tuple[list[tuple[int, int]], np.ndarray]] = {}
    for grp, rows in groupby(sorted(chosen, key=lambda r: r["grp"]), lambda r: r["grp"]):
        listed = list(rows)
        by_group[grp] = [(r["rep"], r["part"]) for r in listed], unit([bytes(r["vec"]) for r in listed])
    sent = classes.sparkSession.sparkContext.broadcast(by_group)  # at most AUDITED vectors of each size

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rep, grp, vec, component = (c.to_pylist() for c in batch.columns)
            out = Counter()
            for name, part in groupby(sorted(range(len(rep)), key=lambda i: grp[i]), lambda i: grp[i]):
                if name in sent.value:
                    at, (ids, rows) = list(part), sent.value[name]
                    sims = rows @ unit([vec[i] for i in at]).T
                    for a, b in zip(*np.nonzero(sims >= COSINE), strict=True):
                        if ids[a][0] != rep[at[b]]:
                            out[(*ids[a], component[at[b]])] += 1
            u, size, met = zip(*out, strict=True) if out else ((), (), ())
            columns = [pa.array(u, pa.int64()), pa.array(size, pa.int32()), pa.array(met, pa.int64()), pa.array(list(out.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "part", "component", "n"])

    placed = classes.select("rep", "grp", "vec").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    true = scratch.write(placed.mapInArrow(run, "u long, part int, component long, n long"), name)
    met = F.sum(F.when(F.col("component") == F.col("own"), F.col("n")).otherwise(0))
    shares = (
        true.join(found.toDF("u", "own"), "u", "left")
        .groupBy("part", "u")
        .agg(F.sum("n").alias("links"), (met / F.sum("n")).alias("share"))
    )
    worst = shares.groupBy("part", F.floor(F.log2("links"))).agg(F.avg("share").alias("recall")).agg(F.min("recall")).first()[0]
    return 1.0 if worst is None else worst


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> tuple[DataFrame, float]:
    """One row per vector (id, n_links, component_id, kept), and the audited recall of the links in the worst part.

    The recall is below ``RECALL`` only if all restarts did not reach it: then links are missing.
    """
    scratch = Scratch(vectors.sparkSession, "embed")
    narrow = vectors.select(
        vectors[vec_id].cast("long").alias("key"),
        vectors[embedding].cast("array<float>").alias("embedding"),
        vectors[label].cast("string").alias("label"),
    )
    usable = scratch.write(narrow.mapInArrow(_usable, "key long, grp string, vec binary"), "usable")
    repeated = scratch.write(usable.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"), "repeated")
    first = usable.join(repeated, "key", "left_semi").groupBy("key").agg(F.min(F.struct("grp", "vec")).alias("one"))
    single = usable.join(repeated, "key", "left_anti").unionByName(first.select("key", "one.grp", "one.vec"))
    classes = scratch.write(
        single.groupBy("grp", "vec").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "classes"
    )

    chosen = _sample(scratch, classes)
    graph, links, recall = None, None, 1.0
    for restart in range(RESTARTS + 1):
        graph, more = descend(scratch, classes, restart, graph)
        links = links.unionByName(more) if links else more
        found = scratch.write(components(scratch, links, f"parts{restart}"), f"found{restart}")
        recall = _recall(scratch, classes, chosen, found, f"true{restart}")
        if recall >= RECALL:
            break
    counted = scratch.write(_enlarged(classes, found), "counted")

    copied = classes.where("copies > 1").select("grp", "vec", "rep", "copies")
    twins = scratch.write(single.join(copied, ["grp", "vec"]).select("key", "rep", "copies"), "twins")
    rows = narrow.select("key").join(twins, "key", "left").withColumn("rep", F.coalesce("rep", "key"))
    rows = rows.join(counted, "rep", "left").join(found.toDF("rep", "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    result = scratch.finish(
        rows.select(
            F.col("key").alias(vec_id),
            (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
            component.alias("component_id"),
            (F.col("key").isNull() | (F.col("key") == component)).alias("kept"),
        )
    )
    return result, recall
