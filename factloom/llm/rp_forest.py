"""Most similar vectors for every vector (problem 4).

A forest of random-projection trees is fitted on a bounded sample; every vector is routed through
it on its own. One priority queue over all trees of a vector holds the branches it did not take,
ordered by the distance to the split; the nearest are visited too, and branches met on the way join the queue. Vectors meet in leaves, where
one matrix product compares them all; the best of all leaves are merged by exact similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

TREES = 3
EXTRA = 3  # leaves a vector visits beside its own in each tree, at least; one less than the levels of a tree, if that is more
LEAF = 8192  # vectors of a leaf, about
SAMPLE = 20_000  # vectors the trees are fitted on, at most
BROADCAST_ROWS = 1_000_000  # most rows of a set of excluded rows that is broadcast; a larger one is joined by shuffle
DENSE = 32  # sample vectors a node needs for a threshold of its own; below, that of its last ancestor with as many is used
CROWDED = 4  # leaves of more than so many times LEAF vectors are compared in pairs of blocks
BITS = 20  # of a coordinate on its way to the leaves
SPREAD = 3  # the trees project into the SPREAD x depth leading directions of the sample


class Forest:
    """Trees with one direction for each level and one threshold (a median of the sample) for each node."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, visits: int = TREES + EXTRA, seed: int = 7):
        self.depth, self.trees, self.visits = depth, trees, max(trees, visits if depth else trees)
        dims = sample.shape[1]
        rng = np.random.default_rng(seed)
        lead = min(dims, max(depth, SPREAD * depth))
        _, axes = np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 else np.eye(dims))
        axes = axes[:, ::-1][:, :lead]
        self.directions = np.empty((dims, trees * depth), np.float32)
        for t in range(trees):
            turn, _ = np.linalg.qr(rng.standard_normal((lead, max(depth, 1))))
            self.directions[:, t * depth:(t + 1) * depth] = (axes @ turn)[:, :depth]
        p = sample @ self.directions
        self.thresholds: list[list[np.ndarray]] = []
        for t in range(trees):
            own, node, founder, groups = [], np.zeros(len(sample), np.int64), np.zeros(1, np.int64), [np.arange(len(sample))]
            for level in range(depth):
                x = p[:, t * depth + level]
                size = np.bincount(node, minlength=2**level)
                ends, order = np.cumsum(size), np.argsort(node, kind="stable")
                for v in np.nonzero(size >= DENSE)[0]:
                    founder[v] = len(groups)
                    groups.append(order[ends[v] - size[v]:ends[v]])
                middle = np.zeros(len(groups), np.float32)
                for f in np.unique(founder):
                    middle[f] = np.median(x[groups[f]])
                own.append(middle[founder])
                node = node * 2 + (x > own[-1][node])
                founder = np.repeat(founder, 2)
            self.thresholds.append(own)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own, others): bucket numbers, trees and visits - trees of them for each row."""
        p, n, depth = x @ self.directions, len(x), self.depth
        own = np.empty((n, self.trees), np.int64)
        extra = min(self.visits - self.trees, self.trees * (2**depth - 1))
        # The queue: branches not taken with the distance to their split, and at least that of the branch they were met on.
        width = (self.trees + max(extra, 0)) * depth
        bound, branch, below = np.full((n, width), np.inf, np.float32), np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)

        def descend(t: np.ndarray, node: np.ndarray, start: np.ndarray, least: np.ndarray, slot: int) -> np.ndarray:
            for level in range(depth):
                go = start <= level
                gap = p[rows, t * depth + level] - cuts[t, 2**level - 1 + np.where(go, node, 0)]
                bound[:, slot + level] = np.where(go, np.maximum(least, np.abs(gap)), np.inf)
                branch[:, slot + level] = node * 2 + (gap <= 0)
                below[:, slot + level] = t
                node = np.where(go, node * 2 + (gap > 0), node)
            return (t << depth) + node

        rows, none = np.arange(n), np.zeros(n, np.int64)
        cuts = np.array([np.concatenate(own_cuts) for own_cuts in self.thresholds]) if depth else np.empty((self.trees, 0), np.float32)
        for t in range(self.trees):
            own[:, t] = descend(none + t, none, none, np.zeros(n, np.float32), t * depth)
        others = np.empty((n, max(extra, 0)), np.int64)
        for e in range(extra):
            best = bound.argmin(1)
            least = bound[rows, best]
            bound[rows, best] = np.inf
            others[:, e] = descend(below[rows, best], branch[rows, best], best % depth + 1, least, (self.trees + e) * depth)
        return own, others


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    x = flat.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def top_k(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest entries of each row (all, if there are fewer), best first."""
    n, m = s.shape
    if m > 16 * k:
        width = m // (8 * k)
        low = np.partition(s[:, :width * 8 * k].reshape(n, 8 * k, width).max(2), -k, axis=1)[:, -k]
        r, c = np.nonzero(s >= low[:, None])
    else:
        r, c = np.divmod(np.arange(n * m), m) if m else (np.empty(0, int), np.empty(0, int))
    v = s[r, c]
    keep = v > -2
    r, c, v = r[keep], c[keep], v[keep]
    order = np.lexsort((c, -v, r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(n))
    rank = np.arange(len(r)) - first[r]
    return r[rank < k], c[rank < k]


def pack(x: np.ndarray) -> np.ndarray:
    """Rows as bytes: coordinates scaled to the largest one, the upper 16 of their BITS bits, then the others."""
    v = np.round(x * (((1 << BITS - 1) - 1) / np.abs(x).max(axis=1, keepdims=True))).astype(np.int32)
    low = (v & 15).astype(np.uint8)
    low = np.pad(low, ((0, 0), (0, low.shape[1] % 2)))
    return np.concatenate([(v >> 4).astype("<i2").view(np.uint8), low[:, ::2] | low[:, 1::2] << 4], axis=1)


def unpack(data: bytes, dims: int) -> np.ndarray:
    """Unit vectors of packed rows."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, 2 * dims + (dims + 1) // 2)
    high, low = rows[:, :2 * dims].copy().view("<i2").astype(np.int32), rows[:, 2 * dims:]
    both = np.stack([low & 15, low >> 4], axis=2).reshape(len(rows), 2 * low.shape[1])[:, :dims]
    x = (high * 16 + both).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _router(forest_cast, dims: int, vectors: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = forest_cast.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dims)
            own, others = forest.route(x)
            places = np.concatenate([own * 2, others * 2 + 1], axis=1)
            if not vectors:
                value, n = np.unique(places >> 1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["bucket", "n"])
                continue
            packed = pack(x)
            n, width = places.shape
            size = packed.shape[1]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(places.ravel())),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(packed.tobytes())]),
            ], names=["id", "places", "vec"])

    return run


def _leaf(k: int, dims: int, chunk: int = 512):
    """Compares the vectors of a leaf: those whose own path ends here with all, visitors with those.

    Of a pair of blocks (``part`` 0 and 1) only vectors of different blocks are compared.
    """

    def lists(ids: np.ndarray, r: np.ndarray, c: np.ndarray, s: np.ndarray, n: int) -> list[bytes]:
        sims, names = s.astype("<f4"), ids[c]
        bounds = np.searchsorted(r, np.arange(n + 1))
        sb, nb, w = sims.tobytes(), names.tobytes(), names.dtype.itemsize
        return [bytes([b - a]) + sb[4 * a:4 * b] + nb[w * a:w * b] for a, b in zip(bounds[:-1], bounds[1:])]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("role")
        ids = np.char.encode(table.column("id").to_numpy().astype(str), "utf-8")
        role, part = table.column("role").to_numpy(), table.column("part").to_numpy()
        x = unpack(b"".join(table.column("vec").to_pylist()), dims)
        _, once = np.unique(ids, return_index=True)  # the first of a vector's rows is that of its own path
        side = [[once[(role[once] == r) & (part[once] == p)] for r in (0, 1)] for p in (0, 1)]
        if len(side[1][0]) + len(side[1][1]):
            asked = [(side[p][r], np.concatenate(side[1 - p]) if r == 0 else side[1 - p][0], False) for p in (0, 1) for r in (0, 1)]
        else:
            asked = [(side[0][0], np.concatenate(side[0]), True), (side[0][1], side[0][0], False)]
        found_q: list[np.ndarray] = []
        found_p: list[bytes] = []
        for asks, gives, same in asked:
            if not len(asks) or not len(gives):
                continue
            turned = x[gives].T
            for i in range(0, len(asks), chunk):
                s = x[asks[i:i + chunk]] @ turned
                if same:
                    s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
                r, c = top_k(s, k)
                found_p += lists(ids[gives], r, c, s[r, c], len(s))
                found_q.append(ids[asks[i:i + chunk]])
        q = np.concatenate(found_q) if found_q else np.empty(0, "S1")
        return pa.table({"q": pa.array(np.char.decode(q, "utf-8").tolist(), pa.string()), "found": pa.array(found_p, pa.binary())})

    return run


def _merger(k: int):
    """Rows of one query stand together; those of the last query wait for the next batch."""

    def best(qs: list[str], packs: list[bytes]) -> tuple[list, list, list]:
        out: tuple[list, list, list] = ([], [], [])
        i = 0
        while i < len(qs):
            q, seen = qs[i], {}
            while i < len(qs) and qs[i] == q:
                p = packs[i]
                n = p[0]
                if n:
                    w = (len(p) - 1 - 4 * n) // n
                    sims = np.frombuffer(p, "<f4", n, 1).tolist()
                    for j, s in enumerate(sims):
                        seen[p[1 + 4 * n + j * w:1 + 4 * n + (j + 1) * w].rstrip(b"\0")] = s
                i += 1
            ranked = sorted(seen.items(), key=lambda e: (-e[1], e[0]))[:k]
            for name, s in ranked:
                out[0].append(q)
                out[1].append(name.decode("utf-8"))
                out[2].append(s)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, schema = ["q", "c", "sim"], [pa.string(), pa.string(), pa.float32()]
        held_q, held_p = [], []
        for batch in batches:
            qs, packs = held_q + batch.column(0).to_pylist(), held_p + batch.column(1).to_pylist()
            if not qs:
                continue
            cut = len(qs)
            while cut and qs[cut - 1] == qs[-1]:
                cut -= 1
            held_q, held_p = qs[cut:], packs[cut:]
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(best(qs[:cut], packs[:cut]), schema)], names=names)
        if held_q:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(best(held_q, held_p), schema)], names=names)

    return run


def usable(column: str, dims: int):
    c = F.col(column)
    top, low = F.array_max(c), F.array_min(c)
    bound = F.lit(float("inf")).cast("float")
    return (c.isNotNull() & (F.size(c) == dims) & (F.size(F.array_compact(c)) == dims) & ~F.isnan(top) & (top < bound) & (low > -bound)
            & ((top != 0) | (low != 0)))


def nearest(vectors: DataFrame, k: int = 5, dims: int = 128, trees: int = TREES, visits: int | None = None, leaf: int = LEAF) -> DataFrame:
    """(id, neighbour, similarity): for each fact its k most similar others by cosine.

    A fact's vector is its usable row with the latest created_at (of rows equally late, the one with the
    greatest hash); usable means ``dims`` finite numbers, not all zero. Rows with null id or vector
    are left out, repeated rows count once. Facts with the very same vector are one point of the
    forest: their copies come first in each other's list, by id, so that a vector shared by a third of
    all facts costs no more than its distinct value. Ties go to the smaller id. Empty: empty. A leaf
    that holds far more vectors than LEAF is compared in pairs of blocks, so that no task holds more
    than two. Coordinates reach the leaves with BITS bits: similarities are exact to about 1e-6.
    """
    spark: SparkSession = vectors.sparkSession
    rows = vectors.where(F.col("fact_id").isNotNull() & usable("embedding", dims)).select("fact_id", "created_at", "embedding")
    light = rows.select("fact_id", F.struct(F.coalesce("created_at", F.lit(0).cast("timestamp")).alias("at"), F.xxhash64("embedding").alias("h")).alias("s"))
    latest = light.groupBy("fact_id").agg(F.max("s").alias("s"), F.min("s.h").alias("h0"), F.max("s.h").alias("h1"))
    stale = latest.where("h0 <> h1").select("fact_id", F.col("s.h").alias("h"))
    now = latest.select("fact_id", F.col("s.h").alias("h"))
    shared = now.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("fact_id").alias("rep")).where("m > 1")
    spare = now.join(shared, "h").where("fact_id <> rep").select("fact_id", "h", "rep", "m")
    n_stale, n_spare, n = stale.count(), spare.count(), now.count()
    hashed = rows.select("fact_id", "embedding", F.xxhash64("embedding").alias("h"))
    if n_stale:
        side = stale.withColumnRenamed("h", "good")
        hashed = hashed.join(F.broadcast(side) if n_stale <= BROADCAST_ROWS else side, "fact_id", "left").where("good is null or h = good")
    if n_spare:
        side = spare.select("fact_id")
        hashed = hashed.join(F.broadcast(side) if n_spare <= BROADCAST_ROWS else side, "fact_id", "left_anti")
    points = n - n_spare
    depth = max(0, round(math.log2(max(1.0, points / leaf))))
    visits = visits or trees + max(EXTRA, depth - 1)  # the deeper the trees, the more often near vectors part
    share = min(1.0, 1.2 * SAMPLE / max(points, 1))
    taken = rows.where(F.pmod(F.xxhash64("fact_id", F.lit(11)), F.lit(1 << 40)) < int(share * (1 << 40))).select("embedding").limit(SAMPLE)
    sample = _matrix(pa.chunked_array(taken.toArrow().column(0).chunks, type=pa.list_(pa.float32())).combine_chunks(), dims) if depth and points else np.zeros((1, dims), np.float32)
    if not len(sample):
        depth, sample = 0, np.zeros((1, dims), np.float32)
    forest = spark.sparkContext.broadcast(Forest(sample, depth, trees if depth else 1, visits if depth else 1))
    points_of = hashed.select("fact_id", "embedding")
    # Leaves the sample did not foresee: they are few, a crowded leaf has CROWDED x leaf vectors or more.
    sizes = points_of.mapInArrow(_router(forest, dims, vectors=False), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    crowded = [(r["bucket"], -(-r["n"] // (2 * leaf))) for r in sizes.where(F.col("n") > CROWDED * leaf).collect()]
    routed = points_of.mapInArrow(_router(forest, dims), "id string, places array<bigint>, vec binary")
    placed = routed.select("id", "vec", F.explode("places").alias("place")).select(
        "id", "vec", F.shiftright("place", 1).alias("bucket"), F.col("place").bitwiseAND(F.lit(1)).cast("int").alias("role"))
    if crowded:
        blocks = placed.join(F.broadcast(spark.createDataFrame(crowded, "bucket bigint, blocks long")), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = blocks.withColumn("b", F.pmod(F.xxhash64("id"), "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        celled = mine.select("id", "vec", "bucket", "role", (F.least("b", "j") * F.col("blocks") + F.greatest("b", "j")).alias("cell"), (F.col("b") > F.col("j")).cast("int").alias("part"))
    else:
        celled = placed.withColumn("cell", F.lit(0)).withColumn("part", F.lit(0))
    met = celled.groupBy("bucket", "cell").applyInArrow(_leaf(k, dims), "q string, found binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), points * visits // 2_000_000)
    merged = met.repartition(parts, "q").sortWithinPartitions("q").mapInArrow(_merger(k), "q string, c string, sim float")
    if n_spare:
        merged = _with_copies(merged, now, shared, spare, k)
    return merged.select(F.col("q").alias("id"), F.col("c").alias("neighbour"), F.col("sim").alias("similarity"))


def _with_copies(merged: DataFrame, now: DataFrame, shared: DataFrame, spare: DataFrame, k: int) -> DataFrame:
    """Puts the copies of points back: into the lists of others, and as facts with lists of their own."""
    from pyspark.sql import Window

    order = Window.partitionBy("h").orderBy("fact_id")
    heads = (now.join(shared, "h", "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
             .groupBy("h").agg(F.sort_array(F.collect_list("fact_id")).alias("ids")).join(shared, "h").select("rep", "m", "ids"))
    wide = merged.join(heads.select(F.col("rep").alias("c"), "ids"), "c", "left").select(
        "q", F.explode(F.coalesce("ids", F.array("c"))).alias("c"), "sim")
    own = heads.select(F.col("rep").alias("q"), F.explode("ids").alias("c"), F.lit(1.0).cast("float").alias("sim"))
    extra = spare.join(heads.select("rep", "ids"), "rep").select(F.col("fact_id").alias("q"), F.explode("ids").alias("c"), F.lit(1.0).cast("float").alias("sim"))
    lent = spare.where(F.col("m") <= k).select("fact_id", "rep").join(wide.withColumnRenamed("q", "rep"), "rep").select(F.col("fact_id").alias("q"), "c", "sim")
    every = wide.unionByName(own).unionByName(extra).unionByName(lent).where("q <> c")
    best = every.groupBy("q", "c").agg(F.max("sim").alias("sim"))
    rank = Window.partitionBy("q").orderBy(F.desc("sim"), "c")
    return best.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).drop("r")


def similar_pairs(vectors: DataFrame, k: int = 5, dims: int = 128) -> DataFrame:
    """p4_found: unordered pairs of which at least one is among the other's k most similar."""
    near = nearest(vectors, k, dims)
    return near.select(F.least("id", "neighbour").alias("left_fact_id"), F.greatest("id", "neighbour").alias("right_fact_id")).distinct()
