"""Consolidating pairwise matches into groups (problem 2).

Rounds of two reductions shrink the graph: vertices of degree one are stripped (each remembers its
neighbour), chains of vertices of degree two are ranked by pointer doubling and replaced by one
edge between their ends, until no round removes an edge. What resists - the core - is solved by
alternating large-star and small-star contractions; then labels are handed back to the removed
vertices, last removed first. All of it is joins on vertex or edge keys; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.skew import hot_join
from factloom.session import Scratch


def normal_edges(pairs: DataFrame) -> DataFrame:
    """Distinct undirected edges (a < b); null ends and loops link nothing."""
    a, b = pairs.columns[:2]
    return (pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
            .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())


def _degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")),
                                          F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("x")).select("x.*")
    return both.groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("n").alias("n1"), F.max("n").alias("n2"))


def _edge(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def strip_leaves(edges: DataFrame) -> DataFrame:
    """(v, parent, a, b): leaves with their edges. Of an edge between two leaves the greater end goes."""
    leaves = _degrees(edges).where("deg = 1").select("v", *_edge("v", "n1"))
    used = leaves.groupBy("a", "b").agg(F.max("v").alias("v"))
    return used.select("v", F.when(F.col("v") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent"), "a", "b")


def _rank(inner: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Arcs (v, u) of the vertices (v, n1, n2) with the end they lead to and the steps to it; null on a cycle. And how many are null.

    An arc v -> u means leaving v towards u; its successor leaves u on the other side. Pointer
    doubling over arcs reaches the end of a chain of length L in log2(L) rounds.
    """
    arcs = inner.select("v", F.explode(F.array("n1", "n2")).alias("u"))
    follow = inner.select(F.col("v").alias("u"), "n1", "n2")
    open_ = F.col("end").isNull()
    state, still = scratch.keep_counted(arcs.join(follow, "u", "left").select(
        "v", "u", F.when(F.col("n1").isNull(), F.col("u")).alias("end"), F.lit(1).cast("bigint").alias("rank"),
        F.when(F.col("n1").isNotNull(), F.col("u")).alias("cv"),
        F.when(F.col("n1") == F.col("v"), F.col("n2")).otherwise(F.col("n1")).alias("cu")), open_)
    before = None
    while still and still != before:
        target = state.select(F.col("v").alias("cv"), F.col("u").alias("cu"), F.col("end").alias("t_end"),
                              F.col("rank").alias("t_rank"), F.col("cv").alias("t_cv"), F.col("cu").alias("t_cu"))
        moved = state.where("end is null").join(target, ["cv", "cu"]).select(
            "v", "u", F.col("t_end").alias("end"), (F.col("rank") + F.col("t_rank")).alias("rank"),
            F.col("t_cv").alias("cv"), F.col("t_cu").alias("cu"))
        before = still
        after, still = scratch.keep_counted(state.where("end is not null").unionByName(moved), open_)
        scratch.drop(state)
        state = after
    return state, still


def rank_chains(inner: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, u1, u2, e1, r1, e2, r2): for each vertex inside a chain (v, n1, n2) its neighbours, its two ends and the steps to them.

    A component that is one cycle has no ends: its vertices smaller than both their neighbours are
    taken for ends, which makes chains of the rest.
    """
    state, round_ = _rank(inner, scratch)
    arcs = state.where("end is not null")
    if round_:
        cyclic = state.where("end is null").select("v").distinct()
        arcs = arcs.unionByName(_rank(inner.join(cyclic, "v", "left_semi").where(F.col("v") > F.least("n1", "n2")), scratch)[0])
    sides = arcs.select("v", F.struct(F.col("u").alias("u"), F.col("end").alias("end"), F.col("rank").alias("rank")).alias("side"))
    return (sides.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("s1"), F.max("side").alias("s2")).where("n = 2")
            .select("v", F.col("s1.u").alias("u1"), F.col("s2.u").alias("u2"), F.col("s1.end").alias("e1"), F.col("s1.rank").alias("r1"),
                    F.col("s2.end").alias("e2"), F.col("s2.rank").alias("r2")))


def solve_core(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) by alternating stars; root is the smallest vertex of the component."""
    current, before = edges.select(F.col("b").alias("u"), F.col("a").alias("m")), None
    current = scratch.keep(current)
    while True:
        both = current.unionByName(current.select(F.col("m").alias("u"), F.col("u").alias("m")))
        least = both.groupBy("u").agg(F.least(F.min("m"), F.first("u")).alias("low"))
        large = both.where("m > u").join(least, "u").select(F.col("m").alias("u"), F.col("low").alias("m")).where("u <> m").distinct()
        large = scratch.keep(large)
        down = large.select(F.greatest("u", "m").alias("u"), F.least("u", "m").alias("m"))
        low = down.groupBy("u").agg(F.min("m").alias("low"))
        small = down.join(low, "u").select(F.explode(F.array(F.col("m"), F.col("u"))).alias("u"), F.col("low").alias("m")).where("u <> m").distinct()
        small = scratch.keep(small)
        mark = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "m").cast("decimal(38,0)"))).first()
        scratch.drop(large)
        scratch.drop(current)
        current = small
        if mark == before:
            return current.select(F.col("u").alias("v"), F.col("m").alias("root"))
        before = mark


def reduce_once(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, list[DataFrame]]:
    """One round: leaves stripped, chains compressed. Returns the edges left, their number and the links (v, parent) to undo it."""
    hang = scratch.keep(strip_leaves(edges))
    rest, left = scratch.keep_counted(edges.join(hang.select("a", "b"), ["a", "b"], "left_anti"))
    inside, n = scratch.keep_counted(_degrees(rest).where("deg = 2").select("v", "n1", "n2"))
    if not n:
        scratch.drop(inside)
        return rest, left, [hang]
    chains = scratch.keep(rank_chains(inside, scratch))
    gone = chains.select(F.explode(F.array(F.struct(*_edge("v", "u1")), F.struct(*_edge("v", "u2")))).alias("x")).select("x.*").distinct()
    bridge = chains.where("e1 <> e2").select(*_edge("e1", "e2"))
    after, left = scratch.keep_counted(rest.join(gone, ["a", "b"], "left_anti").unionByName(bridge).distinct())
    scratch.drop(inside)
    scratch.drop(rest)
    # A chain both of whose ends are one vertex hangs on it; any other hangs on its smaller end.
    return after, left, [hang, chains]


def components(pairs: DataFrame) -> DataFrame:
    """(id, group_id, n_links) for every vertex of the first two columns of ``pairs``.

    group_id is the smallest id of the group. Repeated and reversed pairs count once, null ends and
    loops link nothing, other columns are ignored; no pairs give an empty result. Reductions go on
    until a round removes no edge; the core takes the rest, whatever its shape.
    """
    spark: SparkSession = pairs.sparkSession
    scratch = Scratch(spark, "p2")
    edges, left = scratch.keep_counted(normal_edges(pairs))
    first, before = edges, None
    links: list[DataFrame] = []
    while left and left != before:
        after, rest, undo = reduce_once(edges, scratch)
        links += undo
        if edges is not first:
            scratch.drop(edges)
        edges, before, left = after, left, rest
    labels = solve_core(edges, scratch) if left else spark.createDataFrame([], "v string, root string").select(
        F.col("v").cast(first.schema["a"].dataType).alias("v"), F.col("root").cast(first.schema["a"].dataType).alias("root"))
    for stage in reversed(links):
        known = labels.select(F.col("v").alias("parent"), "root")
        hung = stage.select("v", "parent" if "parent" in stage.columns else F.least("e1", "e2").alias("parent"))
        back = hung.join(known, "parent", "left").select("v", F.coalesce("root", "parent").alias("root"))
        after = scratch.keep(labels.unionByName(back))
        scratch.drop(labels)
        scratch.drop(stage)
        labels = after
    degrees = _degrees(first).select("v", F.col("deg").alias("n_links"))
    placed, vertices = scratch.keep_counted(degrees.join(labels, "v", "left").select("v", "n_links", F.coalesce("root", "v").alias("root")))
    groups = placed.groupBy("root").agg(F.min("v").alias("group_id"), F.count(F.lit(1)).alias("n"))
    return hot_join(placed, groups, ["root"], "n", vertices).select(F.col("v").alias("id"), "group_id", F.col("n_links").cast("bigint").alias("n_links"))


def corroboration_pairs(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs of rows of type CORROBORATES whose two ends are different, existing facts."""
    kind = F.upper(F.regexp_replace("relationship_type", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")) == "CORROBORATES"
    pairs = normal_edges(relationships.where(kind).select("left_fact_id", "right_fact_id"))
    ids = facts.where(F.col("fact_id").isNotNull()).select("fact_id").distinct()
    return (pairs.join(ids.withColumnRenamed("fact_id", "a"), "a", "left_semi")
            .join(ids.withColumnRenamed("fact_id", "b"), "b", "left_semi").select("a", "b"))


def fact_groups(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    return components(corroboration_pairs(relationships, facts)).select(F.col("id").alias("fact_id"), "group_id", "n_links")
