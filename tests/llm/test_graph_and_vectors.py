from __future__ import annotations

import random

import numpy as np
import pytest

from factloom.llm.components import components, fact_groups
from factloom.llm import rp_forest as rp
from factloom.llm.rp_forest import Forest, nearest, similar_pairs, top_k


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: find(k) for k in parent}


def graph(kind: str):
    rng = random.Random(3)
    v = [f"v{i:03d}" for i in range(60)]
    rng.shuffle(v)
    return {
        "chain": list(zip(v, v[1:])), "cycle": list(zip(v, v[1:] + v[:1])), "star": [(v[0], x) for x in v[1:]], "pair": [(v[0], v[1])],
        "clique": [(a, b) for a in v[:7] for b in v[:7] if a < b], "lollipop": [(a, b) for a in v[:5] for b in v[:5] if a < b] + list(zip(v[4:], v[5:])),
        "loop at a hub": [(v[0], v[1]), (v[1], v[2]), (v[2], v[0]), (v[0], v[3]), (v[3], v[4]), (v[4], v[0])],
        "random": [(rng.choice(v), rng.choice(v)) for _ in range(55)], "dirty": [("a", None), (None, "b"), ("c", "c"), ("d", "e"), ("e", "d"), ("d", "e")], "empty": [],
    }[kind]


@pytest.mark.parametrize("kind", ["chain", "cycle", "star", "pair", "clique", "lollipop", "loop at a hub", "random", "dirty", "empty"])
def test_components(spark, kind):
    pairs = graph(kind)
    got = {r["id"]: r["group_id"] for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == union_find(pairs)


def test_fact_groups_types_and_ends(spark):
    rel = [("r1", "f1", "f2", "CORROBORATES", 1), ("r1", "f1", "f2", "CORROBORATES", 2), ("r2", "f3", "f2", " corroborates\t", 1), ("r3", "f4", "f5", "CONTRADICTS", 1),
           ("r4", "f4", "f9", "CORROBORATES", 1), ("r5", None, "f4", "CORROBORATES", 1), ("r6", "f4", "f4", "CORROBORATES", 1), ("r7", "f4", "f5", None, 1)]
    r = spark.createDataFrame(rel, "relationship_id string, left_fact_id string, right_fact_id string, relationship_type string, root long")
    f = spark.createDataFrame([(f"f{i}", 1) for i in range(1, 6)] + [(None, 1)], "fact_id string, v long")
    got = sorted((x["fact_id"], x["group_id"]) for x in fact_groups(r, f).collect())
    assert got == [("f1", "f1"), ("f2", "f1"), ("f3", "f1")]


def brute(vectors: dict[str, np.ndarray], k: int):
    names = sorted(vectors)
    x = np.array([vectors[n] / np.linalg.norm(vectors[n]) for n in names])
    s = x @ x.T
    out = set()
    for i, n in enumerate(names):
        order = sorted((j for j in range(len(names)) if j != i), key=lambda j: (-round(s[i, j], 6), names[j]))[:k]
        out |= {tuple(sorted((n, names[j]))) for j in order}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "fact_id string, created_at timestamp_ntz, embedding array<float>, q string, bucket int")


def test_recall_against_brute_force(spark):
    from datetime import datetime

    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 16))
    vectors = {f"f{i:04d}": centres[i % 60] + 0.25 * rng.standard_normal(16) for i in range(480)}
    rows = [(n, datetime(2024, 1, 1), [float(x) for x in v], "z", 1) for n, v in vectors.items()]
    got = {tuple(r) for r in nearest(frame(spark, rows), 5, 16, leaf=64).selectExpr("least(id, neighbour)", "greatest(id, neighbour)").distinct().collect()}
    want = brute({n: np.array(v, np.float32) for n, v in vectors.items()}, 5)
    assert len(got & want) / len(want) >= 0.9


def test_dirty_vectors_copies_and_ties(spark):
    from datetime import datetime

    a, b = datetime(2024, 1, 1), datetime(2024, 2, 1)
    one, two = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.1, 0.0]
    rows = [(f"c{i}", a, one, "x", 0) for i in range(9)] + [("c0", a, one, "x", 0), ("d1", a, two, "x", 0), ("d1", b, [1.0, 0.01, 0.0, 0.1], "x", 0), ("e1", a, [2.0, 0.02, 0.0, 0.3], "x", 0),
            ("bad1", a, [0.0] * 4, "x", 0), ("bad2", a, [1.0, float("nan"), 0.0, 0.0], "x", 0), ("bad3", a, [1.0], "x", 0), ("bad4", a, None, "x", 0), (None, a, one, "x", 0), ("bad5", a, [float("inf"), 0.0, 0.0, 0.0], "x", 0)]
    got = {(r["id"], r["neighbour"]) for r in nearest(frame(spark, rows), 2, 4).collect()}
    assert {i for i, _ in got} == {f"c{i}" for i in range(9)} | {"d1", "e1"}
    assert {n for i, n in got if i == "c0"} == {"c1", "c2"} and {n for i, n in got if i == "c8"} == {"c0", "c1"}
    assert {n for i, n in got if i == "e1"} == {"d1", "c0"}
    assert similar_pairs(frame(spark, rows[:1]), 2, 4).count() == 0
    assert similar_pairs(frame(spark, rows).limit(0), 2, 4).count() == 0


def test_forest_routes_to_distinct_leaves():
    x = np.random.default_rng(1).standard_normal((500, 8)).astype(np.float32)
    own, others = Forest(x, 4).route(x)
    assert own.shape == (500, 3) and others.shape == (500, 3)
    assert all(len({*o, *e}) == 6 for o, e in zip(own.tolist(), others.tolist()))


def test_top_k():
    s = np.random.default_rng(2).random((7, 300)).astype(np.float32)
    r, c = top_k(s, 5)
    assert all(c[r == i].tolist() == np.argsort(-s[i])[:5].tolist() for i in range(7))


def test_route_visits_the_nearest_leaves_of_all_trees():
    rng = np.random.default_rng(3)
    forest = Forest(rng.standard_normal((4000, 12)).astype(np.float32), 4, trees=2, visits=14)
    x = rng.standard_normal((50, 12)).astype(np.float32)
    own, others = forest.route(x)
    p = x @ forest.directions
    twice = 0
    for i in range(len(x)):
        far = {}
        for t in range(2):
            for leaf in range(16):
                turned = [abs(g) for level in range(4) for g in [p[i, t * 4 + level] - forest.thresholds[t][level][leaf >> 4 - level]] if (g > 0) != (leaf >> 3 - level & 1)]
                far[(t << 4) + leaf] = max(turned, default=0)
                twice += len(turned) > 1 and (t << 4) + leaf in others[i]
        assert len(set(own[i]) | set(others[i])) == 14 and all(far[b] == 0 for b in own[i])
        assert np.allclose(sorted(far[b] for b in others[i]), sorted(far.values())[2:14])
    assert twice  # leaves two turns away are reached


def test_packed_vectors_keep_their_similarities():
    rng = np.random.default_rng(4)
    for dims in (7, 16):
        x = rng.standard_normal((200, dims)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rp.unpack(rp.pack(x).tobytes(), dims)
        assert np.abs(x @ x.T - y @ y.T).max() < 3e-6
    assert rp.unpack(b"", 16).shape == (0, 16)


def test_nodes_without_a_sample_cut_like_their_ancestors():
    """A forest far deeper than its sample still spreads the vectors: no leaf takes a share that grows."""
    rng = np.random.default_rng(8)
    forest = Forest(rng.standard_normal((2000, 24)).astype(np.float32), 11, trees=1, visits=1)
    x = rng.standard_normal((200_000, 24)).astype(np.float32)
    sizes = np.bincount(forest.route(x)[0][:, 0], minlength=2048)
    assert sizes.max() < 12 * sizes.mean() and (sizes > 0).mean() > 0.95


def test_crowded_leaves_and_ids_beyond_ascii(spark, monkeypatch):
    from datetime import datetime

    monkeypatch.setattr(rp, "CROWDED", 1)
    rng = np.random.default_rng(6)
    vectors = {f"é{i:03d}": rng.standard_normal(8) for i in range(150)}
    rows = [(n, datetime(2024, 1, 1), [float(x) for x in v], "z", 1) for n, v in vectors.items()]
    got = {tuple(r) for r in nearest(frame(spark, rows), 3, 8, leaf=100).selectExpr("least(id, neighbour)", "greatest(id, neighbour)").distinct().collect()}
    assert got == brute({n: np.array(v, np.float32) for n, v in vectors.items()}, 3)
