"""Nearest known names against a comparison of all pairs, and what they shuffle."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest

from factloom.operators import entities as en, nearest_names as nn

ENTITY = "entity_id string, normalized_name string, entity_type string, created_at timestamp"
ALIAS = "entity_id string, normalized_alias string"


def trigrams(text: str) -> set[str]:
    return {p[i:i + 3] for w in text.lower().split() for p in [f"  {w} "] for i in range(len(p) - 2)}


def brute(names, entities, aliases, least, limit):
    known = [(e, n, t) for e, n, t, _ in entities] + [(e, a, t) for e, a in aliases for x, _, t, _ in entities if x == e]
    grams = [(e, t, trigrams(n)) for e, n, t in known if n is not None and e is not None]
    created = {e: c for e, _, _, c in entities}
    out = set()
    for name, kind in names:
        g, best = trigrams(name), {}
        for e, t, h in grams:
            if t == kind and h:
                s = int((2_000_000 * len(g & h) + len(g | h)) // (2 * len(g | h))) / 1_000_000
                if s >= least:
                    best[e] = max(best.get(e, 0), s)
        ranked = sorted(best.items(), key=lambda x: (-x[1], created[x[0]] is None, created[x[0]] or datetime.min, x[0]))[:limit]
        out |= {(name, kind, e, s, r + 1) for r, (e, s) in enumerate(ranked)}
    return out


def made(seed: int, n: int):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bdgklmnprst") + rnd.choice("aeioué𐓘") for _ in range(rnd.randint(1, 4)))
    words = [word() for _ in range(40)] + ["telecommunications", "pharmaceuticals", "a", "7"]
    name = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
    kind = lambda: rnd.choice(["ORGANIZATION", "PERSON", None])
    start = datetime(2024, 1, 1)
    entities = [(f"e{i}", rnd.choice([name(), name(), name(), None]), kind(), rnd.choice([None, start, start + timedelta(rnd.randint(0, 3))])) for i in range(n)]
    aliases = [(f"e{rnd.randrange(n)}", name()) for _ in range(n)]
    return sorted({(name(), kind()) for _ in range(n)}, key=str), entities, aliases


@pytest.mark.parametrize("least,limit,block", [(0.3, 5, 10**6), (0.3, 5, 40), (0.5, 1, 40), (0.85, 2, 10**6), (1.0, 3, 40)])
def test_all_pairs(spark, monkeypatch, least, limit, block):
    monkeypatch.setattr(nn, "KNOWN_BLOCK", block)
    monkeypatch.setattr(nn, "NAMES_BLOCK", block)
    names, entities, aliases = made(int(least * 100) + limit, 120)
    got = en.trigram_candidates(spark.createDataFrame(names, "name string, type string"), spark.createDataFrame(entities, ENTITY), spark.createDataFrame(aliases, ALIAS), least, limit)
    rows = [tuple(r) for r in got.collect()]
    want = brute([x for x in names if x[1]], entities, aliases, least, limit)
    assert len(rows) == len(want) and set(rows) == want and want


def test_nothing_to_compare(spark):
    names, entities, aliases = (spark.createDataFrame([], s) for s in ("name string, type string", ENTITY, ALIAS))
    assert en.trigram_candidates(names, entities, aliases).count() == 0
    one = spark.createDataFrame([("", "PERSON"), ("abc", "PERSON")], "name string, type string")
    odd = spark.createDataFrame([("e1", "", "PERSON", None), ("e2", "xyz", "PERSON", None)], ENTITY)
    assert en.trigram_candidates(one, odd, aliases).count() == 0


def test_pairs_are_not_shuffled(spark):
    """700 names of one long word, each similar to 700 entities: once, 490,000 pairs were written and gathered."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def written() -> dict:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        time.sleep(2)  # for the status store
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    names = spark.createDataFrame([(f"{i:03d} telecommunications", "ORGANIZATION") for i in range(700)], "name string, type string")
    entities = spark.createDataFrame([(f"e{i}", f"{i + 300:03d} telecommunications", "ORGANIZATION", datetime(2024, 1, 1)) for i in range(700)], ENTITY)
    before = written()
    rows = en.trigram_candidates(names, entities, spark.createDataFrame([], ALIAS)).collect()
    assert len(rows) == 3500 and all(r["similarity"] > 0.5 for r in rows)
    assert 0 < sum(n for k, n in written().items() if k not in before) < 50_000
