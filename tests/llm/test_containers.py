from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from factloom.llm import containers as ct


@given(st.lists(st.integers(1, 64), max_size=120), st.integers(1, 6), st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_item_once_within_capacity(lengths, buckets, slack):
    counts = np.bincount(np.array(lengths, int), minlength=65) if lengths else np.zeros(65, int)
    ends = ct.boundaries(counts, buckets) or [64]
    made = ct.plan(counts, ends, 64, slack)
    load, own = np.zeros(made.containers, int), [set() for _ in range(made.containers)]
    for item, n in enumerate(sorted(lengths, reverse=True)):
        r = np.searchsorted(made.first, item, side="right") - 1
        c = made.start[r] + (item - made.first[r]) // made.per[r]
        load[c] += n
        if not made.topping[r]:
            own[c].add(int(np.searchsorted(ends, n)))
    assert (load <= 64).all() and (load > 0).all() and load.sum() == sum(lengths)
    assert all(len(x) == 1 for x in own), "the batch itself is of one bucket"


def test_the_buckets_decide_the_containers():
    counts = np.zeros(65, int)
    counts[[40, 20, 4]] = [10, 10, 60]
    apart, one = ct.plan(counts, [4, 20, 40], 64, 64), ct.plan(counts, [40], 64, 64)
    assert apart.containers > one.containers and not apart.topping.any() and not one.topping.any()
    topped = ct.plan(counts, [4, 20, 40], 64, 0)
    assert topped.containers == -(-counts @ np.arange(65) // 64) and topped.topping.any()


@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_boundaries_are_optimal(lengths, k):
    from itertools import combinations

    counts = np.bincount(lengths, minlength=31)
    distinct = sorted(set(lengths))

    def padding(ends):
        return sum(min(e for e in ends if e >= n) - n for n in lengths)

    best = min(padding(c + (distinct[-1],)) for c in combinations(distinct[:-1], min(k, len(distinct)) - 1))
    assert padding(ct.boundaries(counts, k)) == best


@pytest.mark.skipif(not os.path.exists(ct.TOKENIZER), reason="no tokenizer files")
def test_fill(spark):
    rows = [(i, "word " * (i % 37 + 1), "x") for i in range(200)] + [(500, "long " * 700, "x"), (501, None, "x"), (502, "", "x"), (503, " \n ", "x"), (3, "again", "x"), (504, "<|endoftext|>", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = ct.fill(d, 256, 8).toPandas()
    load = got.groupby("container_id").n_tokens.sum()
    assert load.max() <= 256 and load.sum() / (len(load) * 256) > 0.95
    assert (got[~got.topping].groupby("container_id").bucket.nunique() == 1).all()
    sizes = got.groupby("doc_id").n_tokens.sum()
    with open(ct.TOKENIZER, "rb") as f:
        e = ct.encoding(f.read())
    assert sizes[500] == len(e.encode_ordinary("long " * 700)) and set(got[got.doc_id == 500].piece) == {0, 1, 2} and (got[got.doc_id != 500].piece == 0).all()
    assert sizes[7] == len(e.encode_ordinary("word " * 8)) and 501 not in sizes and 502 not in sizes and len(got[got.doc_id == 3]) == 2
    assert ct.fill(d.limit(0), 256).count() == 0


@pytest.mark.skipif(not os.path.exists(ct.TOKENIZER), reason="no tokenizer files")
def test_one_length_of_all_rows_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ct, "PART", 50)
    d = spark.createDataFrame([(i, "same text here" if i % 3 else "word " * (i % 20 + 1)) for i in range(600)], "doc_id long, text string")
    got = ct.fill(d, 256, 8).toPandas()
    load = got.groupby("container_id").n_tokens.sum()
    assert len(got) == 600 and load.max() <= 256 and load.sum() / (len(load) * 256) > 0.95
