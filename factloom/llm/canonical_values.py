"""Mapping free-entered values to a canonical list (problem 6).

The reference list is widened by the wordings of facts that already carry a catalog entry. A
wording is looked up as it stands, then among all known wordings, however rare or long, by a join
over symmetric deletes: of all within a bounded edit distance the one with the least weighted
Damerau-Levenshtein distance wins, then the more frequent one. Wordings without any come out as
UNMATCHED.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.skew import hot_join
from factloom.session import Scratch

UNMATCHED = "UNMATCHED"
MAX_EDITS = 2
MAX_LENGTH = 100  # characters of a wording that is searched by deletes; a longer one is searched by its pieces
MAJORITY = 0.6  # share of a wording's facts that must agree on the catalog entry

# Words around a measure that do not change which measure it is.
LEADING = ["annual", "quarterly", "reported", "total", "group"]
TRAILING = ["audited", "unaudited", "consolidated", "standalone", "restated", "for the year", "amount"]
# Keys that stand side by side on a keyboard, by rows.
KEY_ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
# Letters that sound alike.
SOUND_PAIRS = ["sz", "ck", "iy", "vw", "fv", "ou", "cs"]


def wording(c: Column) -> Column:
    """Lower case words of letters and digits, one space between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), r"\s+", " "))


def measure(c: Column) -> Column:
    """The wording without the words around it; the wording itself if nothing would be left."""
    w = wording(c)
    head = rf"^(?:(?:{'|'.join(LEADING)}) )+"
    tail = rf"(?: (?:{'|'.join(TRAILING)}|fy ?\d{{2,4}}|(?:19|20)\d\d))+$"
    bare = F.regexp_replace(F.regexp_replace(w, tail, ""), head, "")
    return F.coalesce(F.when(F.length(bare) > 0, bare).otherwise(w), F.lit(""))


def _neighbours() -> set[str]:
    out = set()
    for r, row in enumerate(KEY_ROWS):
        for i, a in enumerate(row):
            near = [row[i + 1:i + 2]] + ([KEY_ROWS[r + 1][max(0, i - 1):i + 1]] if r + 1 < len(KEY_ROWS) else [""])
            for b in "".join(near):
                out |= {a + b, b + a}
    return out


CHEAP = _neighbours() | {p for x in SOUND_PAIRS for p in (x, x[::-1])}


def distance(a: str, b: str, limit: float = MAX_EDITS) -> float:
    """Weighted Damerau-Levenshtein (optimal alignment); above ``limit`` any larger number.

    A swap costs 0.8, a neighbouring or like-sounding key 0.7, a doubled letter or a space 0.6,
    anything else 1.
    """
    if abs(len(a) - len(b)) > 2 * limit:
        return limit + 1
    band = int(limit / 0.6) + 1  # off the diagonal by more, the cost is above the limit
    before, last = None, [0.0]
    for j in range(len(b)):
        last.append(last[j] + (0.6 if b[j] == " " or (j and b[j] == b[j - 1]) else 1))
    for i in range(1, len(a) + 1):
        x = a[i - 1]
        gone = 0.6 if x == " " or (i > 1 and x == a[i - 2]) else 1.0
        row = [last[0] + gone] + [inf] * len(b)
        for j in range(max(1, i - band), min(len(b), i + band) + 1):
            y = b[j - 1]
            if x == y:
                cost = last[j - 1]
            else:
                cost = last[j - 1] + (0.7 if x + y in CHEAP else 0.8 if " " in (x, y) else 1)
            come = 0.6 if y == " " or (j > 1 and y == b[j - 2]) else 1.0
            cost = min(cost, last[j] + gone, row[j - 1] + come)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 0.8)
            row[j] = cost
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return last[-1]


def deletes(word: str, edits: int) -> set[str]:
    out = {word}
    for n in range(1, min(edits, len(word)) + 1):
        for drop in combinations(range(len(word)), n):
            out.add("".join(c for i, c in enumerate(word) if i not in drop))
    return out


def edits_for(word: str) -> int:
    """Edits that a word of this length may bear."""
    return 0 if len(word) < 4 else 1 if len(word) < 7 else MAX_EDITS


class Dictionary:
    """Symmetric-delete index in memory over (wording, target, frequency), for short lists; variants of a known wording are left out."""

    def __init__(self, entries: list[tuple[str, str, int]]):
        self.words: list[tuple[str, str, int]] = []
        self.index: dict[int, list[int]] = {}
        self.exact: dict[str, int] = {}
        for word, target, n in sorted(entries, key=lambda e: (-e[2], e[0])):
            if word in self.exact or len(word) > MAX_LENGTH:
                continue
            near = self.lookup(word)
            if near is not None and near[0] == target and near[1] <= 1 and near[2] >= 5 * n:
                continue
            k = len(self.words)
            self.words.append((word, target, n))
            self.exact[word] = k
            for d in deletes(word, edits_for(word)):
                self.index.setdefault(hash(d), []).append(k)

    def lookup(self, word: str) -> tuple[str, float, int] | None:
        """(target, distance, frequency) of the best entry within the bounded distance."""
        if len(word) > MAX_LENGTH:
            return None
        seen: set[int] = set()
        best = None
        limit = edits_for(word)
        for d in deletes(word, limit):
            for k in self.index.get(hash(d), ()):
                if k in seen:
                    continue
                seen.add(k)
                own, target, n = self.words[k]
                cost = distance(word, own, limit)
                if cost <= limit and (best is None or (cost, -n, target) < (best[1], -best[2], best[0])):
                    best = (target, cost, n)
        return best


BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def delete_hashes(word: str, edits: int) -> np.ndarray:
    """Hashes of ``deletes``; the same in every process. Equal hashes are candidates only."""
    codes = (np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    size = len(codes)
    terms = codes * np.multiply.accumulate(np.full(size, BASE, np.uint64))
    sums = []  # of the first letters, moved by no, one and two places
    for _ in range(3):
        sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))
        terms = terms * np.uint64(UNBASE)
    s0, s1, s2 = sums
    out = [s0[-1:]]
    if edits >= 1 and size:
        i = np.arange(size)
        out.append(s0[i] + s1[-1] - s1[i + 1])
    if edits >= 2 and size > 1:
        i, j = np.triu_indices(size, 1)
        out.append(s0[i] + s1[j] - s1[i + 1] + s2[-1] - s2[j + 1])
    return np.unique(np.concatenate(out)).view(np.int64)


def _piece(size: int, k: int, text: str) -> int:
    return int(delete_hashes(f"{size} {k} {text}", 0)[0])


def known_hashes(word: str) -> list[int]:
    """Hashes under which a known wording is found. Two edits are at most four letters deleted, so one of five pieces of a long one stays whole."""
    n, pieces = len(word), 2 * MAX_EDITS + 1
    if n <= MAX_LENGTH:
        return delete_hashes(word, edits_for(word)).tolist()
    return [_piece(n, k, word[n * k // pieces:n * (k + 1) // pieces]) for k in range(pieces)]


def asked_hashes(word: str) -> list[int]:
    """Hashes that a wording has in common with every known wording within its edits."""
    m, pieces = len(word), 2 * MAX_EDITS + 1
    out = set(delete_hashes(word, edits_for(word)).tolist()) if m <= MAX_LENGTH + MAX_EDITS else set()
    for n in range(max(MAX_LENGTH + 1, m - MAX_EDITS), m + MAX_EDITS + 1):
        for k in range(pieces):
            for at in range(max(0, n * k // pieces - MAX_EDITS), n * k // pieces + MAX_EDITS + 1):
                out.add(_piece(n, k, word[at:at + n * (k + 1) // pieces - n * k // pieces]))
    return sorted(out)


def _hashed(hashes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at:at + 200]
                yield part.assign(h=[hashes(k) for k in part["key"]])

    return run


def _measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["distance"] = [distance(k, w, edits_for(k)) for k, w in zip(frame["key"], frame["known"])]
        yield frame.loc[frame["distance"] <= frame["key"].map(edits_for), ["key", "target", "n", "distance"]]


def search_all(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(key, predicate, distance): the best of all (key, target, n) in ``known`` within the edits of each key that has any."""
    asks = keys.where(F.length("key") >= 4).select("key").mapInPandas(_hashed(asked_hashes), "key string, h array<bigint>").select("key", F.explode("h").alias("h"))
    index = known.select("key", "target", "n").mapInPandas(_hashed(known_hashes), "key string, target string, n long, h array<bigint>")
    index = index.select(F.col("key").alias("known"), "target", "n", F.explode("h").alias("h"))
    pairs = asks.join(index, "h").select("key", "known", "target", "n").distinct()
    scored = pairs.mapInPandas(_measured, "key string, target string, n long, distance double")
    best = scored.groupBy("key").agg(F.min(F.struct("distance", (-F.col("n")).alias("less"), "target")).alias("best"))
    return best.select("key", F.col("best.target").alias("predicate"), F.col("best.distance").alias("distance"))


def known_wordings(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key, target, n): wordings of facts with a catalog entry, by majority; all of them, however rare."""
    valid = catalog.select(F.col("predicate").alias("predicate_canonical")).distinct()
    both = F.array_distinct(F.array(measure(F.col("predicate_raw")), F.coalesce(wording(F.col("predicate_raw")), F.lit(""))))
    rows = facts.join(valid, "predicate_canonical", "left_semi").select(F.explode(both).alias("key"), "predicate_canonical")
    votes = rows.where("key <> ''").groupBy("key", "predicate_canonical").agg(F.count(F.lit(1)).alias("n"))
    return (votes.groupBy("key").agg(F.max(F.struct("n", "predicate_canonical")).alias("best"), F.sum("n").alias("total"))
            .where(F.col("best.n") >= MAJORITY * F.col("total")).select("key", F.col("best.predicate_canonical").alias("target"), F.col("best.n").alias("n")))


def map_predicates(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(fact_id, predicate, distance): facts whose predicate_canonical is null or off the catalog.

    predicate is the catalog entry that predicate_raw means, or UNMATCHED; distance is 0 for a known
    wording, null for UNMATCHED. Null or blank wordings are UNMATCHED. Repeated rows come out once each,
    extra columns are ignored, empty tables give empty results; with an empty catalog all is
    UNMATCHED. A wording that a large share of all facts has is joined by broadcast (hot_join).
    """
    spark = facts.sparkSession
    known = known_wordings(facts, catalog)
    listed = catalog.select(F.explode(F.array(*[F.struct(f(F.col(c)).alias("key"), F.col("predicate").alias("target"))
                                                for c in ("label", "predicate") for f in (wording, measure)])).alias("x")).select("x.*").where("key <> ''")
    valid = catalog.select(F.col("predicate").alias("predicate_canonical")).distinct()
    open_facts = facts.join(valid, "predicate_canonical", "left_anti").select("fact_id", measure(F.col("predicate_raw")).alias("key"))
    keys = open_facts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    exact = known.join(listed.select("key").distinct(), "key", "left_anti").unionByName(
        listed.groupBy("key").agg(F.min("target").alias("target")).withColumn("n", F.lit(1_000_000).cast("bigint")))
    met = keys.join(exact.select("key", "target"), "key", "left")
    direct = met.where("target is not null").select("key", "n", F.col("target").alias("predicate"), F.lit(0.0).alias("distance"))
    scratch = Scratch(spark, "p6")
    fuzzy = scratch.keep(met.where("target is null").select("key", "n"))
    found = search_all(fuzzy, scratch.keep(exact.select("key", "target", "n")))
    mapped = direct.unionByName(fuzzy.join(found, "key", "left").withColumn("predicate", F.coalesce("predicate", F.lit(UNMATCHED))))
    return hot_join(open_facts, mapped, ["key"], "n", facts.count()).select("fact_id", "predicate", "distance")
