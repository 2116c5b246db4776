"""Nearest known names by shared trigrams: blocks of names against blocks of known names, only the best of each name leave a block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.functions.text import name_words
from factloom.session import Scratch

#: Rows of a block, about; every block of names meets every block of known names.
NAMES_BLOCK, KNOWN_BLOCK = 65_536, 250_000
#: Blocks of names are not made smaller than this for the sake of more tasks.
LEAST_BLOCK = 2_048
#: Rows are compared one by one where fewer than this share of a block can be similar.
SPARSE = 32
#: Similarities are told apart by so many steps (six decimals).
STEPS = 1_000_000


def trigram_sets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, trigram) of each distinct trigram of each text of words, in order; as ``word_trigrams``."""
    padded = ["".join(f"  {w} " for w in text.split(" ") if w) for text in words]
    c = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
    x, y, z = c[:-2], c[1:-1], c[2:]
    inside = (row[:-2] == row[2:]) & ((y != 32) | ((x == 32) & (z != 32))) if len(c) > 2 else np.zeros(0, bool)
    row, code = row[:-2][inside], ((x << 42) | (y << 21) | z)[inside]  # code points have 21 bits
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def steps(shared: np.ndarray, union: np.ndarray) -> np.ndarray:
    """shared / union to six decimals, halves up, in whole steps."""
    return (2 * STEPS * shared + union) // (2 * union)


class Known:
    """Known names of one type in order of preference: trigrams of each, rows of each trigram."""

    def __init__(self, words: list[str], keys: np.ndarray):
        self.keys = keys
        row, code = trigram_sets(words)
        self.vocabulary, gram = np.unique(code, return_inverse=True)
        self.sizes = np.bincount(row, minlength=len(words))
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.grams = gram.astype(np.int32)
        self.df = np.bincount(gram, minlength=len(self.vocabulary))
        self.rows = row[np.argsort(gram, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(self.df)])
        self.mark = np.zeros(len(self.vocabulary), np.int64)
        self.needed: tuple = (None, None)  # trigrams each row has to share with a set of one size

    def shared(self, at: np.ndarray) -> np.ndarray:
        """Marked trigrams of the rows ``at``, none of which is without trigrams."""
        n = self.sizes[at]
        ends = np.cumsum(n)
        each = np.repeat(self.start[at] - ends + n, n) + np.arange(ends[-1])
        return np.add.reduceat(self.mark[self.grams[each]], ends - n)

    def postings(self, grams: np.ndarray) -> np.ndarray:
        return np.concatenate([self.rows[self.first[g]:self.first[g + 1]] for g in grams])

    def best(self, at: np.ndarray, score: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each key the best row, of these the ``limit`` best; earlier rows first in ties."""
        take = 4 * limit
        while True:
            some = np.arange(len(at))
            if take < len(at):  # distinct numbers: higher scores first, then earlier rows
                some = np.argpartition(at - score * len(self.keys), take)[:take]
            some = some[np.lexsort((at[some], -score[some]))]
            _, first = np.unique(self.keys[at[some]], return_index=True)
            if len(first) >= limit or len(some) == len(at):
                some = some[np.sort(first)[:limit]]
                return at[some], score[some]
            take *= 4

    def nearest(self, codes: np.ndarray, least: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, steps) of the ``limit`` best keys with similarity of ``least`` steps or more to a set of trigrams.

        A row that reaches ``least`` shares one of the a - ceil(a * least) + 1 rarest of a trigrams. Where these
        have few rows only those rows are compared, else the trigrams of all rows are counted. Exact, no row is lost.
        """
        size, share = len(codes), (least - 0.5) / STEPS
        place = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        grams = place[self.vocabulary[place] == codes]
        grams = grams[np.argsort(self.df[grams], kind="stable")]
        # Trigrams of no known name are the rarest.
        wanted = len(grams) - max(int(np.ceil(size * share - 1e-9)), 1) + 1
        if wanted <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.df[grams[:wanted]].sum() * SPARSE < len(self.keys):
            rows = np.unique(self.postings(grams[:wanted]))
            self.mark[grams] = 1
            shared = self.shared(rows)
            self.mark[grams] = 0
        else:
            count = np.bincount(self.postings(grams), minlength=len(self.keys))
            if self.needed[0] != (size, least):  # names come by size
                self.needed = (size, least), np.ceil((self.sizes + size) * (share / (1 + share)) - 1e-6).astype(np.int64)
            rows = np.nonzero(count >= self.needed[1])[0]
            shared = count[rows]
        score = steps(shared, size + self.sizes[rows] - shared)
        good = score >= least
        return self.best(rows[good], score[good], limit)


def _nearest(least: int, limit: int, fields: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(names: pa.Table, known: pa.Table) -> pa.Table:
        if not names.num_rows or not known.num_rows:
            return fields.empty_table()
        known = known.sort_by([("created_at", "ascending"), ("key", "ascending")])
        block = Known(known.column("words").to_pylist(), np.asarray(known.column("key").combine_chunks().dictionary_encode().indices))
        row, code = trigram_sets(names.column("words").to_pylist())
        sizes = np.bincount(row, minlength=names.num_rows)
        sets = np.split(code, np.cumsum(sizes)[:-1])
        of, at, score = [], [], []
        if len(block.vocabulary):
            for i in np.argsort(sizes, kind="stable"):
                rows, s = block.nearest(sets[i], least, limit)
                of.append(np.full(len(rows), i))
                at.append(rows)
                score.append(s)
        if not of:
            return fields.empty_table()
        of, at, score = (np.concatenate(x).astype(np.int64) for x in (of, at, score))
        return pa.table([names.column("name").take(of), names.column("type").take(of), known.column("key").take(at), pa.array(score / STEPS)], names=["name", "type", "key", "similarity"]).cast(fields)

    return run


def nearest_names(names: DataFrame, known: DataFrame, least: float, limit: int) -> DataFrame:
    """(name, type, key, similarity): candidates for the ``limit`` best keys of each name, all of these among them.

    names (name, type), known (key, other, type, created_at): of keys equally similar those created first,
    then the lower ones, are the better. Similarity is that of the key's most similar name, six decimals, ``least`` > 0 or more. Pairs never
    leave their task: a block hands on at most ``limit`` keys of a name.
    """
    spark = names.sparkSession
    scratch = Scratch(spark, "names")
    a, n = scratch.keep_counted(names.where("name is not null and type is not null").select("name", "type").distinct().withColumn("words", name_words(F.col("name"))))
    b, m = scratch.keep_counted(known.where("other is not null and type is not null and key is not null").select("key", "type", "created_at", name_words(F.col("other")).alias("words")).distinct())
    right = -(-m // KNOWN_BLOCK) or 1
    spread = -(-2 * spark.sparkContext.defaultParallelism // right)
    left = max(-(-n // NAMES_BLOCK), min(-(-n // LEAST_BLOCK), spread)) or 1

    def every(blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    by = ["type", "left", "right"]
    tasks = 4 * left * right
    a = a.withColumn("left", F.pmod(F.xxhash64("name"), F.lit(left)).cast("int")).withColumn("right", every(right)).repartition(tasks, *by)
    b = b.withColumn("right", F.pmod(F.xxhash64("key", "words"), F.lit(right)).cast("int")).withColumn("left", every(left)).repartition(tasks, *by)
    kinds = dict(b.dtypes)
    text = f"name string, type {kinds['type']}, key {kinds['key']}, similarity double"
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(spark.createDataFrame([], text).schema)
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(_nearest(round(least * STEPS), limit, fields), text)
