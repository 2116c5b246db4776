"""Filling fixed-capacity containers with texts (problem 8).

Texts are measured in tokens of a public tokenizer. Dynamic programming over the histogram of lengths
chooses the length buckets of least padding; token-budget batches then form inside each bucket, from
the longest bucket to the shortest. A batch that its bucket cannot fill - two texts just above half
the capacity never share one - stays open and is topped up with texts of shorter buckets before
those form batches of their own. The histogram (one count for each length up to the capacity,
whatever the data) is all that planning needs; rows find their container by their rank among rows of
the same length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.session import Scratch

CAPACITY = 4096
BUCKETS = 32
SLACK = CAPACITY // 32  # a batch with no more space than this left is full: it is never topped up
PART = 250_000  # rows of one length that are ranked in one part, about
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenization pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(data: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("factloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _kept_encoding(key: int, data: bytes):
    """The tokenizer of a broadcast, built once in each worker process."""
    return encoding(data)


def _counter(cast, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import containers

        encode = containers._kept_encoding(key, cast.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every text that has tokens."""
    with open(tokenizer, "rb") as f:  # about a megabyte, the same for any input
        data = f.read()
    cast = documents.sparkSession.sparkContext.broadcast(data)
    texts = documents.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text")
    return texts.mapInArrow(_counter(cast, zlib.crc32(data)), "doc_id long, n_tokens long")


def boundaries(counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Bucket boundaries (upper ends) of least total padding; counts[i] texts have length i."""
    lengths = np.nonzero(counts)[0]
    lengths = lengths[lengths > 0]
    n = len(lengths)
    if n <= buckets:
        return lengths.tolist()
    c = np.concatenate([[0], np.cumsum(counts[lengths])]).astype(float)
    s = np.concatenate([[0], np.cumsum(counts[lengths] * lengths)]).astype(float)
    upper = lengths.astype(float)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = np.zeros((buckets, n + 1), np.int32)
    for k in range(buckets):
        after = np.full(n + 1, np.inf)
        for lo in range(1, n + 1, 256):
            j = np.arange(lo, min(lo + 256, n + 1))
            # texts i+1 .. j in one bucket, padded to the longest of them
            cost = best[None, :] + upper[j - 1][:, None] * (c[j][:, None] - c[None, :]) - (s[j][:, None] - s[None, :])
            cost[np.arange(n + 1)[None, :] >= j[:, None]] = np.inf
            pick = cost.argmin(1)
            after[j], back[k, j] = cost[np.arange(len(j)), pick], pick
        best = after
    out, j = [], n
    for k in range(buckets - 1, -1, -1):
        out.append(int(lengths[j - 1]))
        j = int(back[k, j])
    return sorted(out)


class _Pool:
    """Ranges of equal containers by the space left in them."""

    def __init__(self, capacity: int):
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.some = np.zeros(capacity + 1, bool)

    def put(self, space: int, begin: int, n: int) -> None:
        if n > 0 and space > 0:
            self.ranges[space].append((begin, n))
            self.some[space] = True

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(space, begin, n) of the range with the least space that takes a text of this length."""
        space = least + int(self.some[least:].argmax()) if least < len(self.some) else least
        if space >= len(self.some) or not self.some[space]:
            return None
        begin, n = self.ranges[space].pop()
        self.some[space] = bool(self.ranges[space])
        return space, begin, n

    def drain(self) -> Iterator[tuple[int, int, int]]:
        for space in np.nonzero(self.some)[0].tolist():
            for begin, n in self.ranges[space]:
                yield space, begin, n
        self.__init__(len(self.some) - 1)


@dataclass
class Plan:
    """Runs of texts, by first text: run r puts per[r] texts each into the containers from start[r] on."""

    first: np.ndarray
    per: np.ndarray
    start: np.ndarray
    topping: np.ndarray
    containers: int


def plan(counts: np.ndarray, ends: list[int], capacity: int = CAPACITY, slack: int = SLACK) -> Plan:
    """Containers of the texts of a histogram whose buckets end at ``ends``.

    Texts are numbered from the longest length to the shortest. In each bucket the open batches of
    longer buckets are topped up first (best fit, longest texts first), then the texts left form
    batches of their own, by best fit within the bucket. A batch with more than ``slack`` left
    is open for shorter buckets.
    """
    runs: list[tuple[int, int, int, bool]] = []
    number = np.concatenate([np.cumsum(counts[::-1])[::-1][1:], [0]])  # number of the next text of each length
    left = counts.astype(np.int64).copy()
    open_ = _Pool(capacity)
    used = 0

    def fill(length: int, space: int, begin: int, n: int, pool: _Pool, topping: bool) -> None:
        """Texts of one length into n containers with equal space; containers go back to the pool."""
        fit = space // length
        full = min(n, int(left[length]) // fit)
        rest = min(fit, int(left[length]) - full * fit) if full < n else 0
        for per, at, many in ((fit, begin, full), (rest, begin + full, 1 if rest else 0)):
            if many:
                runs.append((int(number[length]), per, at, topping))
                number[length] += per * many
                left[length] -= per * many
                pool.put(space - per * length, at, many)
        pool.put(space, begin + full + (rest > 0), n - full - (rest > 0))

    lows = [0, *ends[:-1]]
    for low, end in sorted(zip(lows, ends), reverse=True):
        lengths = [x for x in range(end, low, -1) if counts[x]]
        for length in lengths:
            while left[length] and (got := open_.take(length)):
                fill(length, *got, open_, True)
        own = _Pool(capacity)
        for length in lengths:
            while left[length]:
                got = own.take(length)
                if got is None:
                    n = -(-int(left[length]) // (capacity // length))
                    got = capacity, used, n
                    used += n
                fill(length, *got, own, False)
        for space, begin, n in own.drain():
            if space > slack:
                open_.put(space, begin, n)
    runs.sort()
    columns = list(zip(*runs)) if runs else [(), (), (), ()]
    return Plan(np.array(columns[0], np.int64), np.array(columns[1], np.int64), np.array(columns[2], np.int64), np.array(columns[3], bool), used)


def _place(cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, ends, made = cast.value
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            item = base[n] + rank
            r = np.searchsorted(made.first, item, side="right") - 1
            container = made.start[r] + (item - made.first[r]) // made.per[r]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n),
                                              pa.array(ends[np.searchsorted(ends, n)].astype(np.int32)), pa.array(container), pa.array(made.topping[r])],
                                             names=["doc_id", "piece", "start_token", "n_tokens", "bucket", "container_id", "topping"])

    return run


def fill(documents: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, bucket, container_id, topping): every text in a container.

    A text of at most ``capacity`` tokens is one piece; a longer one is cut into full pieces and its
    rest, each in one container. No container holds more than ``capacity`` tokens. All pieces of a
    container without ``topping`` are of one bucket (``bucket`` is its greatest length); the others
    of the container top it up. Null and empty texts have no tokens and no row; repeated rows are
    placed once each; extra columns are ignored; no documents give an empty result. One length may
    belong to any share of the rows: it is ranked in parts of about PART rows, told by the histogram.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "p8")
    counted = token_counts(documents, tokenizer).where("n_tokens > 0")
    pieces = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / capacity).cast("bigint")))
    cut = scratch.keep(counted.select("doc_id", "n_tokens", pieces.alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start_token"),
        F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[r["n_tokens"]] = r["n"]
    ends = boundaries(counts, buckets) or [capacity]
    longer = np.concatenate([np.cumsum(counts[::-1])[::-1][1:], [0]])  # texts longer than each length
    cast = spark.sparkContext.broadcast((longer, np.array(ends), plan(counts, ends, capacity, capacity * SLACK // CAPACITY)))
    split = [(i, -(-int(n) // PART)) for i, n in enumerate(counts) if n > PART]
    salted = cut.withColumn("salt", F.lit(0))
    if split:  # at most ``capacity`` rows
        parts = F.broadcast(spark.createDataFrame(split, "n_tokens bigint, parts int"))
        salted = cut.join(parts, "n_tokens", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    mine = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("r", F.row_number().over(mine))
    rank = (F.col("r") - 1).cast("bigint")
    if split:
        before = salted.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "skip", F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        ranked = ranked.join(before.select("n_tokens", "salt", "skip"), ["n_tokens", "salt"])
        rank = rank + F.coalesce("skip", F.lit(0))
    placed = ranked.select("doc_id", "piece", "start_token", "n_tokens", rank.alias("rank"))
    return placed.mapInArrow(_place(cast), "doc_id long, piece long, start_token long, n_tokens long, bucket int, container_id long, topping boolean")
