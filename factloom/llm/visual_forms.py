"""Visually identical text with different characters (problem 3).

Words with characters beyond ASCII are looked up in vocabulary tries by a weighted edit automaton:
look-alikes and ignorable characters cost nothing, edits that can be seen cost more. One letter may
look like several (a bar like I and like l); then the vocabulary decides: of the spellings
that cost least the most frequent one is canonical. Words that no spelling matches are normalized by
the table of look-alikes.

The vocabulary is all of the corpus, however large: words meet the words they may read like by their
skeletons (all letters of one look made one), and each task builds tries of its own part.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.lookalikes import AMBIGUOUS, LOOKS_LIKE, SKELETON, unmask
from factloom.session import Scratch

BUDGET = 0.0  # cost of edits that still counts as looking the same
VISIBLE = 1.0  # cost of an edit that can be seen: a character more, less or other
CASE = 0.5  # cost of a capital for a small letter
TRIE = 20_000  # words of a trie, about
TURN = 500_000  # words whose form the table does not give, broadcast at once; more are applied in turns
MASKED = r"[^\x00-\x7F]"
SPACES = "[" + " " + "".join(c for c, x in LOOKS_LIKE.items() if x == " ") + "]"
SPACE = re.compile(f"({SPACES})")


class Trie:
    """Vocabulary trie; a node maps a character to a node, "" to the frequency of the word that ends there."""

    def __init__(self, words: list[tuple[str, int]]):
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = node.get("", 0) + n

    def match(self, token: str, budget: float = BUDGET) -> str | None:
        """The word of least cost within the budget; of several the most frequent, then the smallest."""
        best: tuple[float, int, str] | None = None
        queue: list[tuple[float, int, str, int]] = [(0.0, 0, "", 0)]
        nodes = [self.root]
        seen: set[tuple[int, int]] = set()
        while queue:
            cost, i, word, at = heapq.heappop(queue)
            node = nodes[at]
            if best is not None and cost > best[0]:
                break
            if (id(node), i) in seen:
                continue
            seen.add((id(node), i))
            if i == len(token) and "" in node and (best is None or (cost, -node[""], word) < best):
                best = cost, -node[""], word
            for step, text, price in self._moves(token, i, node, budget - cost):
                to = node
                for c in text:
                    to = to.get(c) if to is not None else None
                if to is not None:
                    nodes.append(to)
                    heapq.heappush(queue, (cost + price, i + step, word + text, len(nodes) - 1))
        return best[2] if best else None

    @staticmethod
    def _moves(token: str, i: int, node: dict, budget: float) -> Iterator[tuple[int, str, float]]:
        """(characters read, characters of the word, cost) of the edits that the budget allows."""
        if i < len(token):
            c = token[i]
            yield 1, c, 0.0
            alike = LOOKS_LIKE.get(c)
            if alike is not None:
                yield 1, alike, 0.0
            for other in AMBIGUOUS.get(c, ()):
                yield 1, other, 0.0
            read, accents = 1, ""
            while i + read < len(token):  # accents that follow belong to the letter, ignorable characters between them do not count
                d = token[i + read]
                if unicodedata.combining(d):
                    accents += d
                elif LOOKS_LIKE.get(d) != "":
                    break
                read += 1
            if accents:
                for base in {c if alike is None else alike, c, *AMBIGUOUS.get(c, ())}:
                    yield read, unicodedata.normalize("NFC", base + accents), 0.0
            if budget >= CASE and c.swapcase() != c:
                yield 1, c.swapcase(), CASE
            if budget >= VISIBLE:
                yield 1, "", VISIBLE
        if budget >= VISIBLE:
            for other in node:
                if other:
                    yield 0, other, VISIBLE
                    if i < len(token):
                        yield 1, other, VISIBLE


def canonical(text: str, exceptions: dict[str, str], known: dict[str, str] | None = None, finish: bool = True) -> str:
    """The text's consistent form: the exceptions' spelling of a word, else (``finish``) that of the table."""
    known = {} if known is None else known
    out = []
    for piece in SPACE.split(text):
        if not piece.isascii():
            got = known.get(piece)
            if got is None:
                got = exceptions.get(piece)
                if got is None:
                    got = unmask(piece) if finish else piece
                known[piece] = got
            piece = got
        out.append(piece)
    return "".join(out)


def _rewrite(cast, finish: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exceptions, known = cast.value, {}
        for batch in batches:
            if len(known) > 200_000:
                known.clear()
            forms = [canonical(t, exceptions, known, finish) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(forms, pa.string())], names=batch.schema.names)

    return run


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words beyond ASCII with their skeletons; one that is its own form by the table is vocabulary, too."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        plain = [unmask(w) for w in words]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p.translate(SKELETON) for p in plain], pa.string()), batch.column(0), batch.column(1), pa.array([p == w for p, w in zip(plain, words)])],
            names=["key", "word", "n", "spelling"])


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their keys: a trie of the spellings of some keys, and the words of those keys looked up in it."""

    def look(rows: list[tuple]) -> tuple[list[str], list[str]]:
        trie = Trie([(w, n) for _, w, n, spelling in rows if spelling])
        out: tuple[list[str], list[str]] = [], []
        for _, w, _, _ in rows:
            if not w.isascii():
                form = trie.match(w)
                if form is not None and form != unmask(w):
                    out[0].append(w)
                    out[1].append(form)
        return out

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        if len(held) >= TRIE:
            cut = len(held) - 1
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in look(held[:cut])], names=["word", "form"])
                held = held[cut:]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in look(held)], names=["word", "form"])


def spellings(texts: DataFrame) -> DataFrame:
    """(word, form) of every word of ``text`` whose canonical spelling the table of look-alikes does not give."""
    words = texts.select(F.explode(F.split("text", SPACES)).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    odd = words.where(F.col("word").rlike(MASKED)).mapInArrow(_skeletons, "key string, word string, n long, spelling boolean")
    plain = {c: x for c, x in SKELETON.items() if c < 128}
    skeleton = F.translate("word", "".join(map(chr, plain)), "".join(plain.values()))
    ascii_ = words.where(~F.col("word").rlike(MASKED)).select(skeleton.alias("key"), "word", "n", F.lit(True).alias("spelling"))
    met = ascii_.join(odd.select("key").distinct(), "key", "left_semi").unionByName(odd)
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(_look_up, "word string, form string")


def canonical_texts(rows: DataFrame) -> DataFrame:
    """Adds ``canonical`` to rows with a column ``text``.

    Null texts stay null, empty ones empty. Only texts with characters beyond ASCII pass through Python: plain
    ones are their own canonical form. Texts of any length are handled whole. Forms that the
    table does not give are broadcast; if there are more than TURN, in turns.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "p3")
    found = scratch.keep(spellings(rows.where(F.col("text").isNotNull()).select("text")))
    turns = max(1, -(-found.count() // TURN))
    masked = F.coalesce(F.col("text").rlike(MASKED), F.lit(False))
    odd = rows.where(masked).withColumn("canonical", F.col("text"))
    for k in range(turns):
        mine = found if turns == 1 else found.where(F.pmod(F.xxhash64("word"), F.lit(turns)) == k)
        cast = spark.sparkContext.broadcast({r["word"]: r["form"] for r in mine.collect()})
        odd = odd.mapInArrow(_rewrite(cast, k == turns - 1), odd.schema)
    return rows.where(~masked).withColumn("canonical", F.col("text")).unionByName(odd)


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def look_alike_pairs(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """p3_found (field, left_id, right_id): rows of one document whose stored texts differ but look the same.

    Of evidence rows under one id the one ingested last counts (then the greatest text). Rows without
    document, id or text pair with nothing; equal stored texts are no pair. At least one text of a
    pair is not in its canonical form: such rows are joined with all rows of their document and
    form - two plain rows are never compared. Empty tables give an empty result.
    """
    # Both tables pass the same operator; ids of several deliveries meet after the texts are hashed.
    quotes = evidence.select(F.lit("quote").alias("field"), F.col("evidence_id").alias("id"), F.col("document_id").alias("doc"),
                             F.coalesce("ingested_at", F.lit(0).cast("timestamp")).alias("at"), F.col("quote").alias("text"))
    subjects = facts.select(F.lit("subject_raw").alias("field"), F.col("fact_id").alias("id"), F.col("document_id").alias("doc"),
                            F.lit(0).cast("timestamp").alias("at"), F.col("subject_raw").alias("text"))
    rows = quotes.unionByName(subjects).where("id is not null and doc is not null and text is not null")
    formed = canonical_texts(rows)
    hashed = formed.select("field", "id", F.struct("at", _hash(1, "text").alias("t1"), _hash(2, "field", "doc", "canonical").alias("c1"),
                                                   _hash(3, "field", "doc", "canonical").alias("c2"), (F.col("text") != F.col("canonical")).alias("odd")).alias("x"))
    single = hashed.where("field = 'subject_raw'")
    latest = hashed.where("field = 'quote'").groupBy("field", "id").agg(F.max("x").alias("x"))
    every = latest.unionByName(single).select("field", "id", "x.t1", "x.c1", "x.c2", "x.odd")
    odd = every.where("odd").select(F.col("field").alias("f"), F.col("id").alias("a"), F.col("t1").alias("ta"), "c1", "c2")
    met = odd.join(every, ["c1", "c2"]).where("f = field and ta <> t1 and (not odd or a < id)")
    return met.select("field", F.least("a", "id").alias("left_id"), F.greatest("a", "id").alias("right_id")).distinct()
