"""Reading level of each document (problem 10).

Every word gets an acquisition grade from the labelled texts: the level by which half of its use,
level for level, has occurred. A document is described by quantiles of the grades of its known
words; the quantiles are calibrated to the readers' levels on the labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.lookalikes import unmask
from factloom.session import Scratch

LEVELS = 5
BROADCAST_LABELS = 500_000  # labelled documents whose ids are broadcast; more meet their texts in a shuffle
FLUSH = 1 << 20  # letter grams counted at once
MIN_DOCS = 4  # labelled documents a word must occur in to be known
MIN_WORDS = 80  # words (at white space) of a text that gets a level
QUANTILES = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])

WORD = re.compile(r"[a-z]{2,}(?:'[a-z]+)?")

#: Classes of bytes of a lower-case text for the character model: letters, four of bytes beyond ASCII, anything else.
_CLASS = np.array([b - 96 if 97 <= b <= 122 else 27 + (b & 3) if b >= 128 else 0 for b in range(256)], np.int32)
GRAMS = 1 << 15


def plain(text: str) -> str:
    return unmask(text).lower()


def letter_grams(text: str) -> np.ndarray:
    """Codes of all runs of three letters (or the gap between words)."""
    return plain_grams(plain(text))


def plain_grams(text: str) -> np.ndarray:
    """As ``letter_grams``, of a text that is plain already."""
    c = _CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    c = c[(c > 0) | np.concatenate([[True], c[:-1] > 0])] if len(c) else c
    return (c[:-2] << 10) + (c[1:-1] << 5) + c[2:]


def language(column: str = "lang"):
    """A language code in whatever way it is written, by its first two letters; null if there is none."""
    code = F.lower(F.regexp_extract(F.trim(column), r"^(\p{L}{2})", 1))
    return F.when(code != "", code)


@dataclass
class Language:
    """Character model: log frequencies of three letters for each language seen, English first."""

    logs: np.ndarray
    floor: float  # least mean of an English text

    def is_english(self, text: str) -> bool:
        """Of a plain text: English is likelier than any other language seen, and no less likely than in English texts."""
        g = plain_grams(text)
        if not len(g):
            return False
        means = self.logs[:, g].mean(1)
        return bool(means[0] >= self.floor and means[0] >= means.max())

    @staticmethod
    def of(counts: dict[str, np.ndarray]) -> Language | None:
        """From the counts of each language; None without English."""
        if "en" not in counts:
            return None
        rows = np.array([counts["en"], *[c for k, c in sorted(counts.items()) if k != "en"]]) + 0.5
        return Language(np.log(rows / rows.sum(1, keepdims=True)).astype(np.float32), -np.inf)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, np.ndarray] = {}
        open_: dict[str, list[np.ndarray]] = {}
        held = 0

        def flush() -> None:
            for code, parts in open_.items():
                found[code] = found.get(code, 0) + np.bincount(np.concatenate(parts), minlength=GRAMS)
            open_.clear()

        for text, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            open_.setdefault(code, []).append(g := letter_grams(text))
            held += len(g)
            if held > FLUSH:
                flush()
                held = 0
        flush()
        for code, n in found.items():
            some = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([code] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["code", "gram", "n"])


def _english_means(cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = cast.value.logs
        for batch in batches:
            means = [logs[:, g].mean(1) for t in batch.column(0).to_pylist() if len(g := letter_grams(t))]
            yield pa.RecordBatch.from_arrays([pa.array([float(m[0]) for m in means if m[0] >= m.max()], pa.float64())], names=["mean"])

    return run


def learn_language(documents: DataFrame) -> Language | None:
    """The character model of all documents whose language is given.

    Labels may be wrong now and then and codes differ: classes go by their first two letters. The floor lies
    three times as far below the middle of the English texts as their lowest hundredth; both are taken from
    the means of all English texts to four decimals, so what is sorted is bounded by these decimals.
    """
    if "lang" not in documents.columns:
        return None
    told = documents.where(F.col("text").isNotNull() & language().isNotNull() & (F.length("text") >= 2 * MIN_WORDS - 1)).select("text", language().alias("code"))
    counts: dict[str, np.ndarray] = {}
    for r in told.mapInArrow(_letters, "code string, gram int, n long").groupBy("code", "gram").agg(F.sum("n").alias("n")).collect():  # GRAMS rows a code
        counts.setdefault(r["code"], np.zeros(GRAMS))[r["gram"]] = r["n"]
    model = Language.of(counts)
    if model is not None:
        cast = documents.sparkSession.sparkContext.broadcast(model)
        means = told.where("code = 'en'").select("text").mapInArrow(_english_means(cast), "mean double").groupBy(F.round("mean", 4).alias("mean")).agg(F.count(F.lit(1)).alias("n"))
        low, middle = means.agg(F.percentile("mean", F.lit(0.01), F.col("n")), F.percentile("mean", F.lit(0.5), F.col("n"))).first()
        if low is not None:
            model.floor = middle - 3 * (middle - low)
    return model


def _clean(counts: Counter) -> Counter:
    out: Counter = Counter()
    for w, n in counts.items():
        if w.isalpha() and w.isascii():
            out[w] += n
        else:
            m = WORD.fullmatch(w.strip(".,;:!?()\"'“”‘’-–•*"))
            if m:
                out[m.group()] += n
    return out


@dataclass
class Model:
    grades: dict[str, tuple[float, float]]  # word -> (grade, weight)
    language: Language | None
    coefficients: np.ndarray
    cuts: np.ndarray

    def features(self, counts: Counter) -> np.ndarray | None:
        return features(self.grades, counts)

    def level(self, counts: Counter) -> int:
        x = self.features(counts)
        if x is None:
            return int(np.searchsorted(self.cuts, self.coefficients[-1]) + 1)
        return int(np.searchsorted(self.cuts, float(x @ self.coefficients)) + 1)


def features(grades: dict[str, tuple[float, float]], counts: Counter) -> np.ndarray | None:
    """Weighted quantiles of the grades of the known words, their mean and a constant."""
    g, w = [], []
    for word, n in counts.items():
        known = grades.get(word)
        if known:
            g.append(known[0])
            w.append(known[1] * n)
    if not g:
        return None
    g, w = np.array(g), np.array(w)
    order = np.argsort(g)
    g, w = g[order], w[order]
    mid = (np.cumsum(w) - w / 2) / w.sum()
    q = np.interp(QUANTILES, mid, g)
    return np.concatenate([q, [np.average(g, weights=w), 1.0]])


def grade_table(rows: list[tuple[str, list[float], int]], totals: np.ndarray) -> dict[str, tuple[float, float]]:
    """(word, uses by level, documents) -> grade and weight.

    Uses are taken for each level relative to all words of that level; the grade is where their
    cumulated share passes one half. The weight is how far the shares are from even: words that
    every level uses alike tell nothing.
    """
    out = {}
    floor = totals.sum() / len(totals) * 1e-6
    for word, uses, _ in rows:
        rate = (np.array(uses, float) + 0.2) / (totals + floor + 1)
        share = rate / rate.sum()
        cum = np.cumsum(share)
        below = np.concatenate([[0], cum[:-1]])
        k = int(np.searchsorted(cum, 0.5))
        grade = k + 0.5 + (0.5 - below[k]) / share[k]
        weight = float((share * np.log(share * len(share) + 1e-12)).sum()) / np.log(len(share))
        out[word] = (float(grade), max(weight, 1e-3))
    return out


def ridge(moments: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Ridge from quantiles to the readers' mean level; moments: products of all pairs of features and level, summed over the documents."""
    xx, xy = moments[:-1, :-1], moments[:-1, -1]
    penalty = strength * np.eye(len(xx))
    penalty[-1, -1] = 0
    return np.linalg.solve(xx + penalty, xy)


def counted_quantiles(values: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Quantiles of ascending values that occur n times each, linear between neighbours."""
    last = np.cumsum(n)
    at = q * (last[-1] - 1)
    low = np.floor(at)
    a, b = (values[np.searchsorted(last, np.minimum(k, last[-1] - 1), "right")] for k in (low, low + 1))
    return a + (at - low) * (b - a)


def best_cuts(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The cuts that agree best with the readers; ascending predictions, documents of each by level."""
    cuts = []
    for k in range(1, LEVELS):
        grid = np.unique(np.concatenate([[k + 0.5], counted_quantiles(p, counts.sum(1), np.linspace(0, 1, 400))]))
        above, not_above = counts[:, k:].sum(1), counts[:, :k].sum(1)
        wrong_below = np.concatenate([[0], np.cumsum(above)])
        wrong_above = np.concatenate([np.cumsum(not_above[::-1])[::-1], [0]])
        at = np.searchsorted(p, grid)
        loss = wrong_below[at] + wrong_above[at]
        best = grid[loss == loss.min()]
        cuts.append(float(best[np.abs(best - np.median(best)).argmin()]))
    return np.maximum.accumulate(np.array(cuts))


def _english(model: Language | None, text: str) -> bool:
    """Of a plain text. Without a model of English every text counts as English."""
    return model is None or model.is_english(text)


def _uses(cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_uses(cast.value, batches)

    return run


def _count_uses(model: Language | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of labelled English texts: uses by level (a label between two levels goes to both), documents."""
    for batch in batches:
        table: dict[str, np.ndarray] = {}
        for text, level in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = plain(text)
            if not _english(model, text):
                continue
            low = int(np.floor(level))
            part = level - low
            for w, n in _clean(Counter(text.split())).items():
                row = table.get(w)
                if row is None:
                    row = table[w] = np.zeros(LEVELS + 1)
                row[low - 1] += n * (1 - part)
                if part:
                    row[low] += n * part
                row[LEVELS] += 1
        if table:
            m = np.array(list(table.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(table)), *[pa.array(m[:, i]) for i in range(LEVELS + 1)]],
                                             names=["word", *[f"l{i + 1}" for i in range(LEVELS)], "docs"])


def _describe(cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, model = cast.value
        for batch in batches:
            x, y = [], []
            for text, level in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text := plain(text)).split()
                if len(words) >= MIN_WORDS // 2 and _english(model, text):
                    f = features(grades, _clean(Counter(words)))
                    if f is not None:
                        x.append(f.tolist())
                        y.append(float(level))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64())], names=["x", "y"])

    return run


def _features_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1), batch.column("y").to_numpy(zero_copy_only=False)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            z = np.column_stack(_features_of(batch))
            m = (z.T @ z).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m), dtype=np.int32)), pa.array(m)], names=["at", "v"])


def _placed(cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _features_of(batch)
                target = np.clip(np.round(y), 1, LEVELS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(x @ cast.value * 10_000).astype(np.int64)), pa.array(target)], names=["p", "target"])

    return run


def calibrate(described: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ridge and cuts over all rows (x, y); sums and counts come to the driver, no rows. Predictions count to four decimals."""
    sums = {r["at"]: r["v"] for r in described.mapInArrow(_moments, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    if not sums:
        return None
    beta = ridge(np.array([sums[i] for i in range(len(sums))]).reshape(round(len(sums) ** 0.5), -1))
    placed = described.mapInArrow(_placed(described.sparkSession.sparkContext.broadcast(beta)), "p long, target int")
    rows = placed.groupBy("p", "target").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the decimals of levels
    p, at = np.unique(np.array([r["p"] for r in rows]), return_inverse=True)
    counts = np.zeros((len(p), LEVELS), np.int64)
    counts[at, np.array([r["target"] for r in rows]) - 1] = [r["n"] for r in rows]
    return beta, best_cuts(p / 10_000, counts)


def _predict(cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = cast.value
        for batch in batches:
            keep, levels = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = (text := plain(text)).split()
                if len(words) >= MIN_WORDS and _english(model.language, text):
                    keep.append(i)
                    levels.append(model.level(_clean(Counter(words))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(levels, pa.int32())], names=["doc_id", "reading_level"])

    return run


def consensus(labels: DataFrame) -> DataFrame:
    """(doc_id, level): the mean of the readers' judgements between the lowest and highest level."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").between(1, LEVELS))
    return known.groupBy("doc_id").agg(F.avg("reading_level").alias("level"))


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    spark = documents.sparkSession
    spoken = learn_language(documents)
    scratch = Scratch(spark, "p10")
    levels, n = scratch.keep_counted(consensus(labels))
    graded = scratch.keep(documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(levels) if n <= BROADCAST_LABELS else levels, "doc_id").select("text", "level"))
    scratch.drop(levels)
    columns = [f"l{i + 1}" for i in range(LEVELS)]
    used = scratch.keep(graded.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_uses(spark.sparkContext.broadcast(spoken)), "word string, " + ", ".join(f"{c} double" for c in columns) + ", docs double")
                        .groupBy("word").agg(*[F.sum(c).alias(c) for c in columns], F.sum("docs").alias("docs")))
    totals = np.array([x or 0.0 for x in used.agg(*[F.sum(c) for c in columns]).first()])
    # Grows with the vocabulary of the labelled documents only: a known word stands in MIN_DOCS of them.
    best = used.where(F.col("docs") >= MIN_DOCS).orderBy("word")
    grades = grade_table([(r["word"], [r[c] for c in columns], r["docs"]) for r in best.collect()], totals)
    if not grades:
        return None
    cast = spark.sparkContext.broadcast((grades, spoken))
    described = scratch.keep(graded.mapInArrow(_describe(cast), "x array<double>, y double"))
    fitted = calibrate(described)
    for gone in (graded, used, described):
        scratch.drop(gone)
    return Model(grades, spoken, *fitted) if fitted else None


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """p10_found (doc_id, reading_level): every English document of 80 or more words.

    The language is told by a character model of the documents whose ``lang`` is given, whatever ``lang`` says of
    the document itself; languages never seen are told by how unlike English they are. Where no
    document is said to be English every text counts as such. Null or blank texts and shorter ones
    get no level; repeated rows come out once each; extra columns are ignored. Without a single label
    nothing can be told: the result is empty. A text without any known word gets the level of the
    calibration's constant. Labels outside 1 to 5 and labels of unknown documents do not count.
    """
    model = fit(documents, labels)
    if model is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, reading_level int")
    cast = documents.sparkSession.sparkContext.broadcast(model)
    long_enough = F.length("text") >= 2 * MIN_WORDS - 1
    return documents.where(F.col("text").isNotNull() & long_enough).select("doc_id", "text").mapInArrow(_predict(cast), "doc_id long, reading_level int")
