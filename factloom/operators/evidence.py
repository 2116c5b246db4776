"""Evidence verification: is a quoted passage on the page it claims?

The cascade runs from cheap to dear. Exact occurrences are found by Catalyst; only the rest goes
through Arrow to be compared in normal form (with an index back into the page) and, failing
that, by the best window of tokens under a trigram measure.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

FUZZY_THRESHOLD = 0.92
MIN_FUZZY_TOKENS = 5
CONTEXT = 200

QUOTES = str.maketrans({**dict.fromkeys("‘’‚‛′", "'"), **dict.fromkeys("“”„‟″", '"'), **dict.fromkeys("‐‑‒–—―−", "-")})
WRAP = re.compile(r"(?<=[^\W_])-[ \t]*\r?\n\s*(?=[^\W_])")
TOKEN = re.compile(r"(?:[^\W_]|[$€£₹%])+(?:[.,'’-](?:[^\W_]|[$€£₹%])+)*")
NOT_GRAM = re.compile(r"(?:[^\w$€£₹%]|_)+")


def normal_form(text: str) -> tuple[str, list[int]]:
    """(normal text, source index of each of its characters): compatibility forms, plain quotes and
    dashes, one space for any white space, words rejoined over line ends, no space at the ends."""
    out: list[str] = []
    index: list[int] = []
    skip = {i for m in WRAP.finditer(text) for i in range(m.start(), m.end())}
    for i, c in enumerate(text):
        if i in skip:
            continue
        for x in (c if c.isascii() else unicodedata.normalize("NFKC", c)).translate(QUOTES):
            if x.isspace() or x == "﻿":
                if out and out[-1] != " ":
                    out.append(" ")
                    index.append(i)
            else:
                out.append(x)
                index.append(i)
    if out and out[-1] == " ":
        out.pop()
        index.pop()
    return "".join(out), index


_normal_page = lru_cache(maxsize=8)(normal_form)  # claims of one page come together


def trigrams(text: str) -> Counter:
    padded = f"  {NOT_GRAM.sub(' ', text.lower()).strip()}  "
    return Counter(padded[i:i + 3] for i in range(len(padded) - 2))


def dice(a: Counter, b: Counter) -> float:
    return 2 * (a & b).total() / (a.total() + b.total())


@lru_cache(maxsize=8)
def _page(page: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(normalized text, its trigrams as integers, source starts, source ends, starts, ends of its tokens)."""
    found = [(m.span(), token) for m in TOKEN.finditer(page) if (token := NOT_GRAM.sub(" ", m.group().lower()).strip())]
    text = " ".join(t for _, t in found)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    grams = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:] if len(code) > 2 else np.empty(0, np.int64)
    sizes = np.array([len(t) for _, t in found], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else sizes
    spans = np.array([s for s, _ in found], np.int64).reshape(-1, 2)
    return text, grams, spans[:, 0], spans[:, 1], starts, starts + sizes


def best_window(quote: str, page: str) -> tuple[float, int, int]:
    """(score, start, end) of the best run of tokens about as long as the quote; smaller and earlier runs win ties.

    A run is a piece of the page's normalized text. It cannot share more trigrams than it has of
    the quote's kinds, and the four at its edges; runs are measured in order of that bound until
    the bound falls below the best score.
    """
    n = len(TOKEN.findall(quote))
    if n < MIN_FUZZY_TOKENS:
        return 0.0, 0, 0
    want = trigrams(quote)
    total = want.total()
    text, grams, source_start, source_end, starts, ends = _page(page)
    kinds = np.array([(ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2]) for g in want], np.int64)
    known = np.concatenate([[0], np.cumsum(np.isin(grams, kinds)), [0, 0]])
    known[-2:] = known[-3]
    best = (0.0, 0, 0, 0)
    for size in range(max(MIN_FUZZY_TOKENS, n - 1), n + 2):
        if len(starts) < size:
            break
        a, b = starts[:len(starts) - size + 1], ends[size - 1:]
        bound = 2 * (known[np.maximum(b - 2, a)] - known[a] + 4) / (total + b - a + 2)
        for i in np.argsort(-bound, kind="stable").tolist():
            if bound[i] < best[0] or not bound[i]:
                break
            score = dice(want, trigrams(text[a[i]:b[i]]))
            if score > best[0] or (score == best[0] and best[3] == size and i < best[1]):
                best = (score, i, size, size)
    if not best[2]:
        return 0.0, 0, 0
    return best[0], int(source_start[best[1]]), int(source_end[best[1] + best[2] - 1])


def verify(quote: str | None, page: str | None, threshold: float = FUZZY_THRESHOLD) -> tuple[str, float, int | None, int | None]:
    """(method or reason, score, start, end); offsets count characters of the page from 0."""
    if page is None:
        return "PAGE_NOT_FOUND", 0.0, None, None
    quote = quote or ""
    at = page.find(quote) if quote else -1
    if at >= 0:
        return "EXACT", 1.0, at, at + len(quote)
    want, _ = normal_form(quote)
    have, index = _normal_page(page)
    at = have.find(want) if want else -1
    if at >= 0:
        return "NORMALIZED", 1.0, index[at], index[at + len(want) - 1] + 1
    score, a, b = best_window(quote, page)
    if score >= threshold:
        return "FUZZY", score, a, b
    return "NO_RELIABLE_MATCH", score, None, None


def verify_claims(claims: DataFrame, pages: DataFrame, threshold: float = FUZZY_THRESHOLD, context: int = CONTEXT) -> DataFrame:
    """Claims (claim_id, page_key, quote) against pages (page_key, text).

    Returns claim_id, method, score, start_char, end_char (from 0), matched_text, context_before,
    context_after. Claims without their page come out as PAGE_NOT_FOUND; null and empty quotes match
    nothing. Exact matches never leave the JVM.
    """
    staged = _met(claims, pages)
    exact = _exact(staged)
    missing = staged.where("page is null").select("claim_id", F.lit("PAGE_NOT_FOUND").alias("method"), F.lit(0.0).alias("score"),
                                                  F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"), "page")

    def dear(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [verify(q, p, threshold) for q, p in zip(frame["quote"], frame["page"])]
            out = pd.DataFrame(got, columns=["method", "score", "start_char", "end_char"])
            out.insert(0, "claim_id", frame["claim_id"].to_numpy())
            out["page"] = frame["page"].to_numpy()
            yield out.astype({"start_char": "Int32", "end_char": "Int32"})

    kind = claims.schema["claim_id"].dataType.simpleString()
    # Few bytes but much work for each row: spread over all shuffle partitions, which AQE leaves alone when their number is given.
    parts = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = staged.where("at = 0 and page is not null").select("claim_id", "page_key", "quote", "page").repartition(
        parts, "page_key", F.pmod(F.xxhash64("claim_id"), F.lit(4))).sortWithinPartitions("page_key").drop("page_key").mapInPandas(
        dear, f"claim_id {kind}, method string, score double, start_char int, end_char int, page string")
    return _spans(exact.unionByName(missing).unionByName(rest), context)


def exact_claims(claims: DataFrame, pages: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The exact matches of verify_claims alone; all of it stays in the JVM."""
    return _spans(_exact(_met(claims, pages)), context)


def _met(claims: DataFrame, pages: DataFrame) -> DataFrame:
    joined = claims.select("claim_id", "page_key", "quote").join(pages.select("page_key", F.col("text").alias("page")), "page_key", "left")
    at = F.when(F.length("quote") > 0, F.instr("page", F.col("quote")))
    return joined.withColumn("at", F.coalesce(at, F.lit(0)))


def _exact(staged: DataFrame) -> DataFrame:
    return staged.where("at > 0").select("claim_id", F.lit("EXACT").alias("method"), F.lit(1.0).alias("score"),
                                         (F.col("at") - 1).alias("start_char"), (F.col("at") - 1 + F.length("quote")).alias("end_char"), "page")


def _spans(every: DataFrame, context: int) -> DataFrame:
    begin = F.greatest(F.lit(0), F.col("start_char") - context)
    return every.select("claim_id", "method", "score", "start_char", "end_char",
                        F.substr("page", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")).alias("matched_text"),
                        F.substr("page", begin + 1, F.col("start_char") - begin).alias("context_before"),
                        F.substr("page", F.col("end_char") + 1, F.lit(context)).alias("context_after"))


def box_lines(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Bounding boxes, line by line, of the text items a span [start_char, end_char) of a page touches."""
    met = spans.join(items, "page_key").where("item_end > start_char and item_start < end_char")
    return met.groupBy("span_id", "line_number").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"))
