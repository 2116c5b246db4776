"""Pluggable steps - extraction, embedding, reasoning - with deterministic offline implementations."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MIN_CONFIDENCE = 0.65
MAX_EMBEDDING_TEXT = 8000
RETRIES, BASE_DELAY = 2, 0.25


class FactExtractionProvider(Protocol):
    model: str
    version: str

    def extract(self, text: str) -> list[dict]: ...


class EmbeddingProvider(Protocol):
    model: str
    dimensions: int

    def embed(self, text: str) -> list[float]: ...


class RelationshipReasoningProvider(Protocol):
    model: str

    def reason(self, pair: dict) -> tuple[str, float, str]: ...


class TransientError(RuntimeError):
    """A call that may succeed if repeated."""


def with_retries(call: Callable[[], object], retries: int = RETRIES, delay: float = BASE_DELAY, sleep: Callable[[float], None] = time.sleep) -> object:
    """Repeats transient failures after delay x 2^attempt and a little more; others pass at once."""
    for attempt in range(retries + 1):
        try:
            return call()
        except TransientError:
            if attempt == retries:
                raise
            sleep(delay * 2**attempt + random.random() * delay)


class TemplateExtraction:
    """Facts of sentences like "X had P of V in T" or "for T, X disclosed P of V"."""

    model, version = "templates", "1"
    FORMS = [
        re.compile(r"(?P<subject>[A-Z][^.;\n]{2,80}?) (?:had|reported|meldete) (?P<predicate>[^.;\n]{2,60}?) (?:of|von) (?P<value>[^;\n]{1,40}?) in (?P<time>(?:[QH]\d )?FY\d{4}|\d{4}|\d{1,2} \w+ \d{4})"),
        re.compile(r"[Ff]or (?P<time>(?:[QH]\d )?FY\d{4}|\d{4}), (?P<subject>[A-Z][^.;\n]{2,80}?) disclosed (?P<predicate>[^.;\n]{2,60}?) of (?P<value>[^;\n]{1,40}?)(?=[.;\n]\s|[.;]?$)"),
        re.compile(r"(?P<predicate>[a-z][^.;,\n]{2,60}?) at (?P<subject>[A-Z][^.;\n]{2,80}?) stood at (?P<value>[^;\n]{1,40}?) in (?P<time>(?:[QH]\d )?FY\d{4}|\d{4})"),
    ]

    def extract(self, text: str) -> list[dict]:
        out = []
        for form in self.FORMS:
            for m in form.finditer(text or ""):
                out.append({**{k: v.strip() for k, v in m.groupdict().items()}, "quote": m.group(), "confidence": 0.9, "start": m.start()})
        return sorted(out, key=lambda d: (d["start"], d["predicate"]))


class HashedEmbedding:
    """Signed hashes of character trigrams, normalized to length one."""

    model = "hashed-trigrams"

    def __init__(self, dimensions: int = 768):
        self.dimensions = dimensions

    def embed(self, text: str) -> list[float]:
        clean = (text or "").strip()
        if not clean or len(clean) > MAX_EMBEDDING_TEXT:
            raise ValueError(f"text must have 1 to {MAX_EMBEDDING_TEXT} characters")
        v = np.zeros(self.dimensions)
        padded = f"  {' '.join(clean.lower().split())}  "
        for i in range(len(padded) - 2):
            h = int.from_bytes(hashlib.blake2b(padded[i:i + 3].encode(), digest_size=8).digest(), "little")
            v[h % self.dimensions] += 1 if h >> 63 else -1
        n = math.sqrt(float(v @ v)) or 1.0
        return (v / n).tolist()


class OfflineReasoner:
    """The published decision rules: what differs first explains the pair, then the values decide."""

    model = "rules"
    EXPLAINS = ["scope", "geography", "basis"]

    def reason(self, pair: dict) -> tuple[str, float, str]:
        """(outcome, confidence, decisive dimension) of the fields of both facts, prefixed l_ and r_."""
        known = lambda name: (pair.get(f"l_{name}"), pair.get(f"r_{name}"))
        differ = lambda name: None not in known(name) and known(name)[0] != known(name)[1]
        if differ("currency"):
            return "UNCERTAIN", 0.65, "currency"
        if differ("period"):
            return "RECONCILABLE", 0.95, "period"
        for name in self.EXPLAINS:
            if differ(name):
                return "RECONCILABLE", 0.85, name
        if None not in known("number"):
            a, b = map(abs, known("number"))
            equal = a == b or abs(a - b) / max(a, b) <= 0.005
        elif None not in known("text"):
            equal = not differ("text")
        else:
            return "UNCERTAIN", 0.5, "value"
        return ("CORROBORATES", 0.8, "value") if equal else ("CONTRADICTS", 0.95, "value")


def reason_pairs(pairs: DataFrame, provider: RelationshipReasoningProvider, gate: float = 0.60, concurrency: int | None = None) -> DataFrame:
    """(l_fact_id, r_fact_id, outcome, confidence, decisive, model, error): pairs of ``paired`` judged by a provider.

    A judgement below the gate becomes UNCERTAIN; a pair whose call fails after its retries gives a
    row with an error. ``concurrency`` bounds the calls made at once, whatever the cluster's size.
    """
    fields = [f"{s}_{n}" for s in "lr" for n in ("fact_id", "number", "text", "unit", "currency", "period", "scope", "geography", "basis")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pair in batch.to_pylist():
                try:
                    outcome, sure, why = with_retries(lambda pair=pair: provider.reason(pair))
                    out.append((outcome if sure >= gate else "UNCERTAIN", float(sure), why, None))
                except Exception as e:
                    out.append((None, None, None, f"RELATIONSHIP_REASONING_FAILURE: {e}"))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("r_fact_id")), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.string()),
                                              pa.array([provider.model] * len(out), pa.string()), pa.array(cols[3], pa.string())],
                                             names=["l_fact_id", "r_fact_id", "outcome", "confidence", "decisive", "model", "error"])

    rows = pairs.select(*fields)
    return (rows.repartition(concurrency) if concurrency else rows).mapInArrow(
        run, "l_fact_id string, r_fact_id string, outcome string, confidence double, decisive string, model string, error string")


def extract_facts(chunks: DataFrame, provider: FactExtractionProvider | None = None, text: str = "text", key: str = "document_id") -> DataFrame:
    """Drafts of every chunk; a chunk whose extraction fails gives one row with an error and no draft."""
    provider = provider or TemplateExtraction()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["subject", "predicate", "value", "time", "quote"]
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                try:
                    drafts = with_retries(lambda t=t: provider.extract(t or ""))
                    rows += [[d.get(n) for n in names] + [d.get("confidence"), None] for d in drafts]
                    at += [i] * len(drafts)
                except Exception as e:
                    rows.append([None] * 5 + [None, f"LLM_REQUEST_FAILURE: {e}"])
                    at.append(i)
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.string()) for c in cols[:5]], pa.array(cols[5], pa.float64()), pa.array(cols[6], pa.string())],
                names=[key, *names, "confidence", "error"])

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, text).mapInArrow(run, f"{key} {kind}, subject string, predicate string, value string, time string, quote string, confidence double, error string")


def by_confidence(drafts: DataFrame, least: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(eligible, low): drafts below the bound become issues."""
    return drafts.where(F.col("confidence") >= least), drafts.where(F.col("confidence") < least)


def embed_texts(rows: DataFrame, provider: EmbeddingProvider, key: str = "fact_id", text: str = "comparison_text") -> DataFrame:
    """(key, comparison_text, embedding, model, dimensions, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, errors = [], []
            for t in batch.column(1).to_pylist():
                try:
                    v = with_retries(lambda t=t: provider.embed(t))
                    if len(v) != provider.dimensions or not all(map(math.isfinite, v)):
                        raise ValueError("wrong dimensions or not finite")
                    vectors.append(v)
                    errors.append(None)
                except Exception as e:
                    vectors.append(None)
                    errors.append(f"EMBEDDING_FAILURE: {e}")
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.list_(pa.float32())), pa.array([provider.model] * n, pa.string()),
                                              pa.array([provider.dimensions] * n, pa.int32()), pa.array(errors, pa.string())],
                                             names=[key, "comparison_text", "embedding", "model", "dimensions", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).alias("comparison_text")).mapInArrow(
        run, f"{key} {kind}, comparison_text string, embedding array<float>, model string, dimensions int, error string")


def cache_misses(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Texts whose stored vector is missing or was made of another text, model or size."""
    return wanted.join(stored.select("fact_id", "comparison_text", "model", "dimensions"), ["fact_id", "comparison_text", "model", "dimensions"], "left_anti")


def extraction_key(version: str, model: str, text: str = "text", context: str | None = None):
    """Identity of an extraction: prompt version, model, hash of the chunk, hash of its context."""
    around = F.sha2(F.coalesce(F.col(context), F.lit("")), 256) if context else F.lit("")
    return F.concat_ws(":", F.lit(version), F.lit(model), F.sha2(F.col(text), 256), around)


def extract_cached(chunks: DataFrame, cache: DataFrame, provider: FactExtractionProvider | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(drafts of all chunks by cache_key, drafts to append to the cache).

    cache has the columns of the drafts with cache_key. Chunks with one key are extracted once; only
    keys the cache lacks reach the provider.
    """
    provider = provider or TemplateExtraction()
    keyed = chunks.select(extraction_key(provider.version, provider.model, text).alias("cache_key"), text)
    wanted = keyed.groupBy("cache_key").agg(F.first(text).alias(text))
    misses = wanted.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")
    fresh = extract_facts(misses, provider, text, "cache_key")
    every = cache.join(wanted.select("cache_key"), "cache_key", "left_semi").unionByName(fresh)
    return every, fresh.where("error is null")


def validate_drafts(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): texts not blank, confidence from 0 to 1, evidence given."""
    filled = F.lit(True)
    for c in ("subject", "predicate", "value", "quote"):
        filled = filled & F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    ok = filled & F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    return drafts.where(ok), drafts.where(~ok)
