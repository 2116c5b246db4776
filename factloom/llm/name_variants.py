"""Variant spellings of names typed by people (problem 5).

Names are blocked by the last letters of their tokens: a typing error, an initial or a lost
beginning leaves the rest of a token intact. No block is dropped or capped: a common one is split
over many tasks, and its pairs are first held against the letters they have in common, which
rejects only pairs that cannot reach the least similarity. What is left is compared by the longest
common subsequence of the parts, in any order; words of trade and given names may be abbreviated,
familiar or missing. Familiar forms of given names are learned from the facts and aliases that are
linked already. A name spelled like a known one is found by equality as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factloom.llm.lookalikes import unmask
from factloom.operators.skew import hot_join
from factloom.session import Scratch

SUFFIX = 3  # letters at the end of a token by which names meet
SPLIT = 2_000  # names or spellings of one key in a task; a key with more is split over several
SHARE = 500  # a token that over 1 / SHARE of a type's entities have is a word of trade: at most a few SHARE of them
LEAST_TRADE = 4
NEAR = 0.02  # scores this close are a tie
SEEN = 1  # facts or aliases that have to link a given name with another form of it
CORE, CORE_ALONE = 0.74, 0.8  # least similarity of the parts of a name, with and without a word of trade

# Legal forms and forms of address, which do not tell entities apart.
LEGAL = "plc ltd limited inc incorporated corp corporation co company llc llp lp ag gmbh sa sarl sas se nv bv ab oy as spa srl kg pvt pte pty private public".split()
TITLES = "mr mrs ms miss dr prof sir dame rev hon jr sr".split()
def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = s = (1 << len(a)) - 1
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def subsequence(a: str, b: str) -> bool:
    at = iter(b)
    return all(c in at for c in a)


def parts(name: str | None) -> tuple[list[str], list[str], bool]:
    """(tokens, legal forms, whether a comma inverts the name), in plain lower case without accents."""
    text = unicodedata.normalize("NFD", unmask(name or "").lower())
    text = "".join(c for c in text if not unicodedata.combining(c))
    head, comma, tail = text.strip(" \"'“”‘’.,;:-").partition(",")
    inverted = bool(comma and tail.strip() and not set(re.findall(r"[^\W_]+", tail.replace(".", ""))) <= set(LEGAL))
    if inverted:
        text = f"{tail} {head}"
    words = re.findall(r"[^\W_]+", re.sub(r"[.'’]", "", text))
    tokens = [w for w in words if w not in LEGAL and w not in TITLES]
    return tokens, [{"limited": "ltd", "corporation": "corp", "incorporated": "inc", "company": "co"}.get(w, w) for w in words if w in LEGAL], inverted


def blocking_keys(tokens: list[str]) -> list[str]:
    """The last letters of every token but initials; the name as a whole if it has nothing else."""
    return sorted({t[-SUFFIX:] for t in tokens if len(t) > 1}) or [" ".join(tokens)]


def sketch(text: str) -> tuple[int, int, int]:
    """(bits, bits, length): the letters and how often they occur; the bits in which two texts differ are at most their letters outside a common subsequence."""
    first = second = 0
    counts: dict[int, int] = {}
    for c in text:
        k = ord(c) - 97
        k = k if 0 <= k < 26 else 26 + ord(c) % 11
        n = counts[k] = counts.get(k, 0) + 1
        if k >= 26:
            first, second = (first | 1 << 26 + k, second) if n == 1 else (first, second | 1 << 26 + k)
        elif n <= 2:
            first |= 1 << 2 * k + n - 1
        elif n <= 4:
            second |= 1 << 2 * k + n - 3
    return first, second, len(text)


def trade_score(word: str, trade: str) -> float:
    """How well a typed word stands for a word of trade: 1 exact, less for typing errors and abbreviations, else 0."""
    if word == trade:
        return 1.0
    if len(word) >= 2 and len(word) < len(trade) and word[0] == trade[0]:
        if trade.startswith(word):
            return 0.985
        if subsequence(word, trade):
            return 0.96 + 0.02 * len(word) / len(trade)
    r = ratio(word, trade)
    return r if len(word) >= 4 and r >= 0.8 else 0.0


def core_score(typed: list[str], core: list[str]) -> float:
    """Similarity of the joined parts in the best order."""
    want = "".join(core)
    orders = permutations(typed) if len(typed) <= 3 else [typed, sorted(typed)]
    best = 0.0
    for k, order in enumerate(orders):
        best = max(best, ratio("".join(order), want) - (0.004 if k else 0))
    return best


def core_of(e: list[str], trades: frozenset[str], own_trade: str | None) -> tuple[str | None, list[str]]:
    """(word of trade, other parts) of a known name; the trade may be one that only the entity's canonical name has."""
    trade = next((t for t in reversed(e) if t in trades), None)
    core = list(e)
    if trade is not None:
        core.remove(trade)
    elif own_trade is not None:
        hit = max(((trade_score(t, own_trade), t) for t in e), default=(0, ""))
        if hit[0] >= 0.9 and len(e) > 1:
            core.remove(hit[1])
    return trade or own_trade, core


def score_name(q: list[str], q_forms: list[str], e: list[str], e_forms: list[str], trades: frozenset[str], own_trade: str | None) -> float:
    """Names of organisations, products and places; 0 where they cannot mean the same."""
    trade, core = core_of(e, trades, own_trade)
    if not core or not q:
        return 0.0
    best = 0.0
    if trade is not None and len(q) > 1:
        for i, word in enumerate(q):
            t = trade_score(word, trade)
            if t and (word == trade or word not in trades):
                rest = q[:i] + q[i + 1:]
                c = core_score(rest, core)
                if c >= CORE:
                    best = max(best, 0.9 * c + 0.1 * t)
    if len(q) <= len(core) and not (trade is not None and any(w in trades for w in q if w not in core)):
        c = core_score(q, core)
        if c >= CORE_ALONE or (c >= CORE and trade is None):
            best = max(best, 0.9 * c + (0.1 if trade is None else 0.06))
    if best and q_forms and e_forms:
        best += 0.012 if q_forms == e_forms else -0.004
    return best


def initials_first(q: list[str]) -> list[str]:
    """"Surname GM": the initials stand together."""
    return [q[1][0], q[1][1], q[0]] if len(q) == 2 and len(q[1]) == 2 and len(q[0]) > 2 else q


def other_given(q: list[str], e: list[str]) -> str | None:
    """The given name of a typed name whose surname is that of ``e``, if it is no spelling or initial of the given name of ``e``."""
    if len(q) < 2 or len(e) < 2:
        return None
    q = initials_first(q)
    surname, given = max((ratio(x, e[-1]), y) for x, y in ((q[-1], q[0]), (q[0], q[-1])))
    return given if surname >= CORE and len(given) > 1 and len(e[0]) > 1 and ratio(given, e[0]) < 0.75 else None


def score_person(q: list[str], e: list[str], familiar: frozenset[str] = frozenset()) -> float:
    """Given name, perhaps initials between, surname last; ``familiar`` are other forms of the known given name."""
    if len(q) < 2 or len(e) < 2:
        return 0.0
    best = 0.0
    q = initials_first(q)
    for order in {tuple(q), tuple(q[1:] + q[:1])}:
        surname, given = ratio(order[-1], e[-1]), order[0]
        if surname < CORE:
            continue
        if given == e[0]:
            g = 1.0
        elif given in familiar:
            g = 0.97
        elif len(given) == 1 or len(e[0]) == 1:
            g = 0.94 if given[0] == e[0][0] else 0.0
        else:
            g = ratio(given, e[0])
            near = max((ratio(given, n) for n in familiar), default=0.0)
            g = 0.98 * g if g >= 0.75 else 0.95 * near if near >= 0.79 else 0.0
        if not g:
            continue
        mine, theirs = [w[0] for w in order[1:-1]], [w[0] for w in e[1:-1]]
        if mine and theirs:
            if mine != theirs:
                continue
            extra = 0.02
        else:
            extra = -0.02 if mine else 0.0
        best = max(best, 0.6 * surname + 0.4 * g + extra - (0.01 if order != tuple(q) else 0))
    return best


def _prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        got = [parts(n) for n in frame["name"]]
        yield frame.assign(tokens=[" ".join(t) for t, _, _ in got], forms=[" ".join(f) for _, f, _ in got])


def _given_forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        forms = [other_given(q.split(), e.split()) for q, e in zip(frame["tokens"], frame["e_tokens"])]
        yield frame.assign(given=[e.split(" ")[0] for e in frame["e_tokens"]], form=forms)[["entity_id", "given", "form", "n"]]


def familiar_forms(facts: DataFrame, aliases: DataFrame, base: DataFrame) -> DataFrame:
    """(given, familiar): for each given name of a known person the other forms under which linked facts and aliases name its bearers.

    A form counts if SEEN facts or aliases have it; it goes both ways.
    """
    persons = base.where("type = 'PERSON' and tokens <> ''").select("entity_id", F.col("tokens").alias("e_tokens"))
    linked = facts.where("entity_id is not null and subject_raw is not null and subject_type = 'PERSON'").groupBy("entity_id", F.col("subject_raw").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    told = aliases.where("alias is not null").select("entity_id", F.col("alias").alias("name"), F.lit(1).cast("bigint").alias("n"))
    both = linked.unionByName(told).join(persons.select("entity_id").distinct(), "entity_id", "left_semi")
    prepared = both.mapInPandas(_prepare, "entity_id string, name string, n long, tokens string, forms string").where("tokens <> ''")
    met = prepared.select("entity_id", "tokens", "n").join(persons, "entity_id").mapInPandas(_given_forms, "entity_id string, given string, form string, n long").where("form is not null")
    seen = met.groupBy("given", "form").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    ways = seen.select("given", "form").unionByName(seen.select(F.col("form").alias("given"), F.col("given").alias("form")))
    return ways.groupBy("given").agg(F.array_join(F.array_sort(F.collect_set("form")), " ").alias("familiar"))


SKETCH = "struct<b1: bigint, b2: bigint, size: int>"


def _index(trades_cast):
    """Keys of known names, and the sketch of the part that is compared: the surname, or all but the word of trade."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trades = {k: frozenset(v) for k, v in trades_cast.value.items()}
        for frame in frames:
            names = [t.split() for t in frame["tokens"]]
            cores = [n[-1] if kind == "PERSON" else "".join(core_of(n, trades.get(kind, frozenset()), trade or None)[1]) for n, kind, trade in zip(names, frame["type"], frame["trade"])]
            yield frame.assign(sketch=[dict(zip(("b1", "b2", "size"), sketch(c))) for c in cores], keys=[blocking_keys(n) for n in names])

    return run


def _ask(trades_cast):
    """Keys of typed names, and the sketches of the parts that may stand for what is compared."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trades = {k: frozenset(v) for k, v in trades_cast.value.items()}
        known: dict[tuple[str, str], bool] = {}
        for frame in frames:
            sketches, keys = [], []
            for kind, tokens in zip(frame["type"], frame["tokens"]):
                q = tokens.split()
                keys.append(blocking_keys(q))
                if kind == "PERSON":
                    q = initials_first(q)
                    texts = {q[-1], q[0]}
                else:
                    for w in q:
                        if (kind, w) not in known:
                            known[kind, w] = any(trade_score(w, t) for t in trades.get(kind, ()))
                    texts = {"".join(q)} | {"".join(q[:i] + q[i + 1:]) for i, w in enumerate(q) if known[kind, w]}
                sketches.append([dict(zip(("b1", "b2", "size"), x)) for x in sorted({sketch(t) for t in texts})])
            yield frame.assign(sketches=sketches, keys=keys)

    return run


def _compare(trades_cast):
    """Compares typed names with known ones; only pairs that may mean the same go on. Equal names do, whatever they consist of."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trades = {k: frozenset(v) for k, v in trades_cast.value.items()}
        for frame in frames:
            out = []
            columns = ("q", "type", "tokens", "forms", "entity_id", "e_tokens", "e_forms", "trade", "familiar")
            for q_id, kind, tokens, forms, entity, known, known_forms, trade, familiar in zip(*[frame[c] for c in columns]):
                q, e = tokens.split(), known.split()
                score = score_person(q, e, frozenset(familiar.split())) if kind == "PERSON" else score_name(q, forms.split(), e, known_forms.split(), trades.get(kind, frozenset()), trade or None)
                score = max(score, 1.0) if q == e else score
                if score:
                    out.append((q_id, entity, float(score)))
            yield pd.DataFrame(out, columns=["q", "entity_id", "score"])

    return run


def _meet(index: DataFrame, asks: DataFrame) -> DataFrame:
    """Pairs of one type and key whose sketches allow the least similarity. A key's pairs are cut into squares of SPLIT by SPLIT, each a task's at most."""
    many = [x.groupBy("type", "key").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias(c)) for x, c in ((index, "rows"), (asks, "cols"))]
    # Bounded: a key in it has over SPLIT rows on one side.
    split = F.broadcast(many[0].join(many[1], ["type", "key"]).where("rows > 1 or cols > 1"))
    one = F.lit(1)

    def cut(x: DataFrame, own: str, across: str, by: list) -> DataFrame:
        x = x.join(split, ["type", "key"], "left").withColumn("rows", F.coalesce("rows", one)).withColumn("cols", F.coalesce("cols", one))
        at = (F.pmod(F.xxhash64(*by), F.col(own)) + 1).cast("int")
        return x.withColumn(own, at).withColumn(across, F.explode(F.sequence(one, F.col(across))))

    left, right = cut(asks, "cols", "rows", ["q", "s"]), cut(index, "rows", "cols", ["entity_id", "e_tokens", "e_forms"])
    differ = F.bit_count(F.col("s.b1").bitwiseXOR(F.col("sketch.b1"))) + F.bit_count(F.col("s.b2").bitwiseXOR(F.col("sketch.b2")))
    return left.join(right, ["type", "key", "rows", "cols"]).where(differ <= (1 - CORE) * (F.col("s.size") + F.col("sketch.size")) + 1e-6)


def resolve_names(facts: DataFrame, entities: DataFrame, aliases: DataFrame, documents: DataFrame) -> DataFrame:
    """(fact_id, entity_id, score): facts without entity_id whose subject means an entity of ``entities``.

    Only entities of the fact's subject type are considered. If several come equally close, the one
    that issued the fact's document is meant; if none of them did, the fact stays unresolved and is
    not returned. Null or blank subjects mean nobody. Aliases of unknown entities are ignored. Each
    spelling is compared once, however many facts share it; repeated facts come out once each.
    """
    spark = facts.sparkSession
    open_facts = facts.where(F.col("entity_id").isNull() & F.col("subject_raw").isNotNull()).select(
        "fact_id", "document_id", F.col("subject_raw").alias("name"), F.coalesce("subject_type", F.lit("")).alias("type"))
    known = entities.where("entity_id is not null").select("entity_id", F.col("canonical_name").alias("name"), F.col("entity_type").alias("type"))
    scratch = Scratch(spark, "p5")
    shape = "entity_id string, name string, type string, tokens string, forms string"
    base = scratch.keep(known.where("name is not null").distinct().mapInPandas(_prepare, shape))
    # Words of trade: tokens over 1 / SHARE of a type's entities have, so at most a few SHARE of them in each type.
    sizes = base.groupBy("type").agg(F.countDistinct("entity_id").alias("size"))
    words = base.where("type <> 'PERSON'").select("type", "entity_id", F.explode(F.array_distinct(F.split("tokens", " "))).alias("w")).groupBy("type", "w").agg(F.count(F.lit(1)).alias("n"))
    trade_rows = words.join(F.broadcast(sizes), "type").where((F.col("n") >= LEAST_TRADE) & (F.col("n") * SHARE > F.col("size")) & (F.length("w") >= 4))
    # A family's name is shared by few entities, a word of trade by entities of many families.
    trades: dict[str, list[str]] = {}
    pairs = base.where("type <> 'PERSON'").select("type", "entity_id", F.split("tokens", " ").alias("t")).select("type", F.element_at("t", 1).alias("first"), F.explode("t").alias("w"))
    spread = pairs.where("w <> first").groupBy("type", "w").agg(F.countDistinct("first").alias("families"))
    for r in trade_rows.join(spread, ["type", "w"]).where(F.col("families") >= LEAST_TRADE).select("type", "w").collect():
        trades.setdefault(r["type"], []).append(r["w"])
    cast = spark.sparkContext.broadcast(trades)
    own = [F.create_map(*[x for k, v in trades.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in sorted(v)]))])] if trades else []
    trade_of = F.element_at(F.array_intersect(F.split("tokens", " "), F.coalesce(F.try_element_at(own[0], F.col("type")), F.array().cast("array<string>"))), -1) if own else F.lit(None).cast("string")
    trade_of = F.when(F.size(F.array_intersect(F.split("tokens", " "), F.coalesce(F.try_element_at(own[0], F.col("type")), F.array().cast("array<string>")))) > 0, trade_of) if own else trade_of
    traded = base.select("entity_id", "type", trade_of.alias("trade"))
    other = aliases.where("alias is not null").select("entity_id", F.col("alias").alias("name")).distinct().join(known.select("entity_id", "type"), "entity_id").select("entity_id", "name", "type")
    names = base.unionByName(other.mapInPandas(_prepare, shape)).where("tokens <> ''").dropDuplicates(["entity_id", "tokens", "forms"]).join(traded, ["entity_id", "type"])
    learned = scratch.keep(familiar_forms(facts, aliases, base))
    names = names.withColumn("given", F.when(F.col("type") == "PERSON", F.element_at(F.split("tokens", " "), 1))).join(learned, "given", "left").withColumn("familiar", F.coalesce("familiar", F.lit("")))
    shape = f"entity_id string, type string, tokens string, forms string, trade string, familiar string, sketch {SKETCH}, keys array<string>"
    index = scratch.keep(names.select("entity_id", "type", "tokens", "forms", "trade", "familiar").mapInPandas(_index(cast), shape)).withColumnsRenamed({"tokens": "e_tokens", "forms": "e_forms"})
    asked = open_facts.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))
    prepared = asked.mapInPandas(_prepare, "name string, type string, n long, tokens string, forms string").where("tokens <> ''").withColumn("q", F.xxhash64("name", "type"))
    prepared = scratch.keep(prepared.mapInPandas(_ask(cast), f"name string, type string, n long, tokens string, forms string, q long, sketches array<{SKETCH}>, keys array<string>"))
    asks = prepared.select("q", "type", F.explode("keys").alias("key"), "sketches").select("q", "type", "key", F.explode("sketches").alias("s"))
    met = _meet(index.where("sketch.size > 0").withColumn("key", F.explode("keys")).drop("keys"), asks).select("q", "entity_id", "e_tokens", "e_forms", "trade", "familiar").distinct()
    spelled = prepared.select("q", "type", "tokens", "forms")
    same = spelled.join(index.select("entity_id", "type", "e_tokens", "e_forms", "trade", "familiar").withColumn("tokens", F.col("e_tokens")), ["type", "tokens"])
    pairs = met.join(spelled, "q").unionByName(same.select("q", "entity_id", "e_tokens", "e_forms", "trade", "familiar", "type", "tokens", "forms"))
    scored = scratch.keep(pairs.mapInPandas(_compare(cast), "q long, entity_id string, score double").groupBy("q", "entity_id").agg(F.max("score").alias("score")))
    top = scored.groupBy("q").agg(F.max(F.struct("score", "entity_id")).alias("top"))
    near = scored.join(top, "q").where(F.col("score") > F.col("top.score") - NEAR).select("q", F.col("entity_id").alias("issuer_id"))
    best = top.join(near.groupBy("q").agg(F.count(F.lit(1)).alias("near")), "q").select("q", F.col("top.entity_id").alias("entity_id"), F.col("top.score").alias("score"), "near")
    best = best.join(prepared.select("q", "name", "type", "n"), "q")
    hits = hot_join(open_facts, best, ["name", "type"], "n", facts.count())
    sure = hits.where("near = 1").select("fact_id", "entity_id", "score")
    issuers = documents.where("document_id is not null and issuer_id is not null").select("document_id", "issuer_id").distinct()
    tied = hits.where("near > 1").join(issuers, "document_id").join(near, ["q", "issuer_id"], "left_semi")
    return sure.unionByName(tied.select("fact_id", F.col("issuer_id").alias("entity_id"), "score"))
