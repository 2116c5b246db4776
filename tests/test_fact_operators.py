from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import candidates as cd, entities as en, relationships as rl, store as st
from factloom.operators.providers import HashedEmbedding, TemplateExtraction, TransientError, embed_texts, with_retries
from factloom.operators.skew import hot_join
from factloom.plans import read_api as api
from factloom.streaming import incremental as inc

FACT = ("fact_id string, document_id string, entity_id string, subject_raw string, subject_type string, subject_normalized string, predicate_raw string, predicate_canonical string, value_raw string, value_type string, "
        "normalized_number double, unit string, currency string, qualifiers string, normalized_context struct<time_label: string, geography: string, scope: string, basis: string>, confidence double, created_at timestamp")


def facts(spark, rows):
    names = [f.name for f in spark.createDataFrame([], FACT).schema]
    base = {"subject_type": "ORGANIZATION", "subject_raw": "Acme", "subject_normalized": "acme", "predicate_canonical": "revenue", "value_type": "MONEY", "confidence": 0.9, "created_at": datetime(2024, 1, 1)}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], FACT)


def context(time=None, geography=None, scope=None, basis=None):
    return (time, geography, scope, basis)


def decide(spark, a, b):
    f = facts(spark, [{"fact_id": "f1", "document_id": "d1", "entity_id": "e", **a}, {"fact_id": "f2", "document_id": "d2", "entity_id": "e", **b}])
    pairs = spark.createDataFrame([("f1", "f2")], "left_fact_id string, right_fact_id string")
    return rl.decide(rl.paired(pairs, f)).first()


@pytest.mark.parametrize("a, b, outcome, method", [
    ({"normalized_number": 12e6, "currency": "USD", "unit": "USD"}, {"normalized_number": 12.0e6, "currency": "USD", "unit": "USD"}, "CORROBORATES", "RULE"),
    ({"normalized_number": 12e6}, {"normalized_number": 18e6}, "CONTRADICTS", "REASONER"),
    ({"normalized_number": 4516e6, "predicate_canonical": "ebitda_loss_fy23", "qualifiers": '{"reportingPeriod":"FY23"}'}, {"normalized_number": 4520e6, "predicate_canonical": "ebitda", "qualifiers": '{"reporting_period":"FY23"}'}, "CORROBORATES", "RULE"),
    ({"normalized_number": 5.0, "normalized_context": context("H1 FY2025")}, {"normalized_number": 10.0, "normalized_context": context("FY2025")}, "RECONCILABLE", "REASONER"),
    ({"normalized_number": 5.0, "currency": "USD"}, {"normalized_number": 5.0, "currency": "EUR"}, "UNCERTAIN", "REASONER"),
    ({"normalized_number": 5.0, "normalized_context": context(scope="india")}, {"normalized_number": 9.0, "normalized_context": context(scope="global")}, "RECONCILABLE", "REASONER"),
    ({"value_type": "TEXT", "value_raw": "In  Force"}, {"value_type": "TEXT", "value_raw": "in force"}, "CORROBORATES", "RULE"), ({"value_type": "TEXT", "value_raw": "in force"}, {"value_type": "TEXT", "value_raw": "lapsed"}, "CONTRADICTS", "REASONER"),
    ({"normalized_number": 5.0, "normalized_context": context("FY2024")}, {"normalized_number": 5.0, "qualifiers": '{"period":"FY2024"}'}, "CORROBORATES", "REASONER"),
    ({"normalized_number": 5.0}, {}, "UNCERTAIN", "REASONER"), ({"entity_id": "x", "subject_normalized": "other", "normalized_number": 5.0}, {"normalized_number": 5.0}, None, None),
    ({"normalized_number": 5.0, "document_id": "d2"}, {"normalized_number": 5.0}, None, None), ({"normalized_number": 5.0, "predicate_canonical": "employee_count"}, {"normalized_number": 5.0}, None, None),
])
def test_decisions(spark, a, b, outcome, method):
    r = decide(spark, a, b)
    assert (r["outcome"], r["method"]) == (outcome, method)


def test_canonical_pairs(spark):
    at = datetime(2024, 1, 1)
    rows = [("r1", "b", "a", "CORROBORATES", 0.5, at, at), ("r1", "a", "b", " contradicts", 0.7, at, datetime(2024, 1, 2)), ("r2", "a", None, "X", 0.1, at, at), ("r3", "a", "a", "X", 0.1, at, at)]
    r = spark.createDataFrame(rows, "relationship_id string, left_fact_id string, right_fact_id string, relationship_type string, confidence double, created_at timestamp, ingested_at timestamp")
    assert [tuple(x) for x in rl.canonical_pairs(r).select("left_fact_id", "right_fact_id", "relationship_type", "confidence").collect()] == [("a", "b", "CONTRADICTS", 0.7)]


def test_retrieval(spark):
    rows = [{"fact_id": "s", "document_id": "d0", "entity_id": "e"}, {"fact_id": "direct", "document_id": "d1", "entity_id": "e"}, {"fact_id": "near", "document_id": "d2", "entity_id": "e", "predicate_canonical": "turnover"},
            {"fact_id": "other", "document_id": "d3", "entity_id": "x"}, {"fact_id": "same", "document_id": "d0", "entity_id": "e"}, {"fact_id": "far", "document_id": "d4", "entity_id": "e", "predicate_canonical": "costs"},
            {"fact_id": "u", "document_id": "d5", "subject_normalized": "globex technologies"}, {"fact_id": "u2", "document_id": "d6", "subject_normalized": "globex technologies"}, {"fact_id": "u3", "document_id": "d7", "subject_normalized": "initech"}]
    vectors = {"s": (1, 0), "direct": (0, 1), "near": (0.99, 0.1), "other": (1, 0), "same": (1, 0), "far": (0, 1), "u": (1, 0), "u2": (1, 0.05), "u3": (1, 0)}
    v = spark.createDataFrame([(k, [float(x) for x in p], datetime(2024, 1, 1), "m") for k, p in vectors.items()], "fact_id string, embedding array<float>, created_at timestamp, model string")
    got = [(r["source_id"], r["candidate_id"], r["match_reason"]) for r in cd.retrieve(facts(spark, rows), v, 2, 0.8, 5).orderBy("source_id", "rank").collect()]
    assert [x[1:] for x in got if x[0] == "s"] == [("direct", "ENTITY_PREDICATE"), ("near", "ENTITY_VECTOR")]
    assert [x[1:] for x in got if x[0] == "u"] == [("u2", "UNRESOLVED_SUBJECT_VECTOR")]
    assert cd.retrieve(facts(spark, rows), v, 2, 0.8, 1).where("source_id = 's'").count() == 1


def test_resolution_ladder(spark):
    e = spark.createDataFrame([("e1", "globex technologies", "ORGANIZATION", datetime(2023, 1, 1)), ("e2", "initech", "ORGANIZATION", datetime(2023, 1, 1))], "entity_id string, normalized_name string, entity_type string, created_at timestamp")
    a = spark.createDataFrame([("a1", "e2", "ini group", datetime(2023, 1, 1))], "alias_id string, entity_id string, normalized_alias string, created_at timestamp")
    names = ["Globex Technologies Inc", "Ini Group", "Globex Technologie", "Hooli Networks", "Hooli Network", "Company Limited"]
    f = facts(spark, [{"fact_id": f"f{i}", "document_id": "d", "subject_raw": n, "created_at": datetime(2024, 1, 1 + i)} for i, n in enumerate(names)])
    got = {r["fact_id"]: (r["entity_id"], r["match_method"]) for r in en.resolve(f, e, a, 0.8).collect()}
    assert got["f0"] == ("e1", "CANONICAL_EXACT") and got["f1"] == ("e2", "ALIAS_EXACT") and got["f2"] == ("e1", "TRIGRAM")
    assert got["f3"][1] == "CREATED" and got["f4"] == (got["f3"][0], "TRIGRAM") and "f5" not in got
    with pytest.raises(ValueError):
        en.trigram_candidates(en.mentions(f), e, a, limit=0)


def test_similarity_join_loses_no_pair(spark):
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(60)]
    names = spark.createDataFrame([(w, "T") for w in words], "name string, type string").distinct()
    known = spark.createDataFrame([(w, w, "T") for w in words], "key string, other string, type string").distinct()

    def grams(w):
        p = f"  {w} "
        return {p[i:i + 3] for i in range(len(p) - 2)}

    want = {(x, y) for x in words for y in words if round(len(grams(x) & grams(y)) / len(grams(x) | grams(y)), 6) >= 0.5}
    assert {(r["name"], r["key"]) for r in en.similarities(names, known, 0.5).collect()} == want


def test_store(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "k string, v int, at int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 9, 1)], "k string, v int, at int")
    assert sorted(map(tuple, st.keyed_upsert(old, new, ["k"], "at").select("k", "v").collect())) == [("a", 1), ("b", 3), ("c", 9)]
    assert sorted(map(tuple, st.insert_if_absent(old, new, ["k"], "at").select("k", "v").collect())) == [("a", 1), ("b", 1), ("c", 9)]
    assert sorted(map(tuple, st.replace_by(old, new, "k").select("k", "v").collect())) == [("a", 1), ("b", 2), ("b", 3), ("c", 9)]


def test_hot_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i % 50}", i) for i in range(300)] + [(None, 1)], "k string, i int")
    unique = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert hot_join(rows, unique, ["k"], "n", 1200, floor=100).count() == 1200
    assert hot_join(rows, unique, ["k"], "n", 50, floor=100).count() == 1200


def test_read_api(spark):
    f = facts(spark, [{"fact_id": "1", "document_id": "d", "value_raw": "$10 million", "confidence": 0.96}, {"fact_id": "2", "document_id": "d", "value_raw": "$12 million", "confidence": 0.88}, {"fact_id": "3", "document_id": "d", "value_raw": "100%_x", "predicate_canonical": None}])
    assert [r["fact_id"] for r in api.where_facts(f, predicate="REV", search="million", least_confidence=0.9).collect()] == ["1"]
    assert [r["fact_id"] for r in api.where_facts(f, search="%_").collect()] == ["3"]
    page = api.paged(f, [F.desc("fact_id")], 2, 2)
    assert page.total == 3 and page.pages == 2 and [r["fact_id"] for r in page.rows.collect()] == ["1"] and '"total_pages":2' in page.envelope().first()["body"]
    for bad in ({"page_size": 101}, {"page": 0}, {"least_confidence": 1.5}, {"predicate": "x" * 201}):
        with pytest.raises(api.RequestError):
            api.check(**bad)


def test_providers(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TransientError
        return "ok"

    assert with_retries(flaky, sleep=lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(ValueError):
        with_retries(lambda: (_ for _ in ()).throw(ValueError()), sleep=lambda s: None)
    got = TemplateExtraction().extract("Acme Ltd had net sales of $12 million in FY2025. Then for FY2024, Acme Ltd disclosed costs of 5%.")
    assert [(d["subject"], d["predicate"], d["value"], d["time"]) for d in got] == [("Acme Ltd", "net sales", "$12 million", "FY2025"), ("Acme Ltd", "costs", "5%", "FY2024")]
    rows = spark.createDataFrame([("f1", "Entity: A"), ("f2", " "), ("f3", None), ("f4", "x" * 9000)], "fact_id string, comparison_text string")
    made = {r["fact_id"]: r for r in embed_texts(rows, HashedEmbedding(32)).collect()}
    assert made["f1"]["error"] is None and abs(sum(x * x for x in made["f1"]["embedding"]) - 1) < 1e-5
    assert all(made[k]["embedding"] is None and made[k]["error"].startswith("EMBEDDING_FAILURE") for k in ("f2", "f3", "f4"))


def test_replayed_batches_lose_no_links(spark, tmp_path):
    """A batch that is cut short anywhere and runs again leaves the classes as if nothing had happened."""
    rows = [("a", "d1", "k"), ("b", "d1", "k"), ("c", "d2", "k"), ("d", "d3", "z"), ("e", "d3", "z"), ("f", "d4", "q")]
    f = spark.createDataFrame(rows, "fact_id string, document_id string, key string")
    want = [("a", "a", 1), ("b", "a", 1), ("c", "a", 2)]
    plain, cut = f"{tmp_path}/plain", f"{tmp_path}/cut"
    assert inc.linked_facts(spark, plain, ["key"]).count() == 0
    for target in (plain, cut):
        write = inc.link_writer(spark, target, ["key"])
        for batch, ids in enumerate((["a", "d"], ["b", "c"], ["e", "f"])):
            mine = f.where(f.fact_id.isin(ids))
            if target == cut:
                inc.batch_writer(f"{target}/facts")(mine, batch)  # the run dies after the first of its two tables
                write(mine, batch)
            write(mine, batch)
    for target in (plain, cut):
        assert sorted(tuple(r) for r in inc.linked_facts(spark, target, ["key"]).collect()) == want


def test_a_killed_stream_resumes(spark, tmp_path):
    f = spark.createDataFrame([(f"f{i}", f"d{i % 5}", "k") for i in range(20)], "fact_id string, document_id string, key string")
    f.repartition(4).write.parquet(f"{tmp_path}/in")
    write, seen = inc.link_writer(spark, f"{tmp_path}/out", ["key"]), []

    def dies_once(df, batch_id):
        write(df, batch_id)
        seen.append(batch_id)
        if len(seen) == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception):
        inc.drain(spark, f"{tmp_path}/in", f.schema, dies_once, f"{tmp_path}/offsets")
    inc.drain(spark, f"{tmp_path}/in", f.schema, dies_once, f"{tmp_path}/offsets")
    assert seen.count(1) == 2
    got = inc.linked_facts(spark, f"{tmp_path}/out", ["key"]).collect()
    assert len(got) == 20 and {(r["class_id"], r["n_links"]) for r in got} == {("f0", 16)}



def test_grounded_facts(spark):
    from factloom.operators import grounded as gr

    shape = ("fact_id string, document_id string, subject string, predicate string, value string, value_type string, context struct<time_label: string, scope: string, status_as_of: string>, "
             "evidence array<struct<page: int, quote: string>>, qualifiers array<struct<name: string, value: string>>")
    one = ("f1", "d", "  Ａcme  Corp ", "PIN code reach", "31 March 2024", "DATE", ("q1 2025", " Group ", "2024-3-1"), [(2, "b"), (1, "a")], [(" no ", "1"), ("no", "2"), (None, "x")])
    two = ("f2", "d", "acme corp", "pincode_reach", "31 march 2024", "DATE", ("Q1 FY2025", "group", "1 March 2024"), [(1, "a"), (2, "b")], None)
    other = ("f3", "d", "acme corp", "pincode_reach", "32 march 2024", "DATE", (None, None, None), None, [])
    rows = spark.createDataFrame([one, two, other], shape)
    got = {r["fact_id"]: r for r in gr.normalize_facts(rows).collect()}
    assert got["f1"]["subject_normalized"] == "acme corp" and got["f1"]["predicate_canonical"] == "postal_code_reach"
    assert str(got["f1"]["normalized_value"]["date"]) == "2024-03-31" and got["f1"]["normalized_value"]["text"] is None and got["f3"]["normalized_value"]["text"] == "32 march 2024"
    c = got["f1"]["normalized_context"]
    assert (c["time"]["kind"], c["time"]["label"], c["scope"], c["geography"], c["status_as_of"]) == ("QUARTER", "Q1 FY2025", "group", None, "2024-03-01")
    assert got["f1"]["fact_signature"] == got["f2"]["fact_signature"] != got["f3"]["fact_signature"]
    assert [tuple(r) for r in gr.qualifier_maps(rows).collect()] == [("f1", {"no": "2"})]


def test_comparison_texts_and_issues(spark):
    from factloom.operators import grounded as gr

    f = facts(spark, [{"fact_id": "a", "document_id": "d", "entity_id": "e", "normalized_context": context("FY2024", scope=" ")}, {"fact_id": "b", "document_id": "d", "predicate_canonical": None}, {"fact_id": "c", "document_id": "d", "subject_normalized": " ", "entity_id": "gone"}])
    e = spark.createDataFrame([("e", " Acme Group ")], "entity_id string, canonical_name string")
    got = {r["fact_id"]: r for r in gr.comparison_texts(f, e).collect()}
    assert got["a"]["comparison_text"].split("\n")[1:] == ["Entity: Acme Group", "Predicate: revenue", "Value type: MONEY", "Period: FY2024", "Scope: unspecified"] and got["a"]["error"] is None
    assert all(got[k]["comparison_text"] is None and got[k]["error"].startswith("EMBEDDING_FAILURE") for k in "bc")
    pages = spark.createDataFrame([("d", 1, "  ", 2), ("d", 2, None, 0), ("d", 3, "x", 5)], "document_id string, page_number int, text string, n_images int")
    assert sorted((r["page_number"], r["issue_type"]) for r in api.page_issues(pages).collect()) == [(1, "EMPTY_PAGE"), (1, "OCR_REQUIRED"), (2, "EMPTY_PAGE")]


def test_reasoning_provider(spark):
    from factloom.operators.providers import OfflineReasoner, reason_pairs

    class Failing(OfflineReasoner):
        def reason(self, pair):
            if pair["r_number"] == 7.0:
                raise ValueError("no answer")
            return super().reason(pair)

    f = facts(spark, [{"fact_id": f"f{i}", "document_id": f"d{i}", "entity_id": "e", "normalized_number": n, "currency": c} for i, (n, c) in enumerate([(5.0, "USD"), (5.01, "USD"), (7.0, "USD"), (9.0, "EUR"), (None, "USD")])])
    pairs = rl.paired(spark.createDataFrame([("f0", f"f{i}") for i in range(1, 5)], "left_fact_id string, right_fact_id string"), f)
    got = {r["r_fact_id"]: (r["outcome"], r["error"]) for r in reason_pairs(pairs, Failing(), concurrency=2).collect()}
    assert got == {"f1": ("CORROBORATES", None), "f2": (None, "RELATIONSHIP_REASONING_FAILURE: no answer"), "f3": ("UNCERTAIN", None), "f4": ("UNCERTAIN", None)}


def test_names_join_what_came_before(spark):
    """The rounds of joins decide as a pass over the names in order would."""
    import random

    rng = random.Random(5)
    names = [f"n{i:02d}" for i in range(40)]
    sims = {}
    for a in range(40):
        for b in range(a):
            if rng.random() < 0.08:
                sims[names[a], names[b]] = sims[names[b], names[a]] = round(0.85 + rng.random() * 0.14, 3)
    old = {n: (f"old{n}", round(0.85 + rng.random() * 0.14, 3)) for n in names if rng.random() < 0.2}
    order = sorted(names, key=lambda n: (hash(n) % 7, n))
    at = {n: i for i, n in enumerate(order)}
    place = {}
    for n in order:
        best = old.get(n, (None, 0.0))
        for m in order[:at[n]]:
            if (n, m) in sims and sims[n, m] > best[1]:
                best = (place[m], sims[n, m])
        place[n] = best[0] or "new"
        if place[n] == "new":
            place[n] = f"new of {n}"
    f = spark.createDataFrame([(n, "T", at[n], *old.get(n, (None, None))) for n in names], "name string, type string, first_at int, entity_id string, similarity double")
    e = spark.createDataFrame([(a, b, "T", s) for (a, b), s in sims.items()], "name string, key string, type string, similarity double")
    got = {r["name"]: r["entity_id"] for r in en.place_in_order(f, e).collect()}
    heads = {got[n]: f"new of {n}" for n in names if place[n] == f"new of {n}"}
    assert {n: heads.get(x, x) for n, x in got.items()} == place


def test_requests_are_checked(spark):
    f = facts(spark, [{"fact_id": "a", "document_id": "d"}])
    for bad in ({"value_type": "money"}, {"document_id": ""}, {"entity_id": "a b"}, {"least_confidence": 1.5}, {"search": ""}):
        with pytest.raises(api.RequestError):
            api.where_facts(f, **bad)
    assert api.where_facts(f, document_id="d", value_type="MONEY").count() == 1
    with pytest.raises(api.RequestError):
        api.where_issues(f, severity="FATAL")
    with pytest.raises(api.RequestError):
        api.where_relationships(f, "SIMILAR")
