"""Queries on texts: ingest, blocks, evidence, normal forms, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import dates, text as tx, values as vs
from factloom.operators import chunks as ck, evidence as ev, grounded as gr, hints as hn, layout as ly
from factloom.operators.providers import HashedEmbedding, embed_texts, extract_facts
from factloom.plans.read_api import pages
from factloom.sources.ingest import first_of_content, latest_delivery
from factloom.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query("""
SELECT sha256(text) AS sha256, arg_min(doc_id, (ingested_at, doc_id)) AS doc_id, count(*) AS n_copies
FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def ingest_dedup_by_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("text", "ingested_at", "doc_id")
    return first_of_content(docs, "text", ["ingested_at", "doc_id"]).select("sha256", "doc_id", "n_copies")


@query("""
SELECT evidence_id, max(ingested_at)::VARCHAR AS ingested_at, count(*) AS n FROM evidence GROUP BY 1""")
def evidence_latest_delivery(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence")
    last = latest_delivery(rows, "evidence_id", ["ingested_at", "fact_id"]).select("evidence_id", "ingested_at")
    n = rows.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n"))
    stamp = F.col("ingested_at").cast("string")
    return last.join(n, "evidence_id").select("evidence_id", stamp.alias("ingested_at"), "n")


@query(r"""
WITH b AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS p FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, trim(regexp_replace(p, '\s+', ' ', 'g')) AS p FROM b)
SELECT doc_id, count(*) AS n_blocks, sum(length(p))::BIGINT AS n_chars, sum(greatest(1, ceil(length(p) / 4.0)))::BIGINT AS n_tokens, max(length(p))::BIGINT AS longest
FROM c WHERE p <> '' GROUP BY 1""")
def document_blocks(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(tx.blocks(F.col("text"))).alias("p"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("p")).alias("n_chars"), F.sum(tx.estimated_tokens(F.col("p"))).cast("bigint").alias("n_tokens"),
                                      F.max(F.length("p")).cast("bigint").alias("longest"))


@query("""
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END::INT AS tokens FROM documents WHERE text IS NOT NULL""")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"))


@query()
def chunk_packing(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents laid out in pages of twelve paragraphs, with text, pages and overlaps."""
    return ck.chunks(pages(table(spark, d, "documents"))).withColumn("page_numbers", F.array_join("page_numbers", ","))


@query("""
SELECT document_id, count(*) AS n_chunks, left(max(d.text), 4000) AS opening FROM
(SELECT DISTINCT document_id, chunk_id FROM facts) f JOIN documents d USING (document_id) WHERE d.text IS NOT NULL GROUP BY document_id""")
def chunk_opening_context(spark: SparkSession, d: str) -> DataFrame:
    """Each document's chunks with the first 4,000 characters of its opening page."""
    chunks = table(spark, d, "facts").select("document_id", "chunk_id").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    pages = table(spark, d, "documents").where("text is not null").select("document_id", F.substr("text", F.lit(1), F.lit(4000)).alias("opening"))
    return chunks.join(pages, "document_id").select("document_id", "n_chunks", "opening")


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = latest_delivery(table(spark, d, "evidence"), "evidence_id", ["ingested_at", "fact_id"])
    claims = rows.select(F.col("evidence_id").alias("claim_id"), F.col("document_id").alias("page_key"), "quote")
    return claims, table(spark, d, "documents").select(F.col("document_id").alias("page_key"), "text")


@query("""
WITH e AS (SELECT evidence_id, arg_max(quote, (ingested_at, fact_id)) AS quote, arg_max(document_id, (ingested_at, fact_id)) AS document_id FROM evidence GROUP BY 1),
m AS (SELECT evidence_id, quote, text, instr(text, quote) AS pos FROM e JOIN documents USING (document_id))
SELECT evidence_id AS claim_id, (pos - 1)::INT AS start_char, (pos - 1 + length(quote))::INT AS end_char, quote AS matched_text,
substr(text, greatest(1, pos - 200)::BIGINT, least(200, pos - 1)::BIGINT) AS context_before, substr(text, (pos + length(quote))::BIGINT, 200) AS context_after
FROM m WHERE pos > 0 AND quote <> ''""")
def evidence_exact(spark: SparkSession, d: str) -> DataFrame:
    found = ev.exact_claims(*_claims(spark, d))
    return found.select("claim_id", "start_char", "end_char", "matched_text", "context_before", "context_after")


@query()
def evidence_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every claim with method or reason, score and span."""
    return ev.verify_claims(*_claims(spark, d)).select("claim_id", "method", F.round("score", 6).alias("score"), "start_char", "end_char")


@query("""
SELECT e.evidence_id, count(*) AS n, bool_and(substr(d.text, e.start_char + 1, e.end_char - e.start_char) = e.quote) AS offsets_hold
FROM evidence e JOIN documents d USING (document_id) WHERE e.start_char IS NOT NULL GROUP BY 1""")
def evidence_stored_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Do the stored offsets slice the stored text back to the quote?"""
    rows = table(spark, d, "evidence").where("start_char is not null").join(table(spark, d, "documents").select("document_id", "text"), "document_id")
    holds = F.substr("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("quote")
    return rows.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(holds).alias("offsets_hold"))


@query("""
SELECT fact_id, arg_max(quote, (verification_score, evidence_id)) AS quote, max(verification_score) AS score FROM evidence GROUP BY 1""")
def best_evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").groupBy("fact_id").agg(
        F.max_by("quote", F.struct("verification_score", "evidence_id")).alias("quote"), F.max("verification_score").alias("score"))


@query()
def numeric_hints(spark: SparkSession, d: str) -> DataFrame:
    return hn.hints(table(spark, d, "documents"))


@query(r"""
WITH v AS (SELECT fact_id, value_type, value_raw, trim(value_raw) AS t,
  regexp_extract(value_raw, '[-+]?(?:\d{1,3}(?:[,\s]\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)') AS n,
  list_filter(regexp_extract_all(lower(value_raw), '\p{L}+'), lambda w: w IN ('hundred','thousand','k','lakh','lac','million','m','crore','cr','billion','bn','b','trillion','tn'))[1] AS w FROM facts),
p AS (SELECT *, CASE WHEN regexp_matches(t, '^\(.*\)$') THEN -abs(TRY_CAST(regexp_replace(n, '[,\s]', '', 'g') AS DOUBLE)) ELSE TRY_CAST(regexp_replace(n, '[,\s]', '', 'g') AS DOUBLE) END AS num,
  CASE w WHEN 'hundred' THEN 1e2 WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 WHEN 'lakh' THEN 1e5 WHEN 'lac' THEN 1e5 WHEN 'million' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'crore' THEN 1e7 WHEN 'cr' THEN 1e7
    WHEN 'billion' THEN 1e9 WHEN 'bn' THEN 1e9 WHEN 'b' THEN 1e9 WHEN 'trillion' THEN 1e12 WHEN 'tn' THEN 1e12 ELSE 1 END AS mag,
  CASE WHEN regexp_matches(upper(value_raw), '(?:^|[^A-Z])USD(?:[^A-Z]|$)') THEN 'USD' WHEN regexp_matches(upper(value_raw), '(?:^|[^A-Z])EUR(?:[^A-Z]|$)') THEN 'EUR'
    WHEN regexp_matches(upper(value_raw), '(?:^|[^A-Z])GBP(?:[^A-Z]|$)') THEN 'GBP' WHEN regexp_matches(upper(value_raw), '(?:^|[^A-Z])INR(?:[^A-Z]|$)') THEN 'INR'
    WHEN contains(value_raw, '$') THEN 'USD' WHEN contains(value_raw, '€') THEN 'EUR' WHEN contains(value_raw, '£') THEN 'GBP' WHEN contains(value_raw, '₹') THEN 'INR' END AS cur FROM v)
SELECT fact_id, round(CASE value_type WHEN 'PERCENTAGE' THEN num WHEN 'DURATION' THEN NULL ELSE num * mag END, 4) AS number,
CASE value_type WHEN 'MONEY' THEN cur WHEN 'PERCENTAGE' THEN 'percent' END AS unit, CASE value_type WHEN 'MONEY' THEN cur END AS currency,
CASE value_type WHEN 'DURATION' THEN lower(regexp_replace(t, '\s+', ' ', 'g')) END AS text FROM p""")
def value_normalization(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "facts").select("fact_id", vs.normalize_value(F.col("value_raw"), F.col("value_type")).alias("v"))
    return v.select("fact_id", F.round(F.col("v.number").cast("double"), 4).alias("number"), "v.unit", "v.currency", "v.text")


_MONTHS = " ".join(f"WHEN '{m}' THEN '{i + 1:02d}'" for i, m in enumerate(dates.MONTHS))
_NAMES = dates.NAMES


@query(rf"""
WITH s AS (SELECT DISTINCT normalized_context.time_label AS label FROM facts),
d AS (SELECT label, regexp_extract(lower(label), '^(\d{{1,2}}) ({_NAMES}) (\d{{4}})$', ['d', 'm', 'y']) AS g FROM s),
e AS (SELECT label, CASE WHEN g.y <> '' THEN strftime(TRY_CAST(g.y || '-' || (CASE g.m {_MONTHS} END) || '-' || lpad(g.d, 2, '0') AS DATE), '%Y-%m-%d') END AS exact FROM d)
SELECT label AS time_label, exact AS exact_date,
CASE WHEN label IS NULL THEN 'UNKNOWN' WHEN exact IS NOT NULL THEN 'EXACT_DATE' WHEN regexp_matches(label, '^Q[1-4] FY\d{{4}}$') THEN 'QUARTER' WHEN regexp_matches(label, '^H[12] FY\d{{4}}$') THEN 'HALF_YEAR'
  WHEN regexp_matches(label, '^FY\d{{4}}$') THEN 'FISCAL_YEAR' WHEN regexp_matches(label, '^\d{{4}}$') THEN 'CALENDAR_YEAR' ELSE 'UNKNOWN' END AS kind,
coalesce(exact, label) AS label, exact AS period_end FROM e""")
def period_normalization(spark: SparkSession, d: str) -> DataFrame:
    label = table(spark, d, "facts").select(F.col("normalized_context.time_label").alias("time_label")).distinct()
    p = label.withColumn("p", dates.period(F.col("time_label")))
    return p.select("time_label", F.date_format(dates.exact_date(F.col("time_label")), "yyyy-MM-dd").alias("exact_date"), "p.kind", "p.label", F.col("p.end").alias("period_end"))


_SUFFIXES = "|".join(tx.ORGANIZATION_SUFFIXES)


@query(rf"""
WITH n AS (SELECT entity_id, canonical_name AS name, entity_type FROM entities UNION ALL SELECT a.entity_id, a.alias, e.entity_type FROM entity_aliases a JOIN entities e USING (entity_id)),
c AS (SELECT entity_id, name, entity_type, trim(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS clean FROM n)
SELECT entity_id, name, CASE WHEN entity_type = 'ORGANIZATION' THEN regexp_replace(clean, '(?:(?:^| )(?:{_SUFFIXES}))+$', '') ELSE clean END AS normalized FROM c""")
def entity_name_normalization(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "entities").select("entity_id", F.col("canonical_name").alias("name"), "entity_type")
    more = table(spark, d, "entity_aliases").join(own.select("entity_id", "entity_type"), "entity_id").select("entity_id", F.col("alias").alias("name"), "entity_type")
    return own.unionByName(more).select("entity_id", "name", tx.entity_name(F.col("name"), F.col("entity_type")).alias("normalized"))


@query(r"""
WITH s AS (SELECT DISTINCT predicate_raw FROM facts WHERE predicate_raw IS NOT NULL),
n AS (SELECT predicate_raw, regexp_replace(regexp_replace(lower(trim(predicate_raw, E' \t\n')), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake FROM s),
a AS (SELECT predicate_raw, CASE snake WHEN 'countries_and_territories_served' THEN 'countries_served' WHEN 'pin_codes_served' THEN 'postal_code_reach' WHEN 'pincode_reach' THEN 'postal_code_reach'
  WHEN 'postal_codes_served' THEN 'postal_code_reach' ELSE snake END AS predicate FROM n)
SELECT predicate_raw, predicate, array_to_string(list_filter(string_split(predicate, '_'), lambda t: t <> '' AND NOT regexp_matches(t,
  '^(annual|quarterly|reported|profit|loss|positive|negative|fy\d{2}(\d{2})?|q[1-4]|\d{4})$')), '_') AS concept FROM a""")
def predicate_normalization(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "facts").where("predicate_raw is not null").select("predicate_raw").distinct()
    return raw.withColumn("predicate", tx.predicate_name(F.col("predicate_raw"))).withColumn("concept", tx.predicate_concept(F.col("predicate")))


@query(r"""
SELECT fact_id, lower(regexp_replace(trim(normalized_context.scope), '\s+', ' ', 'g')) AS scope, lower(trim(normalized_context.basis)) AS basis,
coalesce(normalized_context.time_label, json_extract_string(qualifiers, '$.reportingPeriod'), json_extract_string(qualifiers, '$.period')) AS period,
json_extract_string(qualifiers, '$.sourceNote') AS source_note, json_extract_string(qualifiers, '$.tableNo') AS table_no FROM facts""")
def context_labels(spark: SparkSession, d: str) -> DataFrame:
    c, q = F.col("normalized_context"), (lambda k: F.get_json_object("qualifiers", f"$.{k}"))
    return table(spark, d, "facts").select("fact_id", tx.context_label(c["scope"]).alias("scope"), tx.context_label(c["basis"]).alias("basis"),
                                           F.coalesce(c["time_label"], q("reportingPeriod"), q("period")).alias("period"), q("sourceNote").alias("source_note"), q("tableNo").alias("table_no"))


_COMPARED = r"""SELECT f.fact_id, 'Task: identify facts that describe the same entity property for cross-document comparison.' || E'\nEntity: ' || nullif(trim(coalesce(nullif(trim(e.canonical_name), ''), f.subject_normalized)), '') || E'\nPredicate: ' || nullif(trim(f.predicate_canonical), '')
|| E'\nValue type: ' || f.value_type || E'\nPeriod: ' || coalesce(nullif(trim(f.normalized_context.time_label), ''), 'unspecified') || E'\nScope: ' || coalesce(nullif(trim(f.normalized_context.scope), ''), 'unspecified') AS comparison_text
FROM facts f LEFT JOIN entities e USING (entity_id)"""


def comparison_texts(spark: SparkSession, d: str) -> DataFrame:
    return gr.comparison_texts(table(spark, d, "facts"), table(spark, d, "entities"))


@query(f"WITH t AS ({_COMPARED}) SELECT fact_id, comparison_text, CASE WHEN comparison_text IS NULL THEN 'EMBEDDING_FAILURE: entity and predicate are needed' END AS error FROM t")
def fact_comparison_text(spark: SparkSession, d: str) -> DataFrame:
    return comparison_texts(spark, d)


@query()
def offline_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Distinct comparison texts with the vectors of the offline provider."""
    texts = comparison_texts(spark, d).where("error is null").select("comparison_text").distinct().withColumn("fact_id", F.sha2("comparison_text", 256))
    made = embed_texts(texts, HashedEmbedding(256))
    return made.select("fact_id", "model", "dimensions", F.size("embedding").alias("size"), F.to_json("embedding").alias("embedding"), "error")


@query()
def offline_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Facts proposed by the template provider for every document."""
    return extract_facts(table(spark, d, "documents").where("text is not null"), key="doc_id").drop("error")


_LATEST_EVIDENCE = """(SELECT evidence_id, unnest(arg_max({'fact_id': fact_id, 'page_number': page_number, 'quote': quote, 'start_char': start_char, 'end_char': end_char, 'created_at': created_at,
'verification_method': verification_method, 'verification_score': verification_score}, (ingested_at, fact_id))) FROM evidence GROUP BY evidence_id)"""


@query(rf"""
WITH p AS (SELECT fact_id, list(json_object('endChar', end_char, 'pageNumber', page_number, 'quote', quote, 'startChar', start_char) ORDER BY page_number NULLS FIRST, start_char NULLS FIRST, end_char NULLS FIRST, quote NULLS FIRST) AS places
FROM {_LATEST_EVIDENCE} GROUP BY 1),
s AS (SELECT f.fact_id, f.document_id, sha256(json_object('context', json_object('basis', normalized_context.basis, 'geography', normalized_context.geography, 'scope', normalized_context.scope, 'time', normalized_context.time_label),
 'documentId', f.document_id, 'evidence', coalesce(places, []), 'predicate', predicate_canonical, 'subject', subject_normalized, 'value', json_object('currency', currency, 'number', normalized_number::VARCHAR,
 'text', CASE WHEN normalized_number IS NULL AND value_type NOT IN ('MONEY', 'PERCENTAGE', 'NUMBER', 'QUANTITY') THEN lower(regexp_replace(trim(value_raw), '\s+', ' ', 'g')) END, 'unit', unit))::VARCHAR) AS signature
FROM facts f LEFT JOIN p USING (fact_id))
SELECT signature, min(fact_id) AS fact_id, count(*) AS n FROM s GROUP BY 1""")
def fact_signature_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One fact for each signature: document, subject, predicate, value, context and evidence agree."""
    signed = gr.stored_signatures(table(spark, d, "facts"), table(spark, d, "evidence"))
    return signed.groupBy("signature").agg(F.min("fact_id").alias("fact_id"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT fact_id, count(*) AS n_evidence, list({{'page_number': page_number, 'evidence_id': evidence_id, 'quote': quote}} ORDER BY page_number NULLS FIRST, created_at NULLS FIRST, evidence_id)::JSON::VARCHAR AS evidence
FROM {_LATEST_EVIDENCE} GROUP BY 1""")
def fact_evidence_lists(spark: SparkSession, d: str) -> DataFrame:
    """The nested evidence of each fact's detail view, as JSON."""
    lists = gr.evidence_lists(table(spark, d, "evidence"))
    shown = F.transform("evidence", lambda e: F.struct(e["page_number"].alias("page_number"), e["evidence_id"].alias("evidence_id"), e["quote"].alias("quote")))
    return lists.select("fact_id", "n_evidence", F.to_json(shown, {"ignoreNullFields": "false"}).alias("evidence"))


@query(f"SELECT evidence_id, fact_id, page_number FROM {_LATEST_EVIDENCE} WHERE verification_score = (SELECT max(verification_score) FROM evidence)")
def linked_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Links to the surest evidence, resolved inside the nested lists."""
    e = table(spark, d, "evidence")
    details = gr.evidence_lists(e)
    best = F.broadcast(e.agg(F.max("verification_score").alias("verification_score")))
    wanted = details.select(F.explode("evidence").alias("e")).select("e.evidence_id", "e.verification_score").join(best, "verification_score")
    return gr.linked_evidence(details, wanted)


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Positioned items made of order lines: an order is a page, its quantity the height on the page."""
    li = table(spark, d, "lineitem")
    y = F.floor(F.col("l_quantity") / 10) * 20
    return li.select(F.col("l_orderkey").alias("page_key"), F.concat("l_returnflag", F.lit("-"), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_linenumber") * 60.0).alias("x"),
                     y.cast("double").alias("y"), (F.pmod("l_suppkey", F.lit(40)) + 20).cast("double").alias("width"), F.lit(10.0).alias("height"))


_ITEMS = """i AS (SELECT l_orderkey AS page_key, l_returnflag || '-' || l_partkey AS text, l_linenumber * 60.0::DOUBLE AS x, (floor(l_quantity / 10) * 20)::DOUBLE AS y,
(l_suppkey % 40 + 20)::DOUBLE AS width, 10.0::DOUBLE AS height FROM lineitem),
l AS (SELECT *, dense_rank() OVER (PARTITION BY page_key ORDER BY y DESC)::INT AS line_number FROM i),
s AS (SELECT *, lag(line_number) OVER w AS pl, lag(x) OVER w AS px, lag(width) OVER w AS pw, lag(text) OVER w AS pt, lag(y) OVER w AS py FROM l WINDOW w AS (PARTITION BY page_key ORDER BY line_number, x, text)),
g AS (SELECT *, CASE WHEN pl IS NULL THEN 0 WHEN pl <> line_number THEN CASE WHEN abs(py - y) > 16.5 THEN 2 ELSE 1 END WHEN x - (px + pw) > greatest(1, 0.2 * pw / length(pt)) THEN 1 ELSE 0 END AS sep FROM s),
o AS (SELECT *, sum(sep + length(text)) OVER (PARTITION BY page_key ORDER BY line_number, x, text ROWS UNBOUNDED PRECEDING)::INT AS end_char FROM g)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    lined = _items(spark, d).withColumn("line_number", F.dense_rank().over(Window.partitionBy("page_key").orderBy(F.desc("y"))))
    return ly.offsets(lined.withColumn("line_y", F.col("y")).withColumn("line_height", F.col("height")))


@query(f"WITH {_ITEMS} SELECT page_key, line_number, text, (end_char - length(text))::INT AS start_char, end_char FROM o")
def line_assembly_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select("page_key", "line_number", "text", "start_char", "end_char")


@query(f"""WITH {_ITEMS} SELECT page_key, count(*)::INT AS n_items, string_agg((CASE sep WHEN 0 THEN '' WHEN 1 THEN CASE WHEN pl <> line_number THEN E'\\n' ELSE ' ' END ELSE E'\\n\\n' END) || text, '' ORDER BY line_number, x, text) AS text FROM o GROUP BY 1""")
def page_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Pages assembled item by item, as the reader of files does it."""
    return ly.assemble_pages(_items(spark, d)).select("page_key", "n_items", "text")


@query(f"""WITH {_ITEMS}, e AS (SELECT page_key, 5 AS a, 30 AS b FROM o GROUP BY 1)
SELECT page_key AS span_id, line_number, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height
FROM o JOIN e USING (page_key) WHERE end_char > a AND end_char - length(text) < b GROUP BY 1, 2""")
def evidence_bounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    placed = _placed(spark, d).select("page_key", "line_number", "x", "y", "width", "height", F.col("start_char").alias("item_start"), F.col("end_char").alias("item_end"))
    spans = _items(spark, d).select("page_key").distinct().select(F.col("page_key").alias("span_id"), "page_key", F.lit(5).alias("start_char"), F.lit(30).alias("end_char"))
    return ev.box_lines(placed, spans)
