"""Queries on facts, entities, vectors and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factloom.functions.vectors import usable_vector, valid_vector
from factloom.operators import candidates as cd, entities as en, relationships as rl, store as st
from factloom.functions.sql_functions import register_functions
from factloom.operators.providers import OfflineReasoner, by_confidence, cache_misses, reason_pairs
from factloom.plans import read_api as api
from factloom.plans.sql import nfkc_sql
from factloom.plans.text_queries import _COMPARED, comparison_texts
from factloom.tables import table

QUERIES, ORACLE = {}, {}
DIMS = 128


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


PAIRS = """pairs AS (SELECT least(left_fact_id, right_fact_id) AS left_fact_id, greatest(left_fact_id, right_fact_id) AS right_fact_id,
arg_max(upper(regexp_replace(relationship_type, '\\s', '', 'g')), (ingested_at, created_at, relationship_id)) AS relationship_type,
arg_max(confidence, (ingested_at, created_at, relationship_id)) AS confidence, max(relationship_id) AS relationship_id
FROM fact_relationships WHERE left_fact_id IS NOT NULL AND right_fact_id IS NOT NULL AND left_fact_id <> right_fact_id GROUP BY 1, 2)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return rl.canonical_pairs(table(spark, d, "fact_relationships"))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def pair_canonicalization(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("left_fact_id", "right_fact_id", "relationship_type", "confidence", "relationship_id")


@query("""
SELECT fact_id, document_id, predicate_canonical, value_raw, confidence FROM facts
WHERE lower(predicate_canonical) LIKE '%rev%' AND value_type = 'MONEY' AND confidence >= 0.8 AND
(contains(lower(subject_raw), 'million') OR contains(lower(predicate_raw), 'million') OR contains(lower(predicate_canonical), 'million') OR contains(lower(value_raw), 'million'))""")
def facts_list_filtered(spark: SparkSession, d: str) -> DataFrame:
    got = api.where_facts(table(spark, d, "facts"), predicate="REV", value_type="MONEY", least_confidence=0.8, search="Million")
    return got.select("fact_id", "document_id", "predicate_canonical", "value_raw", "confidence")


@query("SELECT fact_id, document_id, confidence FROM facts ORDER BY created_at DESC, fact_id LIMIT 20 OFFSET 40")
def facts_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of facts, newest first."""
    return api.paged(table(spark, d, "facts"), [F.desc("created_at"), F.col("fact_id")], 3, 20).rows.select("fact_id", "document_id", "confidence")


@query("SELECT document_id, filename, status, page_count, source, lang, n_chars FROM documents WHERE status = (SELECT min(status) FROM documents)")
def documents_by_status(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("status").alias("status"))
    return docs.join(F.broadcast(first), "status").select(*api.DOCUMENT_COLUMNS)


@query("SELECT document_id, filename FROM documents WHERE contains(lower(filename), 'report')")
def documents_by_filename(spark: SparkSession, d: str) -> DataFrame:
    return api.where_documents(table(spark, d, "documents"), filename="Report").select("document_id", "filename")


@query("SELECT document_id, filename, status FROM documents ORDER BY ingested_at DESC, document_id LIMIT 5")
def recent_documents(spark: SparkSession, d: str) -> DataFrame:
    return api.recent(table(spark, d, "documents")).select("document_id", "filename", "status")


@query(r"""WITH b AS (SELECT document_id, unnest(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '')) AS p,
generate_subscripts(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''), 1) AS i FROM documents WHERE text IS NOT NULL)
SELECT document_id, (floor((i - 1) / 12) + 1)::INT AS page_number, string_agg(p, E'\n\n' ORDER BY i) AS text, length(string_agg(p, E'\n\n' ORDER BY i))::INT AS n_chars FROM b GROUP BY 1, 2""")
def document_pages(spark: SparkSession, d: str) -> DataFrame:
    return api.pages(table(spark, d, "documents"))


@query("SELECT document_id, filename, page_count FROM documents WHERE page_count BETWEEN 2 AND 3")
def small_samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("page_count").between(2, 3)).select("document_id", "filename", "page_count")


@query("""
WITH q AS (SELECT fact_id, count(DISTINCT evidence_id) AS n_evidence, arg_min(evidence_id, (page_number, created_at, evidence_id)) AS first_evidence_id, max(verification_score) AS best_score FROM evidence GROUP BY 1)
SELECT f.fact_id, f.document_id, d.filename, f.entity_id, e.canonical_name, f.predicate_canonical, f.value_raw, f.confidence, coalesce(q.n_evidence, 0) AS n_evidence, q.first_evidence_id, q.best_score
FROM facts f JOIN documents d USING (document_id) LEFT JOIN entities e ON f.entity_id = e.entity_id LEFT JOIN q ON f.fact_id = q.fact_id""")
def fact_details(spark: SparkSession, d: str) -> DataFrame:
    return api.fact_details(table(spark, d, "facts"), table(spark, d, "entities"), table(spark, d, "documents"), table(spark, d, "evidence"))


_BY_TYPE = "count(*) AS total, count(*) FILTER (relationship_type = 'CORROBORATES') AS corroborates, count(*) FILTER (relationship_type = 'CONTRADICTS') AS contradicts, count(*) FILTER (relationship_type = 'RECONCILABLE') AS reconcilable, count(*) FILTER (relationship_type = 'UNCERTAIN') AS uncertain"


@query(f"WITH {PAIRS} SELECT fact_id, {_BY_TYPE} FROM (SELECT left_fact_id AS fact_id, relationship_type FROM pairs UNION ALL SELECT right_fact_id, relationship_type FROM pairs) GROUP BY 1")
def fact_relationship_summary(spark: SparkSession, d: str) -> DataFrame:
    return api.relationship_counts(_pairs(spark, d))


_DETAILS = f"""WITH {PAIRS} SELECT p.*, l.document_id AS left_document_id, l.entity_id AS left_entity_id, l.predicate_canonical AS left_predicate, l.value_raw AS left_value,
r.document_id AS right_document_id, r.entity_id AS right_entity_id, r.predicate_canonical AS right_predicate, r.value_raw AS right_value
FROM pairs p JOIN facts l ON l.fact_id = p.left_fact_id JOIN facts r ON r.fact_id = p.right_fact_id"""


@query(_DETAILS)
def relationship_details(spark: SparkSession, d: str) -> DataFrame:
    return api.relationship_details(_pairs(spark, d), table(spark, d, "facts"))


@query(f"SELECT relationship_id, relationship_type, confidence FROM ({_DETAILS}) WHERE relationship_type = 'CONTRADICTS' AND confidence >= 0.8")
def relationships_filtered(spark: SparkSession, d: str) -> DataFrame:
    got = api.where_relationships(api.relationship_details(_pairs(spark, d), table(spark, d, "facts")), "CONTRADICTS", 0.8)
    return got.select("relationship_id", "relationship_type", "confidence")


ISSUES = f"""issues AS (
SELECT 'EMPTY_PAGE:' || doc_id AS issue_id, 'EMPTY_PAGE' AS issue_type, 'PARSING' AS stage, 'WARNING' AS severity, document_id, NULL::VARCHAR AS fact_id FROM documents WHERE text IS NULL OR regexp_replace(text, '\\s+', '', 'g') = ''
UNION ALL SELECT 'LOW_FACT_CONFIDENCE:' || fact_id, 'LOW_FACT_CONFIDENCE', 'EXTRACTING', 'INFO', document_id, fact_id FROM facts WHERE confidence < 0.65
UNION ALL SELECT DISTINCT 'EVIDENCE_NOT_FOUND:' || evidence_id, 'EVIDENCE_NOT_FOUND', 'EVIDENCE', 'WARNING', document_id, fact_id FROM evidence WHERE start_char IS NULL
UNION ALL SELECT 'NORMALIZATION_FAILURE:' || fact_id, 'NORMALIZATION_FAILURE', 'NORMALIZING', 'WARNING', document_id, fact_id FROM facts WHERE normalized_number IS NULL
UNION ALL SELECT 'AMBIGUOUS_ENTITY:' || fact_id, 'AMBIGUOUS_ENTITY', 'ENTITY_RESOLUTION', 'WARNING', document_id, fact_id FROM facts WHERE entity_id IS NULL
UNION ALL SELECT DISTINCT 'EMBEDDING_FAILURE:' || v.fact_id, 'EMBEDDING_FAILURE', 'EMBEDDING', 'ERROR', f.document_id, v.fact_id FROM fact_embeddings v JOIN facts f USING (fact_id)
 WHERE NOT coalesce(len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0, false))"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return api.issues(table(spark, d, "documents"), table(spark, d, "facts"), table(spark, d, "evidence"), table(spark, d, "fact_embeddings"), DIMS)


@query(f"WITH {ISSUES} SELECT * FROM issues")
def issues_all(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d)


@query(f"WITH {ISSUES} SELECT issue_id, document_id FROM issues WHERE lower(stage) = 'embedding' AND severity = 'ERROR'")
def issues_filtered(spark: SparkSession, d: str) -> DataFrame:
    return api.where_issues(_issues(spark, d), stage="embedding", severity="ERROR").select("issue_id", "document_id")


@query(f"WITH {ISSUES} SELECT i.issue_id, i.issue_type, d.filename, f.chunk_id, f.predicate_canonical, e.canonical_name FROM issues i JOIN documents d USING (document_id) LEFT JOIN facts f ON f.fact_id = i.fact_id LEFT JOIN entities e ON e.entity_id = f.entity_id")
def issue_details(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "facts").select("fact_id", "chunk_id", "predicate_canonical", "entity_id")
    return (_issues(spark, d).join(table(spark, d, "documents").select("document_id", "filename"), "document_id").join(facts, "fact_id", "left")
            .join(table(spark, d, "entities").select("entity_id", "canonical_name"), "entity_id", "left").select("issue_id", "issue_type", "filename", "chunk_id", "predicate_canonical", "canonical_name"))


@query(f"""WITH {PAIRS}, {ISSUES} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM facts) AS facts, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM issues) AS issues,
count(*) FILTER (relationship_type = 'CORROBORATES') AS corroborates, count(*) FILTER (relationship_type = 'CONTRADICTS') AS contradicts, count(*) FILTER (relationship_type = 'RECONCILABLE') AS reconcilable,
count(*) FILTER (relationship_type = 'UNCERTAIN') AS uncertain FROM pairs""")
def knowledge_summary(spark: SparkSession, d: str) -> DataFrame:
    return api.summary(table(spark, d, "documents"), table(spark, d, "facts"), table(spark, d, "entities"), _issues(spark, d), _pairs(spark, d))


@query(f"""WITH {PAIRS}, {ISSUES}, r AS (SELECT document_id, count(DISTINCT relationship_id || '|' || left_fact_id) AS n FROM
(SELECT p.relationship_id, p.left_fact_id, f.document_id FROM pairs p JOIN facts f ON f.fact_id = p.left_fact_id UNION SELECT p.relationship_id, p.left_fact_id, f.document_id FROM pairs p JOIN facts f ON f.fact_id = p.right_fact_id) GROUP BY 1)
SELECT d.document_id, (SELECT count(*) FROM facts f WHERE f.document_id = d.document_id) AS n_facts, coalesce(r.n, 0) AS n_relationships, (SELECT count(*) FROM issues i WHERE i.document_id = d.document_id) AS n_issues
FROM documents d LEFT JOIN r USING (document_id)""")
def document_detail_counts(spark: SparkSession, d: str) -> DataFrame:
    return api.document_counts(table(spark, d, "documents"), table(spark, d, "facts"), _pairs(spark, d), _issues(spark, d))


@query("SELECT document_id, count(*) FILTER (confidence >= 0.65) AS eligible, count(*) FILTER (confidence < 0.65) AS low FROM facts GROUP BY 1")
def confidence_partition(spark: SparkSession, d: str) -> DataFrame:
    good, low = by_confidence(table(spark, d, "facts"))
    a = good.groupBy("document_id").agg(F.count(F.lit(1)).alias("eligible"))
    b = low.groupBy("document_id").agg(F.count(F.lit(1)).alias("low"))
    zero = F.lit(0).cast("bigint")
    return a.join(b, "document_id", "full").select("document_id", F.coalesce("eligible", zero).alias("eligible"), F.coalesce("low", zero).alias("low"))


# --- entities ---------------------------------------------------------------------------------

_SUFFIXES = "private limited|pvt limited|pvt ltd|public limited|incorporated|corporation|company|limited|llc|corp|ltd|inc|co"
NAMES = rf"""raw AS (SELECT fact_id, subject_type AS type, created_at, trim(regexp_replace(lower(trim(regexp_replace({nfkc_sql('subject_raw')}, '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS clean
FROM facts WHERE entity_id IS NULL),
names AS (SELECT name, type, count(*) AS n FROM (SELECT CASE WHEN coalesce(type, 'ORGANIZATION') = 'ORGANIZATION' THEN regexp_replace(clean, '(?:(?:^| )(?:{_SUFFIXES}))+$', '') ELSE clean END AS name, type FROM raw) WHERE name <> '' GROUP BY 1, 2)"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    return en.mentions(table(spark, d, "facts"))


@query(f"WITH {NAMES} SELECT name, type, arg_min(a.entity_id, (a.created_at, a.alias_id, a.entity_id)) AS entity_id FROM names n JOIN entity_aliases a ON a.normalized_alias = n.name JOIN entities e ON e.entity_id = a.entity_id AND e.entity_type = n.type GROUP BY 1, 2")
def entity_alias_exact(spark: SparkSession, d: str) -> DataFrame:
    return en.alias_exact(_names(spark, d), table(spark, d, "entities"), table(spark, d, "entity_aliases"))


@query(f"WITH {NAMES} SELECT n.name, n.type, e.entity_id FROM names n JOIN entities e ON e.normalized_name = n.name AND e.entity_type = n.type")
def entity_canonical_exact(spark: SparkSession, d: str) -> DataFrame:
    return en.canonical_exact(_names(spark, d), table(spark, d, "entities"))


GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH {NAMES}, k AS (SELECT entity_id, normalized_name AS other, entity_type AS type FROM entities UNION SELECT a.entity_id, a.normalized_alias, e.entity_type FROM entity_aliases a JOIN entities e USING (entity_id)),
ng AS (SELECT name, type, {GRAMS.format('name')} AS g FROM names), kg AS (SELECT entity_id, type, {GRAMS.format('other')} AS h FROM k WHERE other IS NOT NULL),
s AS (SELECT name, type, entity_id, max(round(len(list_intersect(g, h))::DOUBLE / (len(g) + len(h) - len(list_intersect(g, h))), 6)) AS similarity FROM ng JOIN kg USING (type) GROUP BY 1, 2, 3)
SELECT name, type, entity_id, similarity, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY name, s.type ORDER BY similarity DESC, e.created_at, s.entity_id)::INT AS rank FROM s JOIN entities e USING (entity_id) WHERE similarity >= 0.3) WHERE rank <= 5""")
def entity_trigram_candidates(spark: SparkSession, d: str) -> DataFrame:
    return en.trigram_candidates(_names(spark, d), table(spark, d, "entities"), table(spark, d, "entity_aliases"))


@query()
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    return en.resolve(table(spark, d, "facts"), table(spark, d, "entities"), table(spark, d, "entity_aliases"))


@query()
def learned_aliases(spark: SparkSession, d: str) -> DataFrame:
    facts, aliases = table(spark, d, "facts"), table(spark, d, "entity_aliases")
    return en.learned_aliases(en.resolve(facts, table(spark, d, "entities"), aliases), facts, aliases).select("entity_id", "normalized_alias", "alias", "document_id", "confidence")


# --- vectors ----------------------------------------------------------------------------------

@query(f"SELECT fact_id, model, coalesce(len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0, false) AS valid, len(embedding)::INT AS size FROM fact_embeddings")
def embedding_validation(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "fact_embeddings")
    return v.select("fact_id", "model", valid_vector(F.col("embedding"), DIMS).alias("valid"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("size"))


@query(f"""WITH t AS ({_COMPARED})
SELECT fact_id FROM t WHERE comparison_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fact_embeddings v WHERE v.fact_id = t.fact_id AND v.comparison_text = t.comparison_text AND v.model = 'finvec-2' AND v.dimensions = 128)""")
def embedding_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    wanted = comparison_texts(spark, d).where("error is null").drop("error").withColumn("model", F.lit("finvec-2")).withColumn("dimensions", F.lit(DIMS))
    return cache_misses(wanted, table(spark, d, "fact_embeddings")).select("fact_id")


@query("""
WITH old AS (SELECT * FROM fact_embeddings WHERE model <> 'finvec-2'), new AS (SELECT * FROM fact_embeddings WHERE model = 'finvec-2'),
u AS (SELECT fact_id, model, created_at FROM old WHERE fact_id NOT IN (SELECT fact_id FROM new) UNION ALL SELECT fact_id, arg_max(model, created_at), max(created_at) FROM new GROUP BY 1)
SELECT fact_id, model, created_at::VARCHAR AS created_at FROM u""")
def embedding_upsert(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "fact_embeddings").select("fact_id", "model", "created_at")
    got = st.keyed_upsert(v.where("model <> 'finvec-2'"), v.where("model = 'finvec-2'"), ["fact_id"], "created_at")
    return got.select("fact_id", "model", F.col("created_at").cast("string").alias("created_at"))


@query("""
WITH old AS (SELECT * FROM entity_aliases WHERE created_at <= (SELECT quantile_disc(created_at, 0.5) FROM entity_aliases)), new AS (SELECT * FROM entity_aliases WHERE created_at > (SELECT quantile_disc(created_at, 0.3) FROM entity_aliases)),
first AS (SELECT entity_id, normalized_alias, arg_min(alias, (created_at, alias_id)) AS alias FROM new GROUP BY 1, 2)
SELECT entity_id, normalized_alias, alias, 'old' AS origin FROM old UNION ALL SELECT entity_id, normalized_alias, alias, 'new' FROM first f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.entity_id = f.entity_id AND o.normalized_alias = f.normalized_alias)""")
def alias_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of a later delivery, part of which is stored already: the first writer of a key wins."""
    a = table(spark, d, "entity_aliases").select("entity_id", "normalized_alias", "alias", F.struct("created_at", "alias_id").alias("at"))
    micros = F.unix_micros(F.col("at.created_at").cast("timestamp"))
    ranked = a.select(micros.alias("t")).agg(F.expr("percentile_disc(0.5) within group (order by t)").alias("m5"), F.expr("percentile_disc(0.3) within group (order by t)").alias("m3"))
    middle = ranked.select(*[F.timestamp_micros(F.col(m).cast("bigint")).alias(m) for m in ("m5", "m3")])
    dated = a.crossJoin(F.broadcast(middle))  # one row
    old = dated.where("at.created_at <= m5").drop("m5", "m3").withColumn("origin", F.lit("old"))
    new = dated.where("at.created_at > m3").drop("m5", "m3").withColumn("origin", F.lit("new"))
    return st.insert_if_absent(old, new, ["entity_id", "normalized_alias"], "at").select("entity_id", "normalized_alias", "alias", "origin")


@query(f"WITH {PAIRS}, old AS (SELECT * FROM pairs WHERE relationship_type <> 'UNCERTAIN'), new AS (SELECT left_fact_id, right_fact_id, 'RECONCILABLE' AS relationship_type, 0.85::DOUBLE AS confidence, relationship_id FROM pairs WHERE relationship_type IN ('UNCERTAIN', 'CONTRADICTS')) "
       "SELECT * FROM new UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.left_fact_id = o.left_fact_id AND n.right_fact_id = o.right_fact_id)")
def relationship_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Pairs judged anew replace the stored judgement of the same pair; pairs never stored are added."""
    pairs = _pairs(spark, d).select("left_fact_id", "right_fact_id", "relationship_type", "confidence", "relationship_id")
    new = pairs.where("relationship_type in ('UNCERTAIN', 'CONTRADICTS')").withColumn("relationship_type", F.lit("RECONCILABLE")).withColumn("confidence", F.lit(0.85))
    return st.keyed_upsert(pairs.where("relationship_type <> 'UNCERTAIN'"), new, ["left_fact_id", "right_fact_id"], "relationship_id")


@query("""
WITH old AS (SELECT * FROM facts WHERE extraction_method = (SELECT min(extraction_method) FROM facts)), e AS (SELECT f.document_id, e.evidence_id, e.fact_id FROM (SELECT DISTINCT evidence_id, fact_id FROM evidence) e JOIN facts f USING (fact_id))
SELECT f.document_id, count(*) AS facts_received, count(*) FILTER (f.fact_id NOT IN (SELECT fact_id FROM old)) AS facts_inserted,
(SELECT count(*) FROM e WHERE e.document_id = f.document_id AND e.fact_id NOT IN (SELECT fact_id FROM old)) AS evidence_inserted FROM facts f GROUP BY 1""")
def facts_insert_counts(spark: SparkSession, d: str) -> DataFrame:
    """A whole delivery of facts and evidence against a store that has part of the facts: what was new, by document."""
    f, e = table(spark, d, "facts"), table(spark, d, "evidence").select("evidence_id", "fact_id").distinct()
    old = f.join(F.broadcast(f.agg(F.min("extraction_method").alias("extraction_method"))), "extraction_method", "left_semi").select("fact_id")
    return st.insert_counts(f.select("fact_id", "document_id"), e, old)


@query("""WITH n AS (SELECT *, lower(normalized_name) AS k FROM entities) SELECT entity_id, normalized_name, entity_type FROM n
QUALIFY row_number() OVER (PARTITION BY split_part(k, ' ', 1), entity_type ORDER BY created_at, entity_id) = 1""")
def entity_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Entities inserted in order of creation under the first word of their name: the first writer of a key stays."""
    e = table(spark, d, "entities").select("entity_id", "normalized_name", "entity_type", F.element_at(F.split(F.lower("normalized_name"), " "), 1).alias("k"), F.struct("created_at", "entity_id").alias("at"))
    old = e.groupBy("k", "entity_type").agg(F.min_by(F.struct("entity_id", "normalized_name", "at"), "at").alias("x")).select("x.entity_id", "x.normalized_name", "entity_type", "k", "x.at").where("entity_type = 'ORGANIZATION'")
    return st.insert_if_absent(old, e, ["k", "entity_type"], "at").select("entity_id", "normalized_name", "entity_type")


@query("""
WITH late AS (SELECT DISTINCT document_id FROM evidence WHERE ingested_at > created_at + INTERVAL 1 DAY)
SELECT evidence_id, count(*) AS n, min(version) AS version FROM (SELECT evidence_id, document_id, 'old' AS version FROM evidence WHERE document_id NOT IN (SELECT document_id FROM late)
UNION ALL SELECT evidence_id, document_id, 'new' FROM evidence WHERE document_id IN (SELECT document_id FROM late)) GROUP BY 1""")
def replace_by_document(spark: SparkSession, d: str) -> DataFrame:
    """Documents with late evidence are processed anew; all their rows are replaced."""
    e = table(spark, d, "evidence")
    late = e.where(F.col("ingested_at") > F.col("created_at") + F.expr("INTERVAL 1 DAY")).select("document_id").distinct()
    old = e.select("evidence_id", "document_id", F.lit("old").alias("version"))
    new = e.join(late, "document_id", "left_semi").select("evidence_id", "document_id", F.lit("new").alias("version"))
    return st.replace_by(old, new, "document_id").groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n"), F.min("version").alias("version"))


@query("""
WITH gone AS (SELECT document_id FROM documents WHERE status = (SELECT max(status) FROM documents)), lost AS (SELECT fact_id FROM facts WHERE document_id IN (SELECT document_id FROM gone))
SELECT 'documents' AS name, count(*) AS n FROM documents WHERE document_id NOT IN (SELECT document_id FROM gone)
UNION ALL SELECT 'facts', count(*) FROM facts WHERE fact_id NOT IN (SELECT fact_id FROM lost)
UNION ALL SELECT 'evidence', count(*) FROM evidence WHERE fact_id NOT IN (SELECT fact_id FROM lost)
UNION ALL SELECT 'fact_embeddings', count(*) FROM fact_embeddings WHERE fact_id NOT IN (SELECT fact_id FROM lost)
UNION ALL SELECT 'fact_relationships', count(*) FROM fact_relationships WHERE coalesce(left_fact_id NOT IN (SELECT fact_id FROM lost), true) AND coalesce(right_fact_id NOT IN (SELECT fact_id FROM lost), true)
UNION ALL SELECT 'entity_aliases', count(document_id) FROM entity_aliases WHERE document_id NOT IN (SELECT document_id FROM gone)""")
def cascade_delete_effect(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("document_id", "status")
    gone = docs.join(F.broadcast(docs.agg(F.max("status").alias("status"))), "status", "left_semi")
    names = ["facts", "evidence", "fact_embeddings", "fact_relationships", "entity_aliases"]
    left = st.cascade(docs, gone, {n: table(spark, d, n) for n in names})
    out = None
    for name, rows in left.items():
        n = F.count("document_id") if name == "entity_aliases" else F.count(F.lit(1))
        one = rows.agg(n.alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- candidates and decisions -----------------------------------------------------------------

_CANDIDATES = f"""WITH good AS (SELECT fact_id, arg_max(embedding, (created_at, model)) AS v FROM fact_embeddings
WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
r AS (SELECT f.fact_id, document_id, entity_id, subject_normalized AS subject, predicate_canonical AS predicate, value_type, created_at, v FROM facts f JOIN good USING (fact_id)),
g AS (SELECT subject, {GRAMS.format('subject')} AS g FROM (SELECT DISTINCT subject FROM r)),
sp AS (SELECT a.subject AS s1, b.subject AS s2 FROM g a JOIN g b ON round(len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) >= 0.85),
m AS (SELECT s.fact_id AS source_id, c.fact_id AS candidate_id, list_cosine_similarity(s.v::DOUBLE[], c.v::DOUBLE[]) AS similarity, coalesce(s.predicate = c.predicate, false) AS direct, c.created_at, s.value_type = c.value_type AS st, false AS by_subject
 FROM r s JOIN r c ON s.entity_id = c.entity_id AND s.document_id <> c.document_id
 UNION ALL SELECT s.fact_id, c.fact_id, list_cosine_similarity(s.v::DOUBLE[], c.v::DOUBLE[]), false, c.created_at, s.value_type = c.value_type, true
 FROM r s JOIN sp ON s.subject = sp.s1 JOIN r c ON c.subject = sp.s2 WHERE s.entity_id IS NULL AND s.document_id <> c.document_id),
k AS (SELECT * FROM m WHERE (NOT by_subject AND (direct OR (st AND similarity >= 0.62))) OR (by_subject AND st AND similarity >= 0.72))
SELECT source_id, candidate_id, round(similarity, 6) AS similarity, CASE WHEN by_subject THEN 'UNRESOLVED_SUBJECT_VECTOR' WHEN direct THEN 'ENTITY_PREDICATE' ELSE 'ENTITY_VECTOR' END AS match_reason, rank
FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY direct DESC, similarity DESC, created_at, candidate_id)::INT AS rank FROM k) WHERE rank <= 10"""


@query(_CANDIDATES)
def candidate_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return cd.retrieve(table(spark, d, "facts"), table(spark, d, "fact_embeddings"), DIMS)


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return rl.paired(_pairs(spark, d).select("left_fact_id", "right_fact_id"), table(spark, d, "facts"))


_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_NUMBERS = " ".join(f"WHEN '{m}' THEN '{i + 1:02d}'" for i, m in enumerate(_MONTHS.split("|")))
#: Kind of a period label, by the forms in their order; dates the calendar lacks are no dates.
PERIOD_KIND = f"""(CASE WHEN coalesce(trim({{0}}), '') = '' THEN 'UNKNOWN'
WHEN TRY_CAST(CASE WHEN regexp_matches(lower(trim({{0}})), '^\\d{{{{4}}}}-\\d{{{{1,2}}}}-\\d{{{{1,2}}}}$') THEN trim({{0}})
 WHEN regexp_matches(lower(trim({{0}})), '^\\d{{{{1,2}}}} ({_MONTHS}) \\d{{{{4}}}}$') THEN split_part(trim({{0}}), ' ', 3) || '-' || (CASE split_part(lower(trim({{0}})), ' ', 2) {_NUMBERS} END) || '-' || lpad(split_part(trim({{0}}), ' ', 1), 2, '0')
 WHEN regexp_matches(lower(trim({{0}})), '^({_MONTHS}) \\d{{{{1,2}}}},? \\d{{{{4}}}}$') THEN split_part(trim({{0}}), ' ', 3) || '-' || (CASE split_part(lower(trim({{0}})), ' ', 1) {_NUMBERS} END) || '-' || lpad(replace(split_part(trim({{0}}), ' ', 2), ',', ''), 2, '0') END AS DATE) IS NOT NULL THEN 'EXACT_DATE'
WHEN regexp_matches(lower(trim({{0}})), '^as of .') THEN 'AS_OF' WHEN regexp_matches(lower(trim({{0}})), '^q[1-4]\\s*((fiscal year|fy)\\s*)?(\\d{{{{4}}}}|\\d{{{{2}}}})$') THEN 'QUARTER'
WHEN regexp_matches(lower(trim({{0}})), '^h[12]\\s*((fiscal year|fy)\\s*)?(\\d{{{{4}}}}|\\d{{{{2}}}})$') THEN 'HALF_YEAR' WHEN regexp_matches(lower(trim({{0}})), '^(fiscal year|fy)\\s*(\\d{{{{4}}}}|\\d{{{{2}}}})$') THEN 'FISCAL_YEAR'
WHEN regexp_matches(lower(trim({{0}})), '^(calendar year )?\\d{{{{4}}}}$') THEN 'CALENDAR_YEAR' WHEN regexp_matches(lower(trim({{0}})), '^({_MONTHS}) \\d{{{{4}}}}$') THEN 'MONTH' ELSE 'UNKNOWN' END)"""
_CONCEPT = "array_to_string(list_filter(string_split({0}, '_'), lambda t: t <> '' AND NOT regexp_matches(t, '^(annual|quarterly|reported|profit|loss|positive|negative|fy\\d{{2}}(\\d{{2}})?|q[1-4]|\\d{{4}})$')), '_')"
PAIRED = f"""{PAIRS}, v AS (SELECT fact_id, document_id, entity_id, subject_normalized AS subject, predicate_canonical AS predicate, {_CONCEPT.format('predicate_canonical')} AS concept, value_type, normalized_number::DOUBLE AS number, unit, currency,
CASE WHEN value_type NOT IN ('MONEY', 'PERCENTAGE', 'NUMBER', 'QUANTITY') AND NOT regexp_matches(trim(value_raw), '(?i)^[+-]?\\d+(?:\\.\\d+)?\\s*x$') THEN lower(regexp_replace(trim(value_raw), '\\s+', ' ', 'g')) END AS text,
{PERIOD_KIND.format('normalized_context.time_label')} AS kind, coalesce(normalized_context.time_label, json_extract_string(qualifiers, '$.reportingPeriod'), json_extract_string(qualifiers, '$.reporting_period'), json_extract_string(qualifiers, '$.period')) AS period,
normalized_context.scope AS scope, normalized_context.geography AS geography, normalized_context.basis AS basis FROM facts),
j AS (SELECT l.fact_id AS l_fact_id, r.fact_id AS r_fact_id, l.document_id AS l_document_id, l.document_id = r.document_id AS same_document,
(coalesce(l.entity_id = r.entity_id, false) OR coalesce(l.subject = r.subject, false)) AND l.value_type = r.value_type AND coalesce(l.predicate = r.predicate OR (l.concept <> '' AND l.concept = r.concept), false) AS compatible,
CASE WHEN greatest(abs(l.number), abs(r.number)) = 0 THEN 0 ELSE abs(abs(l.number) - abs(r.number)) / greatest(abs(l.number), abs(r.number)) END AS gap, l.number IS NULL OR r.number IS NULL AS bare, l.text = r.text AS same_text,
l.kind = r.kind AND l.period IS NOT DISTINCT FROM r.period AND l.scope IS NOT DISTINCT FROM r.scope AS same, l.currency IS NOT DISTINCT FROM r.currency AND l.unit IS NOT DISTINCT FROM r.unit AS same_unit,
coalesce(l.number::DECIMAL(38,6)::VARCHAR, l.text) AS l_value, coalesce(r.number::DECIMAL(38,6)::VARCHAR, r.text) AS r_value,
coalesce(l.currency <> r.currency, false) AS dc, coalesce(l.period <> r.period, false) AS dp, coalesce(l.scope <> r.scope, false) AS ds, coalesce(l.geography <> r.geography, false) AS dg, coalesce(l.basis <> r.basis, false) AS db,
l.period AS l_period, r.period AS r_period, l.scope AS l_scope, r.scope AS r_scope, l.currency AS l_currency, r.currency AS r_currency
FROM pairs p JOIN v l ON l.fact_id = p.left_fact_id JOIN v r ON r.fact_id = p.right_fact_id),
e AS (SELECT *, CASE WHEN bare THEN same_text ELSE gap <= 0.005 END AS equal FROM j),
c AS (SELECT *, equal IS NULL AS missing, compatible AND same AND (bare OR same_unit) AND coalesce(equal, false) AS rule FROM e),
o AS (SELECT *, CASE WHEN same_document THEN 'SAME_DOCUMENT' WHEN NOT compatible THEN 'INCOMPATIBLE' END AS skipped,
CASE WHEN dc THEN 'UNCERTAIN' WHEN dp THEN 'RECONCILABLE' WHEN ds OR dg OR db THEN 'RECONCILABLE' WHEN missing THEN 'UNCERTAIN' WHEN equal THEN 'CORROBORATES' ELSE 'CONTRADICTS' END AS said,
CASE WHEN dc THEN 0.65 WHEN dp THEN 0.95 WHEN ds OR dg OR db THEN 0.85 WHEN missing THEN 0.5 WHEN equal THEN 0.8 ELSE 0.95 END::DOUBLE AS sure,
CASE WHEN dc THEN 'currency' WHEN dp THEN 'period' WHEN ds THEN 'scope' WHEN dg THEN 'geography' WHEN db THEN 'basis' ELSE 'value' END AS why FROM c),
decided AS (SELECT l_fact_id, r_fact_id, l_document_id, skipped, CASE WHEN skipped IS NULL THEN CASE WHEN rule THEN 'CORROBORATES' WHEN sure < 0.6 THEN 'UNCERTAIN' ELSE said END END AS outcome,
CASE WHEN skipped IS NULL THEN CASE WHEN rule THEN 1.0 ELSE sure END END::DOUBLE AS decided_confidence, CASE WHEN skipped IS NULL AND NOT rule THEN why END AS decisive, CASE WHEN skipped IS NULL THEN CASE WHEN rule THEN 'RULE' ELSE 'REASONER' END END AS method FROM o)"""


@query(f"WITH {PAIRED} SELECT l_fact_id, r_fact_id FROM c WHERE rule")
def rule_corroboration(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d).where(rl.corroborated()).select("l_fact_id", "r_fact_id")


@query(f"WITH {PAIRED} SELECT l_fact_id, r_fact_id, skipped, outcome, decided_confidence, decisive, method FROM decided")
def relationship_decisions(spark: SparkSession, d: str) -> DataFrame:
    return rl.decide(_paired(spark, d)).select("l_fact_id", "r_fact_id", "skipped", "outcome", "decided_confidence", "decisive", "method")


@query(f"""WITH {PAIRED} SELECT l_document_id AS document_id, count(*) AS evaluated, count(*) FILTER (skipped IS NOT NULL) AS skipped, count(*) FILTER (outcome = 'CORROBORATES') AS corroborates,
count(*) FILTER (outcome = 'CONTRADICTS') AS contradicts, count(*) FILTER (outcome = 'RECONCILABLE') AS reconcilable, count(*) FILTER (outcome = 'UNCERTAIN') AS uncertain FROM decided GROUP BY 1""")
def relationship_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    decided = rl.decide(_paired(spark, d))
    kinds = ["CORROBORATES", "CONTRADICTS", "RECONCILABLE", "UNCERTAIN"]
    return decided.groupBy(F.col("l_document_id").alias("document_id")).agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"), *[F.count_if(F.coalesce(F.col("outcome") == k, F.lit(False))).alias(k.lower()) for k in kinds])


@query(f"""WITH {PAIRED} SELECT l_fact_id, r_fact_id, dimension, fact_a, fact_b, CASE WHEN fact_a IS NOT DISTINCT FROM fact_b THEN 'SAME' WHEN dimension = 'value' THEN 'CONFLICTS' ELSE 'EXPLAINS_DIFFERENCE' END AS effect FROM
(SELECT l_fact_id, r_fact_id, 'time' AS dimension, l_period AS fact_a, r_period AS fact_b FROM c UNION ALL SELECT l_fact_id, r_fact_id, 'scope', l_scope, r_scope FROM c UNION ALL SELECT l_fact_id, r_fact_id, 'currency', l_currency, r_currency FROM c
UNION ALL SELECT l_fact_id, r_fact_id, 'value', l_value, r_value FROM c)""")
def context_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rl.context_rows(_paired(spark, d))


@query(f"""WITH {PAIRED} SELECT 'RELATIONSHIP_UNCERTAIN:' || l_fact_id || '|' || r_fact_id AS issue_id, 'RELATIONSHIP_UNCERTAIN' AS issue_type, 'RELATIONSHIP_REASONING' AS stage, 'WARNING' AS severity, l_document_id AS document_id, l_fact_id AS fact_id
FROM o WHERE skipped IS NULL AND NOT rule AND sure < 0.6""")
def relationship_issues(spark: SparkSession, d: str) -> DataFrame:
    """Judgements below the confidence gate, as issues."""
    return api.relationship_issues(rl.decide(_paired(spark, d)))


@query(f"WITH {PAIRED} SELECT l_fact_id, r_fact_id, outcome, decided_confidence AS confidence FROM decided WHERE method = 'REASONER'")
def reasoner_provider(spark: SparkSession, d: str) -> DataFrame:
    """Pairs the rule leaves open, judged by the pluggable reasoner (the offline one)."""
    open_ = rl.decide(_paired(spark, d)).where("method = 'REASONER'")
    return reason_pairs(open_, OfflineReasoner()).select("l_fact_id", "r_fact_id", "outcome", "confidence")


@query(f"""WITH n AS (SELECT canonical_name AS name, lead(canonical_name) OVER (ORDER BY entity_id) AS other FROM entities), g AS (SELECT name, other, {GRAMS.format('name')} AS a, {GRAMS.format('other')} AS b FROM n WHERE other IS NOT NULL)
SELECT name, other, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM g""")
def sql_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The named SQL function on neighbouring entities."""
    register_functions(spark)
    table(spark, d, "entities").createOrReplaceTempView("factloom_entities")
    return spark.sql("""SELECT name, other, round(similarity(name, other), 6) AS similarity
FROM (SELECT canonical_name AS name, lead(canonical_name) OVER (ORDER BY entity_id) AS other FROM factloom_entities) WHERE other IS NOT NULL""")


@query("""WITH v AS (SELECT fact_id, embedding, created_at, lead(embedding) OVER (PARTITION BY fact_id ORDER BY created_at, model) AS other FROM fact_embeddings)
SELECT fact_id, len(embedding)::INT AS dims, round(1 - list_cosine_similarity(embedding::DOUBLE[], other::DOUBLE[]), 6) AS distance FROM v WHERE len(embedding) = len(other) AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
AND len(list_filter(other, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(other, lambda x: x <> 0)) > 0""")
def sql_cosine_distance(spark: SparkSession, d: str) -> DataFrame:
    """The named SQL functions on the successive vectors of a fact."""
    register_functions(spark)
    table(spark, d, "fact_embeddings").withColumn("usable", usable_vector(F.col("embedding"))).createOrReplaceTempView("factloom_vectors")
    return spark.sql("""SELECT fact_id, vector_dims(embedding) AS dims, round(cosine_distance(embedding, other), 6) AS distance FROM
(SELECT fact_id, embedding, usable, lead(embedding) OVER w AS other, lead(usable) OVER w AS other_usable FROM factloom_vectors WINDOW w AS (PARTITION BY fact_id ORDER BY created_at, model))
WHERE usable AND other_usable AND size(embedding) = size(other)""")


@query(f"WITH {PAIRS} SELECT DISTINCT relationship_type FROM pairs")
def relationship_types(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("relationship_type").distinct()


@query("SELECT document_id, status FROM documents WHERE document_id NOT IN (SELECT document_id FROM facts WHERE chunk_id IS NOT NULL AND document_id IS NOT NULL)")
def documents_without_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which no chunk was ever made: their processing fails."""
    chunked = table(spark, d, "facts").where("chunk_id is not null").select("document_id").distinct()
    return table(spark, d, "documents").select("document_id", "status").join(chunked, "document_id", "left_anti")


@query(f"""WITH t AS ({_COMPARED}), s AS (SELECT t.fact_id, CASE WHEN comparison_text IS NULL THEN 'failed' WHEN EXISTS (SELECT 1 FROM fact_embeddings v WHERE v.fact_id = t.fact_id AND v.comparison_text = t.comparison_text
 AND v.model = 'finvec-2' AND v.dimensions = {DIMS}) THEN 'cached' ELSE 'wanted' END AS state FROM t)
SELECT f.document_id, count(*) FILTER (state = 'wanted') AS wanted, count(*) FILTER (state = 'cached') AS cached, count(*) FILTER (state = 'failed') AS failed FROM s JOIN facts f USING (fact_id) GROUP BY 1""")
def embedding_counters(spark: SparkSession, d: str) -> DataFrame:
    """What an embedding run would do, by document: vectors wanted, vectors cached, facts that cannot be compared."""
    texts = comparison_texts(spark, d)
    wanted = cache_misses(texts.where("error is null").drop("error").withColumn("model", F.lit("finvec-2")).withColumn("dimensions", F.lit(DIMS)), table(spark, d, "fact_embeddings"))
    state = texts.join(wanted.select("fact_id", F.lit(True).alias("miss")), "fact_id", "left").select(
        "fact_id", F.when(F.col("error").isNotNull(), "failed").when(F.col("miss"), "wanted").otherwise("cached").alias("state"))
    joined = state.join(table(spark, d, "facts").select("fact_id", "document_id"), "fact_id")
    return joined.groupBy("document_id").agg(*[F.count_if(F.col("state") == k).alias(k) for k in ("wanted", "cached", "failed")])


@query("""WITH q AS (SELECT DISTINCT evidence_id, fact_id, page_number, start_char, document_id FROM evidence)
SELECT document_id, page_number, evidence_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number NULLS FIRST, start_char NULLS FIRST, evidence_id, fact_id)::INT AS place FROM q""")
def evidence_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of each document in order of its place in the text."""
    rows = table(spark, d, "evidence").select("evidence_id", "fact_id", "page_number", "start_char", "document_id").distinct()
    order = Window.partitionBy("document_id").orderBy("page_number", "start_char", "evidence_id", "fact_id")
    return rows.select("document_id", "page_number", "evidence_id", F.row_number().over(order).alias("place"))
