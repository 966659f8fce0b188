"""Scalar expressions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from complyframe.constants import SUBSTANCE_SYNONYMS
from complyframe.functions import ids, scoring, text
from complyframe.operators import extract, impact, reconcile
from complyframe.operators.joins import salted_join
from complyframe.plans.joins import raw_names
from complyframe.plans.registry import query
from complyframe.plans.views import add_view


@query(
    "h01_slugify",
    """SELECT p_partkey AS product_id, TRIM(REGEXP_REPLACE(LOWER(CONCAT('  ', p_name, ' / ', p_brand, ' (', p_type, ')')),
         '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""",
)
def slugify(t):
    label = F.concat(F.lit("  "), "p_name", F.lit(" / "), "p_brand", F.lit(" ("), "p_type", F.lit(")"))
    return t.table("part").select(F.col("p_partkey").alias("product_id"), text.slugify(label).alias("slug"))


@query(
    "h02_name_key",
    r"""SELECT product_id, COALESCE(TRIM(REGEXP_REPLACE(LOWER(name), '\s+', ' ', 'g')), '') AS key FROM v_names""",
)
def name_key(t):
    return raw_names(t).select("product_id", text.name_key(F.col("name")).alias("key"))


@query(
    "h03_name_parts",
    r"""SELECT product_id, CAST(n - 1 AS INTEGER) AS position, TRIM(part) AS part FROM (
          SELECT product_id, UNNEST(parts) AS part, UNNEST(RANGE(1, LEN(parts) + 1)) AS n FROM (
            SELECT product_id, REGEXP_SPLIT_TO_ARRAY(COALESCE(TRIM(REGEXP_REPLACE(LOWER(name), '\s+', ' ', 'g')), ''),
              '[(),/]') AS parts FROM v_names))""",
)
def name_parts(t):
    parts = text.name_parts(text.name_key(F.col("name")))
    return raw_names(t).select("product_id", F.posexplode(parts).alias("position", "part"))


@query("h04_upper_origin", "SELECT p_partkey AS product_id, UPPER(CONCAT('n', CAST(p_size AS STRING))) AS origin FROM part")
def upper_origin(t):
    origin = F.upper(F.concat(F.lit("n"), F.col("p_size").cast("string")))
    return t.table("part").select(F.col("p_partkey").alias("product_id"), origin.alias("origin"))


@query("h05_marker_key", "SELECT event_id, CONCAT(event_type, ':', CAST(event_id AS STRING)) AS marker FROM events")
def marker_key(t):
    marker = ids.marker_key(F.col("event_type"), F.col("event_id").cast("string"))
    return t.table("events").select("event_id", marker.alias("marker"))


@query(
    "h06_prefixed_id",
    """SELECT event_id, CONCAT('evt_', SUBSTRING(SHA256(CONCAT(event_type, '|', CAST(event_id AS STRING))), 1, 12)) AS id
       FROM events""",
)
def prefixed_id(t):
    return t.table("events").select("event_id", ids.prefixed_id("evt", F.col("event_type"), F.col("event_id")).alias("id"))


@query("h07_content_hash", "SELECT doc_id, SHA256(text) AS content_sha256 FROM documents")
def content_hash(t):
    return t.table("documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_sha256"))


@query(
    "h08_cosine_similarity",
    """SELECT a.vec_id, ROUND(LIST_COSINE_SIMILARITY(a.v, b.v), 6) AS score FROM v_vectors a JOIN v_vectors b
       ON b.vec_id = a.vec_id + 1""",
)
def cosine_similarity(t):
    vectors = t.table("embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    score = F.round(scoring.cosine(F.col("embedding"), F.col("other")), 6)
    return vectors.join(following, "vec_id").select("vec_id", score.alias("score"))


@query("h09_composite_confidence", "SELECT clause_id, confidence FROM v_clauses")
def composite_confidence(t):
    return t.clauses().select("clause_id", "confidence")


@query(
    "h10_authority_tier",
    """SELECT source_type, authority_tier, COUNT(*) AS clauses FROM v_clauses GROUP BY 1, 2""",
)
def authority_tier(t):
    tiers = t.clauses().groupBy("source_type", scoring.authority_tier(F.col("source_type")).alias("authority_tier"))
    return tiers.agg(F.count(F.lit(1)).alias("clauses"))


@query(
    "h11_evaluation",
    """SELECT c.clause_id, i.amount_base, COALESCE(i.lines, 0) AS lines,
         CASE WHEN c.clause_type = 'numeric_limit' AND i.lines IS NULL
         THEN 'not_applicable' WHEN c.confidence < 0.5 OR c.clause_type <> 'numeric_limit' OR i.amount_base IS NULL
         THEN 'needs_review' WHEN i.amount_base <= c.limit_base THEN 'pass' ELSE 'fail' END AS evaluation
       FROM v_clauses c LEFT JOIN (SELECT substance, amount_base, COUNT(*) AS lines FROM v_ingredients GROUP BY 1, 2) i
         ON i.substance = c.substance""",
)
def evaluation(t):
    """Every clause against each amount that products list of its substance; not applicable where none does."""
    lines = t.ingredients().groupBy("substance", F.col("amount_base").alias("amount")).agg(F.count(F.lit(1)).alias("lines"))
    met = salted_join(t.clauses(), lines, ["substance"], ["clause_id"], "left")
    verdict = scoring.evaluation(
        F.col("lines").isNotNull(), F.col("confidence"), F.col("clause_type"), F.col("amount"), F.col("limit_base")
    )
    lines = F.coalesce("lines", F.lit(0)).alias("lines")
    return met.select("clause_id", F.col("amount").alias("amount_base"), lines, verdict.alias("evaluation"))


add_view(
    "v_latest_any",
    """SELECT * FROM v_clauses WHERE status IN ('active', 'superseded') QUALIFY ROW_NUMBER() OVER (
         PARTITION BY jurisdiction, substance, product_type, clause_type
         ORDER BY effective_date DESC, document_date DESC, clause_id DESC) = 1""",
)
add_view(
    "v_unresolved",
    """SELECT c.clause_id FROM v_latest_any c WHERE c.status = 'superseded' AND NOT EXISTS (SELECT 1 FROM v_active a
         WHERE a.jurisdiction = c.jurisdiction AND a.substance = c.substance AND a.product_type = c.product_type
           AND a.clause_type = c.clause_type)""",
)


@query(
    "h12_severity",
    """SELECT r.evaluation, COALESCE(CASE WHEN r.evaluation = 'fail' THEN 'high' WHEN r.evaluation = 'needs_review'
         OR u.clause_id IS NOT NULL THEN 'medium' END, 'none') AS severity, u.clause_id IS NOT NULL AS unresolved,
         COUNT(*) AS requirements
       FROM (SELECT p.product_id, p.market_id, c.clause_id, CASE WHEN c.confidence < 0.5 OR i.amount_base IS NULL
               THEN 'needs_review' WHEN i.amount_base <= c.limit_base THEN 'pass' ELSE 'fail' END AS evaluation
             FROM v_places p JOIN v_latest_any c ON c.jurisdiction = p.jurisdiction AND c.clause_type = 'numeric_limit'
             JOIN v_ingredients i ON i.product_id = p.product_id AND i.substance = c.substance) r
       LEFT JOIN v_unresolved u ON u.clause_id = r.clause_id GROUP BY 1, 2, 3""",
)
def severity(t):
    known = t.clauses().where("status IN ('active', 'superseded')")
    latest = reconcile.current_clauses(known).where("clause_type = 'numeric_limit'")
    required = impact.requirements(t.places(), t.ingredients(), latest)
    flagged = impact.unresolved(required, known)
    counts = flagged.groupBy("evaluation", F.coalesce("severity", F.lit("none")).alias("severity"), "unresolved")
    return counts.agg(F.count(F.lit(1)).alias("requirements"))


add_view(
    "v_patches",
    """SELECT p_partkey AS product_id, CASE WHEN p_size > 25 THEN UPPER(p_name) END AS name,
         CASE WHEN p_size < 20 THEN 'n0' END AS origin, CASE WHEN p_size % 4 = 0 THEN p_brand END AS packaging FROM part""",
)
add_view(
    "v_twins",
    """SELECT p_partkey AS product_id, p_name AS name, CONCAT('N', CAST(p_size % 25 AS STRING)) AS origin,
         CASE WHEN p_size % 3 = 0 THEN p_type END AS packaging FROM part""",
)


def twins(t):
    return t.table("part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("N"), (F.col("p_size") % 25).cast("string")).alias("origin"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("packaging"),
    )


def patches(t):
    size = F.col("p_size")
    return t.table("part").select(
        F.col("p_partkey").alias("product_id"),
        F.when(size > 25, F.upper("p_name")).alias("name"),
        F.when(size < 20, "n0").alias("origin"),
        F.when(size % 4 == 0, F.col("p_brand")).alias("packaging"),
    )


@query(
    "h15_log_record",
    """SELECT event_id, CONCAT('{"severity":"INFO","message":"', event_type, '","trace_id":"', trace_id,
         '","logger":"worker-', CAST(event_id % 4 AS STRING), '","entity":"', entity_id, '"}') AS line FROM v_events""",
)
def log_record(t):
    """An extra field of the same name as a base field wins."""
    extras = F.create_map(
        F.lit("logger"),
        F.concat(F.lit("worker-"), (F.col("event_id") % 4).cast("string")),
        F.lit("entity"),
        F.col("entity_id"),
    )
    line = scoring.log_record(F.lit("INFO"), F.col("event_type"), F.lit("api"), F.col("trace_id"), extras)
    return t.events().select("event_id", line.alias("line"))


@query(
    "h16_trace_id",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN SUBSTRING(SHA256(CONCAT(event_type, '|', CAST(event_id AS STRING))), 1, 32)
         ELSE CONCAT('trace_', CAST(event_id % 500 AS STRING)) END AS trace_id FROM events""",
)
def trace_id(t):
    given = F.when(F.col("event_id") % 3 == 0, "").otherwise(
        F.concat(F.lit("trace_"), (F.col("event_id") % 500).cast("string"))
    )
    minted = ids.trace_or_minted(given, F.col("event_type"), F.col("event_id"))
    return t.table("events").select("event_id", minted.alias("trace_id"))


_INTENT_SQL = " ".join(
    f"WHEN REGEXP_MATCHES(LOWER(question), '{pattern}') THEN '{name}'" for name, pattern in scoring.INTENT_KEYWORDS
)


@query(
    "h17_question_intent",
    f"""SELECT conv_id, turn, CASE {_INTENT_SQL} ELSE 'unknown' END AS intent FROM (
          SELECT conv_id, turn, CONCAT(text, CASE (conv_id + turn) % 6 WHEN 0 THEN ' Mengapa the pickles row is red?'
            WHEN 1 THEN ' Did the colouring rules get an update?' WHEN 2 THEN ' Are the biscuits ready for the fair?'
            WHEN 3 THEN ' How would you reformulate this jam?' WHEN 4 THEN ' Which limit holds for sorbate?' ELSE '' END) AS question
          FROM conversations WHERE role = 'user')""",
)
def question_intent(t):
    endings = (
        " Mengapa the pickles row is red?",
        " Did the colouring rules get an update?",
        " Are the biscuits ready for the fair?",
        " How would you reformulate this jam?",
        " Which limit holds for sorbate?",
        "",
    )
    ending = F.get(F.array(*[F.lit(e) for e in endings]), ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    asked = t.table("conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", scoring.question_intent(F.concat("text", ending)).alias("intent"))


@query(
    "h18_review_gate",
    "SELECT clause_id, (confidence < 0.5 OR authority_tier < 0.5) AS gated FROM v_clauses",
)
def review_gate(t):
    return reconcile.needs_review(t.clauses()).select("clause_id", "gated")


_ANY_CATEGORY = "|".join(pattern for _, pattern in extract.CATEGORIES)


@query(
    "h19_relevance",
    rf"""SELECT doc_id, COUNT(*) AS chunks, COUNT(*) FILTER (hit) AS relevant, CAST(SUM(LENGTH(part)) AS BIGINT) AS characters,
           CAST(COALESCE(SUM(LENGTH(part)) FILTER (hit), 0) AS BIGINT) AS kept_characters FROM (
             SELECT doc_id, part, REGEXP_MATCHES(LOWER(part), '{_ANY_CATEGORY}') AS hit FROM (
               SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS part FROM v_limit_docs)) GROUP BY 1""",
)
def relevance(t):
    found = extract.relevance(t.limit_docs(), "doc_id")
    return found.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in found.columns[1:]])


_CATEGORY_SQL = " ".join(f"WHEN REGEXP_MATCHES(LOWER(part), '{pattern}') THEN '{name}'" for name, pattern in extract.CATEGORIES)


@query(
    "h19_chunk_categories",
    f"""SELECT category, COUNT(*) AS chunks, COUNT(DISTINCT doc_id) AS documents FROM (
          SELECT doc_id, CASE {_CATEGORY_SQL} ELSE 'none' END AS category FROM (
            SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS part FROM v_limit_docs)) GROUP BY 1""",
)
def chunk_categories(t):
    cut = extract.chunks(t.limit_docs(), "doc_id").groupBy(F.coalesce("category", F.lit("none")).alias("category"), "doc_id")
    per_document = cut.agg(F.count(F.lit(1)).alias("chunks"))
    return per_document.groupBy("category").agg(F.sum("chunks").alias("chunks"), F.count(F.lit(1)).alias("documents"))


@query(
    "h20_limit_statements",
    """SELECT doc_id, CAST(ordinal AS INT) AS ordinal, raw_substance, substance, unnormalized, limit_value, raw_unit,
         COALESCE(unit, 'none') AS unit FROM v_candidates""",
)
def limit_statements(t):
    found = extract.candidates(t.limit_docs(), "doc_id").withColumn("unit", F.coalesce("unit", F.lit("none")))
    return found.select("doc_id", "ordinal", "raw_substance", "substance", "unnormalized", "limit_value", "raw_unit", "unit")


_MENTIONS_SQL = r"\b(" + "|".join(sorted(SUBSTANCE_SYNONYMS, key=lambda s: (-len(s), s))) + r")\b"
add_view(
    "v_messy_docs",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CONCAT(text, ' Katanya batas natrium benzoat dan gula lebih rendah.')
         WHEN doc_id % 5 = 1 THEN CONCAT(text, ' Kunyit, jahe (E330).') ELSE text END AS text FROM v_limit_docs""",
)


@query(
    "h21_vague_candidates",
    rf"""SELECT DISTINCT m.doc_id, s.canonical AS substance, 'needs_review' AS status FROM (
           SELECT doc_id, UNNEST(REGEXP_EXTRACT_ALL(LOWER(text), '{_MENTIONS_SQL}', 1)) AS spelling FROM v_messy_docs) m
         JOIN v_synonyms s ON s.synonym = m.spelling
         WHERE NOT EXISTS (SELECT 1 FROM v_candidates c WHERE c.doc_id = m.doc_id AND c.substance = s.canonical)""",
)
def vague_candidates(t):
    doc = F.col("doc_id")
    messy = F.when(doc % 5 == 0, F.concat("text", F.lit(" Katanya batas natrium benzoat dan gula lebih rendah."))).when(
        doc % 5 == 1, F.concat("text", F.lit(" Kunyit, jahe (E330)."))
    )
    documents = t.limit_docs().withColumn("text", F.coalesce(messy, "text"))
    return extract.vague_candidates(documents, "doc_id").drop("limit_value")
