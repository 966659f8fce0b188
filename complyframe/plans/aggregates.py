"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from complyframe.operators import counts as requirement_count
from complyframe.operators import extract, grounding, impact, metrics, reconcile, timeline, validate
from complyframe.plans.joins import query_log
from complyframe.plans.registry import query
from complyframe.plans.views import add_view

# From how the statements are put into the texts, not from how they are read.
add_view(
    "v_candidates",
    """SELECT c.doc_id, CAST(0 AS BIGINT) AS ordinal, c.raw_substance, c.limit_value, c.raw_unit, u.unit,
          COALESCE(s.canonical, TRIM(REGEXP_REPLACE(LOWER(c.raw_substance), '[^a-z0-9]+', '_', 'g'), '_')) AS substance,
          s.canonical IS NULL AS unnormalized
        FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sodium benzoate' WHEN 1 THEN 'natrium benzoat' WHEN 2 THEN 'E211'
                ELSE 'unlisted extract' END AS raw_substance, CAST(doc_id % 900 AS DECIMAL(18,6)) AS limit_value,
                CASE doc_id % 3 WHEN 0 THEN 'mg/kg' WHEN 1 THEN 'ppm' ELSE 'grams per gallon' END AS raw_unit FROM documents) c
        LEFT JOIN v_synonyms s ON s.synonym = LOWER(c.raw_substance) LEFT JOIN v_units u ON u.raw = LOWER(c.raw_unit)""",
)

SCOPE_SQL = "jurisdiction, substance, product_type, clause_type"
add_view("v_numeric", "SELECT * FROM v_live WHERE clause_type = 'numeric_limit' AND (status = 'active' OR NOT gated)")
add_view(
    "v_tied",
    """SELECT DISTINCT n.clause_id FROM v_numeric n JOIN (
         SELECT jurisdiction, substance, product_type, effective_date, document_date FROM v_numeric
         GROUP BY ALL HAVING MIN(limit_base) <> MAX(limit_base)) x
       ON n.jurisdiction = x.jurisdiction AND n.substance = x.substance AND n.product_type = x.product_type
         AND n.effective_date = x.effective_date AND n.document_date = x.document_date
       WHERE n.status = 'pending_reconciliation'""",
)
add_view(
    "v_pool",
    f"""SELECT *, FIRST_VALUE(limit_base) OVER (PARTITION BY {SCOPE_SQL}
          ORDER BY effective_date DESC, document_date DESC, clause_id DESC) AS current_limit
        FROM v_numeric WHERE clause_id NOT IN (SELECT clause_id FROM v_tied)""",
)
add_view(
    "v_judged",
    f"""SELECT *, MAX(CASE WHEN limit_base <> current_limit THEN 1 ELSE 0 END) OVER (PARTITION BY {SCOPE_SQL}
            ORDER BY effective_date, document_date, clause_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 1 AS replaced,
          LAG(limit_base) OVER w AS old_limit, LAG(clause_id) OVER w AS previous_id, LEAD(clause_id) OVER w AS next_id
        FROM v_pool WINDOW w AS (PARTITION BY {SCOPE_SQL} ORDER BY effective_date, document_date, clause_id)""",
)
add_view(
    "v_verdicts",
    """SELECT clause_id, status AS was, CASE WHEN replaced THEN 'superseded' ELSE 'active' END AS status,
         CASE WHEN status = 'active' THEN CASE WHEN replaced THEN 'superseded' ELSE 'unchanged' END
              WHEN limit_base <> old_limit THEN 'supersedes' WHEN replaced THEN 'superseded' ELSE 'new' END AS verdict,
         CASE WHEN limit_base <> old_limit THEN previous_id END AS supersedes,
         CASE WHEN replaced THEN next_id END AS superseded_by,
         CASE WHEN limit_base < old_limit THEN 'limit_tightened' WHEN limit_base > old_limit THEN 'limit_loosened' END AS change
       FROM v_judged
       UNION ALL SELECT clause_id, status, 'needs_review', 'needs_review', NULL, NULL, NULL FROM v_live
       WHERE status = 'pending_reconciliation' AND (gated OR clause_id IN (SELECT clause_id FROM v_tied))
       UNION ALL SELECT clause_id, status, 'active', CASE WHEN status = 'active' THEN 'unchanged' ELSE 'new' END, NULL, NULL, NULL
       FROM v_live WHERE clause_type <> 'numeric_limit' AND (status = 'active' OR NOT gated)""",
)


@query("d01_compliance_rollup", "SELECT product_id, market_id, status FROM v_status_full")
def compliance_rollup(t):
    return impact.product_status(t.places(), t.product_markets(), t.ingredients(), t.current())


@query("d01_compliance_rollup_of_recipes", "SELECT product_id, market_id, status FROM v_status_before")
def compliance_rollup_of_recipes(t):
    return t.status()


@query(
    "d02_issue_counts",
    """SELECT product_id, market_id, critical, to_review, passed, status, CONCAT(CAST(passed AS STRING), ' of ',
         CAST(critical + to_review + passed AS STRING)) AS checks_passed FROM v_status_before""",
    few_substances=True,
)
def issue_counts(t):
    counts = requirement_count.issue_counts(t.places(), t.product_markets(), t.ingredients(), t.current())
    total = (F.col("critical") + F.col("to_review") + F.col("passed")).cast("string")
    return counts.withColumn("checks_passed", F.concat(F.col("passed").cast("string"), F.lit(" of "), total))


@query(
    "d03_portfolio",
    """SELECT clause_id, COUNT(DISTINCT product_id) AS products, CASE MAX(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1
         ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'none' END AS worst FROM v_req_after GROUP BY 1""",
)
def portfolio(t):
    return impact.portfolio(impact.counted_requirements(t.places(), t.ingredients(), t.following(), of=["product_id"]))


@query(
    "d04_stage_funnel",
    """SELECT '1 uploaded' AS stage, COUNT(*) AS n FROM documents
       UNION ALL SELECT '2 extracted', COUNT(*) FROM v_candidates
       UNION ALL SELECT '3 clauses', COUNT(*) FROM v_pending
       UNION ALL SELECT '4 reconciled', COUNT(*) FROM v_verdicts WHERE was = 'pending_reconciliation' AND status <> 'needs_review'
       UNION ALL SELECT '5 evaluated', COUNT(*) FROM v_req_after
       UNION ALL SELECT '6 status changes', COUNT(*) FROM v_changes""",
    few_substances=True,
)
def stage_funnel(t):
    evaluated = requirement_count.requirement_counts(t.places(), t.ingredients(), t.following())
    decided = reconcile.verdicts(t.stored_clauses()).where("was = 'pending_reconciliation' AND status <> 'needs_review'")
    return metrics.funnel(
        {
            "1 uploaded": t.documents(),
            "2 extracted": extract.candidates(t.limit_docs(), "doc_id"),
            "3 clauses": t.pending(),
            "4 reconciled": decided,
            "6 status changes": impact.status_changes(t.status(), t.status(after=True)),
        },
        {"5 evaluated": evaluated.select(F.col("requirements").alias("n"))},
    )


add_view(
    "v_durations",
    """SELECT document_id, stage, seq, CAST(FLOOR(EPOCH(next_at)) AS BIGINT) - CAST(FLOOR(EPOCH("at")) AS BIGINT) AS seconds
       FROM (SELECT *, LEAD("at") OVER (PARTITION BY document_id ORDER BY "at", seq) AS next_at FROM v_stage_log)
       WHERE next_at IS NOT NULL""",
)


@query(
    "d05_stage_durations",
    """SELECT stage, n, MAX(CASE WHEN r = (50 * n + 99) // 100 THEN seconds END) AS p50,
         MAX(CASE WHEN r = (95 * n + 99) // 100 THEN seconds END) AS p95,
         stage = 'extracting' AND MAX(CASE WHEN r = (95 * n + 99) // 100 THEN seconds END) > 120 AS breach
       FROM (SELECT stage, seconds, ROW_NUMBER() OVER (PARTITION BY stage ORDER BY seconds) AS r,
               COUNT(*) OVER (PARTITION BY stage) AS n FROM v_durations) GROUP BY stage, n""",
)
def stage_durations(t):
    return metrics.duration_report(metrics.stage_durations(t.stage_log()))


@query(
    "d06_end_to_end_latency",
    """SELECT trace_id, seconds, COALESCE(seconds > 90, TRUE) AS breach FROM (
         SELECT b.trace_id, CAST(FLOOR(EPOCH(MIN(p.occurred_at))) AS BIGINT) - CAST(FLOOR(EPOCH(MIN(b.s))) AS BIGINT) AS seconds
         FROM (SELECT trace_id, MIN(occurred_at) AS s FROM v_events WHERE event_type = 'signup' GROUP BY 1) b
         LEFT JOIN v_events p ON p.trace_id = b.trace_id AND p.event_type = 'purchase' AND p.occurred_at >= b.s GROUP BY 1)""",
)
def end_to_end_latency(t):
    return metrics.end_to_end(t.events(), "signup", "purchase")


@query(
    "d07_rejections_by_reason",
    "SELECT decision AS reason, COUNT(*) AS pairs FROM v_pair_decisions WHERE decision <> 'comparable' GROUP BY 1",
    few_substances=True,
)
def rejections_by_reason(t):
    counts = reconcile.guardrail_counts(t.pending(), t.active()).where("decision <> 'comparable'")
    return counts.groupBy(F.col("decision").alias("reason")).agg(F.sum("pairs").alias("pairs"))


@query(
    "d08_ambiguity_rate",
    """SELECT substance, ROUND(CAST(COUNT(*) FILTER (same_jurisdiction AND NOT same_limit AND same_dates) AS DOUBLE)
         / COUNT(*), 6) AS ambiguity_rate FROM v_pair_decisions WHERE decision = 'comparable' GROUP BY 1""",
)
def ambiguity_rate(t):
    counts = reconcile.relationship_counts(t.pending(), t.active())
    return counts.select("substance", F.round(F.col("ambiguous") / F.col("comparable"), 6).alias("ambiguity_rate"))


@query(
    "d09_verdict_distribution",
    """SELECT verdict, COUNT(*) AS clauses FROM v_verdicts WHERE was = 'pending_reconciliation' GROUP BY 1
       UNION ALL SELECT 'conflict_in_one_jurisdiction', COUNT(*) FROM v_conflicts x
       JOIN v_current a ON a.clause_id = x.clause_a JOIN v_current b ON b.clause_id = x.clause_b
       WHERE a.jurisdiction = b.jurisdiction""",
    few_substances=True,
)
def verdict_distribution(t):
    """With the invariant spelled out as a row: conflicts never stay within a jurisdiction."""
    decided = reconcile.verdicts(t.stored_clauses()).where("was = 'pending_reconciliation'")
    counts = decided.groupBy("verdict").agg(F.count(F.lit(1)).alias("clauses"))
    places = t.current().select("clause_id", "jurisdiction")
    opened = reconcile.conflicts(t.current())
    for side in ("a", "b"):
        opened = opened.join(
            places.select(F.col("clause_id").alias(f"clause_{side}"), F.col("jurisdiction").alias(f"place_{side}")),
            f"clause_{side}",
        )
    wrong = opened.where("place_a = place_b").agg(F.count(F.lit(1)).alias("clauses"))
    return counts.unionByName(wrong.select(F.lit("conflict_in_one_jurisdiction").alias("verdict"), "clauses"))


@query(
    "d10_gauges",
    """SELECT 'dead_letters' AS gauge, COUNT(*) AS value FROM v_messages WHERE broken
       UNION ALL SELECT 'failed_documents', COUNT(*) FROM (SELECT document_id, stage FROM v_stage_log
         QUALIFY ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY "at" DESC, seq DESC) = 1) WHERE stage = 'failed'
       UNION ALL SELECT 'ungrounded_answers', COUNT(*) FROM (
         SELECT q.query_id FROM v_query_log q WHERE q.cited_count = 0 OR EXISTS (
           SELECT 1 FROM v_citations c LEFT JOIN v_current k ON k.clause_id = c.clause_id WHERE c.query_id = q.query_id
           AND (k.clause_id IS NULL OR c.clause_id < c.first_retrieved OR c.clause_id > c.first_retrieved + 9)))""",
)
def gauges(t):
    from complyframe.plans.sources import push_messages
    from complyframe.sources import messages

    decoded = messages.decode(push_messages(t).where("delivery = 1"))
    latest = timeline.latest(t.stage_log(), "document_id", ["stage"], "at", "seq")
    answers = grounding.check(query_log(t), t.current())
    return metrics.gauges(
        dead_letters=(decoded, F.col("problem").isNotNull()),
        failed_documents=(latest, F.col("stage") == "failed"),
        ungrounded_answers=(answers, F.col("outcome") != "grounded"),
    )


add_view(
    "v_calls",
    """SELECT event_type AS stage, CAST(ts AS DATE) AS day, CAST(JSON_EXTRACT(props, '$.k') AS BIGINT) AS prompt_tokens,
         user_id AS response_tokens, CAST(FLOOR(value * 100) AS BIGINT) AS latency_ms FROM events""",
)


def call_log(t):
    return t.table("events").select(
        F.col("event_type").alias("stage"),
        F.col("ts").alias("at"),
        F.get_json_object("props", "$.k").cast("bigint").alias("prompt_tokens"),
        F.col("user_id").alias("response_tokens"),
        F.floor(F.col("value") * 100).cast("bigint").alias("latency_ms"),
    )


@query(
    "d11_call_costs",
    """SELECT stage, day, n AS calls, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens,
         CAST(SUM(response_tokens) AS BIGINT) AS response_tokens, CAST(SUM(latency_ms) AS BIGINT) AS total_ms,
         MAX(CASE WHEN r = (95 * n + 99) // 100 THEN latency_ms END) AS p95_ms
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stage, day ORDER BY latency_ms) AS r,
               COUNT(*) OVER (PARTITION BY stage, day) AS n FROM v_calls) GROUP BY stage, day, n""",
)
def call_costs(t):
    return metrics.call_costs(call_log(t))


ACCURACY_FIELDS = ["substance", "limit_value", "unit"]
add_view(
    "v_expected",
    """SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN 'unlisted_extract' ELSE 'sodium_benzoate' END AS substance,
         CAST(doc_id % 900 AS DECIMAL(18,6)) AS limit_value, CASE doc_id % 5 WHEN 0 THEN 'ppm' ELSE 'mg_per_kg' END AS unit
       FROM documents""",
)
add_view(
    "v_accuracy",
    """SELECT e.doc_id, COALESCE(e.substance = c.substance, FALSE) AS substance_right,
         COALESCE(e.limit_value = c.limit_value, FALSE) AS limit_value_right, COALESCE(e.unit = c.unit, FALSE) AS unit_right
       FROM v_expected e LEFT JOIN v_candidates c ON c.doc_id = e.doc_id AND c.ordinal = 0""",
)


def expected_clauses(t):
    doc = F.col("doc_id")
    return t.table("documents").select(
        "doc_id",
        F.lit(0).alias("ordinal"),
        F.when(doc % 4 == 3, "unlisted_extract").otherwise("sodium_benzoate").alias("substance"),
        (doc % 900).cast("decimal(18,6)").alias("limit_value"),
        F.when(doc % 5 == 0, "ppm").otherwise("mg_per_kg").alias("unit"),
    )


def accuracy_rows(t):
    found = extract.candidates(t.limit_docs(), "doc_id")
    return extract.accuracy(expected_clauses(t), found, "doc_id", ACCURACY_FIELDS)


@query("c24_extraction_matches", "SELECT doc_id, substance_right, limit_value_right, unit_right FROM v_accuracy")
def extraction_matches(t):
    return accuracy_rows(t).drop("ordinal")


@query(
    "d12_extraction_accuracy",
    """SELECT ROUND(AVG(CAST(substance_right AS INT)), 6) AS substance, ROUND(AVG(CAST(limit_value_right AS INT)), 6)
         AS limit_value, ROUND(AVG(CAST(unit_right AS INT)), 6) AS unit,
         ROUND(AVG(CAST(substance_right AND limit_value_right AND unit_right AS INT)), 6) AS overall FROM v_accuracy""",
)
def extraction_accuracy(t):
    rows = accuracy_rows(t)
    flags = [F.col(f"{f}_right") for f in ACCURACY_FIELDS]
    shares = [F.round(F.avg(c.cast("int")), 6).alias(f) for c, f in zip(flags, ACCURACY_FIELDS, strict=True)]
    return rows.agg(*shares, F.round(F.avg((flags[0] & flags[1] & flags[2]).cast("int")), 6).alias("overall"))


@query(
    "d13_confidence_distribution",
    "SELECT CAST(LEAST(FLOOR(confidence * 10), 9) AS BIGINT) AS tenth, COUNT(*) AS clauses FROM v_clauses GROUP BY 1",
)
def confidence_distribution(t):
    return metrics.confidence_histogram(t.clauses())


@query(
    "d14_parse_quality",
    """SELECT doc_id AS document_id, ROUND(GREATEST(0.0, LEAST(1.0, CAST(LENGTH(text) AS DOUBLE)
           / (GREATEST(n_chars // 3000 + 1, 1) * CAST(1000.0 AS DOUBLE)))
         * (1.0 - COALESCE(CAST(LENGTH(text) - LENGTH(REPLACE(text, 'ê', '')) AS DOUBLE) / NULLIF(LENGTH(text), 0), 0.0))
         - CASE WHEN source = 'src3' THEN CAST(0.2 AS DOUBLE) ELSE 0.0 END), 6) AS parse_quality FROM documents""",
)
def parse_quality(t):
    """A letter of the texts plays the undecodable character; one source came through the fallback."""
    damaged = F.length("text") - F.length(F.replace(F.col("text"), F.lit("ê"), F.lit("")))
    pages = F.floor(F.col("n_chars") / 3000) + 1
    quality = extract.parse_quality(F.length("text"), pages, damaged, F.col("source") == "src3")
    return t.documents().select("document_id", F.round(quality, 6).alias("parse_quality"))


@query(
    "d15_answer_confidence",
    """SELECT c.query_id, MIN(k.confidence) AS confidence FROM v_citations c JOIN v_current k ON k.clause_id = c.clause_id
       GROUP BY 1""",
)
def answer_confidence(t):
    return grounding.answer_confidence(query_log(t), t.current())


@query(
    "d16_trace_journeys",
    """SELECT trace_id, event_id, event_type, ROW_NUMBER() OVER (PARTITION BY trace_id ORDER BY occurred_at, event_id) AS step
       FROM v_events""",
)
def trace_journeys(t):
    sliced = timeline.sliced(t.events(), "occurred_at")
    rows = timeline.journeys(sliced, "trace_id", ["occurred_at", "event_id"])
    return rows.select("trace_id", "event_id", "event_type", "step")


@query(
    "d17_rejections_by_field",
    """SELECT field, COUNT(*) AS rows FROM (
         SELECT 'substance_unrecognised' AS field FROM v_candidates WHERE unnormalized
         UNION ALL SELECT 'unit_unrecognised' FROM v_candidates WHERE unit IS NULL) GROUP BY 1""",
)
def rejections_by_field(t):
    return metrics.by_failing_field(validate.check_candidates(extract.candidates(t.limit_docs(), "doc_id")))


@query(
    "d18_requirement_counts",
    """SELECT evaluation, jurisdiction, clause_type, COUNT(*) AS requirements FROM v_req_before GROUP BY 1, 2, 3""",
    few_substances=True,
)
def requirement_counts(t):
    return requirement_count.requirement_counts(t.places(), t.ingredients(), t.current())


@query(
    "b06_candidate_validation",
    """SELECT doc_id, CAST(ordinal AS INT) AS ordinal, CONCAT_WS(',', CASE WHEN unnormalized THEN 'substance_unrecognised' END,
         CASE WHEN unit IS NULL THEN 'unit_unrecognised' END) AS reasons FROM v_candidates""",
)
def candidate_validation(t):
    checked = validate.check_candidates(extract.candidates(t.limit_docs(), "doc_id"))
    return checked.select("doc_id", "ordinal", F.array_join("reasons", ",").alias("reasons"))


@query(
    "b07_clause_demotion",
    """SELECT doc_id, CASE WHEN unit IS NULL THEN 'other' ELSE 'numeric_limit' END AS clause_type,
         CASE WHEN unit IS NULL THEN 'needs_review' ELSE 'pending_reconciliation' END AS status FROM v_candidates""",
)
def clause_demotion(t):
    demoted = validate.demote_unknown_units(extract.candidates(t.limit_docs(), "doc_id"))
    return demoted.select("doc_id", "clause_type", "status")


@query(
    "c20_two_pass_agreement",
    """SELECT doc_id, ROUND((1.0 + CASE WHEN unit IS NOT DISTINCT FROM CASE WHEN LENGTH(raw_unit) = 3 AND doc_id % 2 = 1
         THEN 'mg_per_kg' ELSE unit END THEN 1 ELSE 0 END) / 2, 6)::DOUBLE AS self_consistency FROM v_candidates
       WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id, 0.0 FROM v_candidates WHERE doc_id % 11 = 0
       UNION ALL SELECT doc_id, 0.0 FROM v_candidates WHERE doc_id % 11 = 0""",
)
def two_pass_agreement(t):
    """The second pass reads some units differently and misplaces some statements."""
    first = extract.candidates(t.limit_docs(), "doc_id")
    reworded = F.when(F.col("doc_id") % 2 == 1, F.regexp_replace("text", " ppm\\.$", " mg/kg.")).otherwise(F.col("text"))
    second = extract.candidates(t.limit_docs().withColumn("text", reworded), "doc_id")
    second = second.withColumn("ordinal", F.when(F.col("doc_id") % 11 == 0, F.col("ordinal") + 1).otherwise(F.col("ordinal")))
    agreed = extract.agreement(first, second, "doc_id", ["limit_value", "unit"])
    return agreed.select("doc_id", F.round("self_consistency", 6).alias("self_consistency"))


@query(
    "c25_document_provenance",
    """SELECT document_id, 'candidate' AS kind, CASE WHEN unnormalized OR unit IS NULL THEN 'rejected' ELSE 'accepted' END AS label,
         COUNT(*) AS n FROM (SELECT doc_id AS document_id, unnormalized, unit FROM v_candidates) GROUP BY ALL
       UNION ALL SELECT c.document_id, 'verdict', v.verdict, COUNT(*) FROM v_verdicts v JOIN v_clauses c
         ON c.clause_id = v.clause_id WHERE v.was = 'pending_reconciliation' GROUP BY ALL
       UNION ALL SELECT p.document_id, 'guardrail', d.decision, COUNT(*) FROM v_pair_decisions d JOIN v_pending p
         ON p.clause_id = d.a WHERE d.substance IS NOT NULL AND EXISTS (SELECT 1 FROM v_current k WHERE k.clause_id = d.b)
         GROUP BY ALL
       UNION ALL SELECT document_id, 'stage', stage, COUNT(*) FROM v_stage_log GROUP BY ALL""",
)
def document_provenance(t):
    """Everything a document led to: candidates, guardrail decisions, verdicts, stages."""
    checked = validate.check_candidates(extract.candidates(t.limit_docs(), "doc_id"))
    decided = reconcile.verdicts(t.stored_clauses()).where("was = 'pending_reconciliation'")
    return grounding.provenance(
        {
            "candidate": checked.select(
                F.col("doc_id").alias("document_id"),
                F.when(F.size("reasons") > 0, "rejected").otherwise("accepted").alias("label"),
            ),
            "verdict": decided.select("document_id", F.col("verdict").alias("label")),
            "stage": t.stage_log().select("document_id", F.col("stage").alias("label")),
        },
        reconcile.guardrail_counts(t.pending(), t.current(), by="document_id"),
    )
