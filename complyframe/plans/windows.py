"""Windows, order and limits, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from complyframe.constants import DOCUMENT_MOVES, SIMILAR_K
from complyframe.operators import counts, grounding, impact, metrics, reconcile, similarity, timeline
from complyframe.operators.ordered import positions
from complyframe.plans.registry import query
from complyframe.plans.views import add_view
from complyframe.sources import storage
from complyframe.sources import tables as source

add_view(
    "v_vectors",
    "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
)


@query(
    "e01_similar_clauses",
    f"""SELECT vec_id, neighbour, rank FROM (
          SELECT vec_id, neighbour, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS rank FROM (
            SELECT a.vec_id, b.vec_id AS neighbour, ROUND(LIST_COSINE_SIMILARITY(a.v, b.v), 6) AS score
            FROM v_vectors a JOIN v_vectors b ON a.label = b.label AND a.vec_id <> b.vec_id)) WHERE rank <= {SIMILAR_K}""",
)
def similar_clauses(t):
    vectors = t.table("embeddings")
    found = similarity.most_similar(vectors, vectors, "label", "vec_id", "embedding", SIMILAR_K)
    return found.select("vec_id", "neighbour", F.col("rank").cast("bigint").alias("rank"))


@query(
    "e02_current_clauses",
    "SELECT clause_id, jurisdiction, substance, product_type, clause_type, limit_base FROM v_current",
)
def current_clauses(t):
    columns = ("clause_id", "jurisdiction", "substance", "product_type", "clause_type", "limit_base")
    return t.current().select(*columns)


@query(
    "e03_supersede_chain",
    """SELECT clause_id, COALESCE(LAG(clause_id) OVER w, -1) AS supersedes, COALESCE(LEAD(clause_id) OVER w, -1) AS superseded_by,
         COALESCE(CASE WHEN limit_base < LAG(limit_base) OVER w THEN 'limit_tightened'
                       WHEN limit_base > LAG(limit_base) OVER w THEN 'limit_loosened' END, 'none') AS change
       FROM v_clauses WHERE clause_type = 'numeric_limit'
       WINDOW w AS (PARTITION BY jurisdiction, substance, product_type ORDER BY effective_date, document_date, clause_id)""",
)
def supersede_chain(t):
    linked = reconcile.supersede_chain(t.clauses().where("clause_type = 'numeric_limit'"))
    return linked.select(
        "clause_id",
        F.coalesce("supersedes", F.lit(-1)).alias("supersedes"),
        F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"),
        F.coalesce("change", F.lit("none")).alias("change"),
    )


@query(
    "e04_effective_date_conflicts",
    """SELECT jurisdiction, substance, product_type, effective_date, COUNT(*) AS clauses, MIN(limit_base) AS lowest,
         MAX(limit_base) AS highest FROM v_clauses WHERE clause_type = 'numeric_limit' GROUP BY 1, 2, 3, 4
       HAVING MIN(limit_base) <> MAX(limit_base)""",
    few_substances=True,
)
def effective_date_conflicts(t):
    found = reconcile.date_conflicts(t.clauses().where("clause_type = 'numeric_limit'"), ["effective_date"])
    return found.drop("clause_type", "basis", "type")


@query(
    "e05_event_differences",
    """SELECT event_id, CONCAT_WS(',', CASE WHEN old_k IS DISTINCT FROM k THEN 'k' END,
         CASE WHEN old_type IS DISTINCT FROM event_type THEN 'type' END) AS changed FROM (
           SELECT event_id, event_type, JSON_EXTRACT_STRING(props, '$.k') AS k,
             LAG(JSON_EXTRACT_STRING(props, '$.k')) OVER w AS old_k, LAG(event_type) OVER w AS old_type
           FROM v_events WINDOW w AS (PARTITION BY entity_id ORDER BY occurred_at, event_id))""",
)
def event_differences(t):
    state = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"))
    rows = timeline.sliced(t.events().withColumn("state", state), "occurred_at")
    seen = timeline.previous_states(rows, "entity_id", ["state"], "occurred_at", "event_id")
    before = F.coalesce(F.col("previous.state"), F.create_map().cast("map<string,string>"))
    return seen.select("event_id", F.array_join(timeline.changed_keys(before, F.col("state")), ",").alias("changed"))


@query(
    "e06_status_transitions",
    """SELECT event_id, entity_id, COALESCE(was, 'none') AS was, event_type FROM (SELECT *, LAG(event_type) OVER (
         PARTITION BY entity_id ORDER BY occurred_at, event_id) AS was FROM v_events)
       WHERE was IS DISTINCT FROM event_type""",
)
def status_transitions(t):
    rows = timeline.sliced(t.events(), "occurred_at")
    moved = timeline.transitions(rows, "entity_id", "event_type", "occurred_at", "event_id")
    return moved.select("event_id", "entity_id", F.coalesce("was", F.lit("none")).alias("was"), "event_type")


@query("e07_stage_durations", "SELECT document_id, stage, seq, seconds FROM v_durations")
def stage_durations(t):
    return metrics.stage_durations(t.stage_log())


@query(
    "e08_causes_not_reflected",
    """SELECT DISTINCT e.entity_id, e.trace_id FROM v_events e JOIN (SELECT entity_id, trace_id FROM v_events QUALIFY
         ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY occurred_at DESC, event_id DESC) = 1) l
       ON l.entity_id = e.entity_id AND l.trace_id <> e.trace_id""",
)
def causes_not_reflected(t):
    """Work left to do: causes that are not the last one its entity reflects."""
    last = timeline.latest(t.events(), "entity_id", ["trace_id"], "occurred_at", "event_id")
    causes = t.events().select("entity_id", "trace_id").distinct()
    return causes.join(last, ["entity_id", "trace_id"], "left_anti")


_MOVES_SQL = ", ".join(f"'{a}>{b}'" for a, b in DOCUMENT_MOVES)


@query(
    "e09_illegal_transitions",
    f"""SELECT document_id, seq, was, stage FROM (SELECT *, LAG(stage) OVER (PARTITION BY document_id ORDER BY "at", seq) AS was
          FROM v_stage_log) WHERE was IS NOT NULL AND CONCAT(was, '>', stage) NOT IN ({_MOVES_SQL})""",
)
def illegal_transitions(t):
    rows = timeline.sliced(t.stage_log(), "at")
    wrong = timeline.illegal_moves(rows, "document_id", "stage", "at", "seq", DOCUMENT_MOVES)
    return wrong.select("document_id", "seq", "was", "stage")


@query(
    "f01_newest_events",
    """SELECT event_id, event_type, occurred_at FROM v_events WHERE entity_id = 'prod_7'
       ORDER BY occurred_at DESC NULLS LAST, event_id LIMIT 50""",
)
def newest_events(t):
    found = source.newest(source.where_all(t.events(), entity_id="prod_7"), "occurred_at", "event_id")
    return found.select("event_id", "event_type", "occurred_at")


@query(
    "f02_newest_products",
    """SELECT l_partkey AS product_id, MIN(l_shipdate) AS created_at FROM lineitem GROUP BY 1
       ORDER BY created_at DESC NULLS LAST, product_id LIMIT 50""",
)
def newest_products(t):
    created = t.table("lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(F.min("l_shipdate").alias("created_at"))
    return source.newest(created, "created_at", "product_id")


@query("f03_markets_by_id", "SELECT CONCAT('market_', CAST(n_nationkey AS STRING)) AS id, n_name AS country FROM nation ORDER BY 1")
def markets_by_id(t):
    return t.markets().select("id", "country").orderBy("id")


@query(
    "f04_vector_search",
    f"""SELECT e.vec_id, ROUND(LIST_COSINE_SIMILARITY(e.v, q.v), 6) AS score FROM v_vectors e,
          (SELECT v FROM v_vectors ORDER BY vec_id DESC LIMIT 1) q ORDER BY score DESC, e.vec_id LIMIT {SIMILAR_K}""",
)
def vector_search(t):
    vectors = t.table("embeddings")
    asked = vectors.orderBy(F.desc("vec_id")).limit(1).select(F.col("embedding").alias("query"))
    return grounding.find_similar(vectors, asked, "vec_id", "embedding", SIMILAR_K, label=None).select("vec_id", "score")


@query(
    "f05_timeline_order",
    """SELECT entity_id, event_id, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY occurred_at, event_id) AS position
       FROM v_events""",
)
def timeline_order(t):
    rows = timeline.sliced(t.events(), "occurred_at")
    return positions(rows, ["entity_id"], timeline.SLICES, ["occurred_at", "event_id"]).select("entity_id", "event_id", "position")


@query(
    "f05_recent_first",
    """SELECT event_id, event_type, occurred_at FROM v_events WHERE entity_id = 'prod_11'""",
)
def recent_first(t):
    rows = timeline.in_time_order(source.where_all(t.events(), entity_id="prod_11"), newest_first=True)
    return rows.select("event_id", "event_type", "occurred_at")


@query(
    "f06_strongest_clauses",
    """SELECT product_id, clause_id, confidence, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id
         ORDER BY confidence DESC, clause_id) AS rank FROM (SELECT DISTINCT product_id, clause_id, confidence FROM v_req_before))
       WHERE rank <= 5""",
)
def strongest_clauses(t):
    trusted = impact.leading(t.current(), [F.desc("confidence"), F.asc("clause_id")], 5)
    found = grounding.strongest_clauses(impact.requirements(t.places(), t.ingredients(), trusted), 5)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "g01_union_of_branches",
    """SELECT CASE WHEN clause_type = 'numeric_limit' THEN 'substance' ELSE 'product_type' END AS branch, market_id,
         COUNT(*) AS requirements FROM v_req_before GROUP BY 1, 2""",
    few_substances=True,
)
def union_of_branches(t):
    found = counts.requirement_counts(t.places(), t.ingredients(), t.current(), by=["market_id"])
    branch = F.when(F.col("clause_type") == "numeric_limit", "substance").otherwise("product_type")
    return found.groupBy(branch.alias("branch"), "market_id").agg(F.sum("requirements").alias("requirements"))


@query(
    "g02_snapshot_difference",
    """SELECT 'left' AS side, CAST(1 AS BIGINT) AS copies, clause_id, limit_base FROM
         (SELECT clause_id, limit_base FROM v_current EXCEPT SELECT clause_id, limit_base FROM v_following)
       UNION ALL SELECT 'right', 1, clause_id, limit_base FROM
         (SELECT clause_id, limit_base FROM v_following EXCEPT SELECT clause_id, limit_base FROM v_current)""",
)
def snapshot_difference(t):
    columns = ["clause_id", "limit_base"]
    return storage.snapshot_difference(t.current().select(*columns), t.following().select(*columns))


@query(
    "g03_code_sets",
    """SELECT n_nationkey AS nation, CONCAT_WS(',', CONCAT('C', CAST(n_nationkey AS STRING)), CONCAT('N', CAST(n_nationkey AS STRING)),
         CONCAT('R', CAST(n_regionkey AS STRING))) AS codes, CONCAT('R', CAST(n_regionkey AS STRING)) AS shared,
         'country,jurisdictions' AS keys FROM nation""",
)
def code_sets(t):
    regions = F.array(*[F.lit(f"R{i}") for i in range(5)])
    record = F.create_map(
        F.lit("jurisdictions"), F.array_join("jurisdictions", "|"), F.lit("country"), F.col("country")
    )
    codes = F.array_union("jurisdictions", F.array("country_code"))
    return t.markets().select(
        F.substring("country_code", 2, 10).cast("int").alias("nation"),
        F.array_join(F.array_sort(codes), ",").alias("codes"),
        F.array_join(F.array_intersect("jurisdictions", regions), ",").alias("shared"),
        F.array_join(F.array_sort(F.map_keys(record)), ",").alias("keys"),
    )


@query(
    "h22_readiness",
    """SELECT s.product_id, s.market_id, CASE s.status WHEN 'compliant' THEN 'READY' WHEN 'unknown' THEN 'NO DATA'
         ELSE 'NOT READY' END AS label, COALESCE(w.clause_id, -1) AS most_critical FROM v_status_before s LEFT JOIN (
           SELECT product_id, market_id, clause_id FROM v_req_before WHERE severity IS NOT NULL QUALIFY ROW_NUMBER() OVER (
             PARTITION BY product_id, market_id ORDER BY CASE severity WHEN 'high' THEN 2 ELSE 1 END DESC, clause_id) = 1) w
         ON w.product_id = s.product_id AND w.market_id = s.market_id""",
)
def readiness(t):
    # All clauses other than limits call for review alike; the first of them stands for the rest.
    numeric = F.coalesce(F.col("clause_type") == "numeric_limit", F.lit(True))
    first = impact.leading(t.current().where(~numeric), [F.asc("clause_id")], 1)
    clauses = impact.leads(t.current().where(numeric), "substance").unionByName(first)
    found = impact.requirements(t.places(), t.ingredients(), clauses)
    return impact.readiness(found, t.product_markets()).select(
        "product_id", "market_id", "label", F.coalesce("most_critical", F.lit(-1)).alias("most_critical")
    )
