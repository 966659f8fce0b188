"""State application: snapshots and their events."""

from __future__ import annotations

from pyspark.sql import functions as F

from complyframe.constants import CLAUSE_MOVES
from complyframe.operators import reconcile, state
from complyframe.plans.expressions import patches, twins
from complyframe.plans.filters import raw_products
from complyframe.plans.joins import raw_names
from complyframe.plans.registry import query
from complyframe.plans.views import add_view


def product_requests(t):
    """Requests to create products: defects, raw ingredient names, given amounts."""
    named = raw_names(t).withColumnRenamed("name", "ingredient")
    key = F.col("product_id")
    unit = F.when(key % 7 == 0, None).otherwise("percent_w_w")
    amount = F.when(key % 2 == 0, (key % 11).cast("decimal(18,6)"))
    return raw_products(t).join(named, "product_id").select(
        key.cast("string").alias("id"),
        "name",
        "product_type",
        F.lower(F.substring("origin", 1, 2)).alias("origin"),
        "packaging",
        F.array(F.struct(F.col("ingredient").alias("name"), amount.alias("amount"), unit.alias("unit"))).alias("ingredients"),
        F.array(F.lit("market_1")).alias("target_markets"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("requested_at"),
    )


add_view(
    "v_requests",
    """SELECT p.product_id, p.name, p.product_type, p.packaging, SUBSTRING(p.origin, 1, 2) AS origin, n.name AS ingredient,
         CASE WHEN p.product_id % 2 = 0 THEN p.product_id % 11 END AS amount, p.product_id % 7 = 0 AS no_unit,
         LENGTH(p.name) NOT BETWEEN 1 AND 200 OR p.product_type = 'STANDARD' OR LENGTH(p.packaging) > 200
           OR n.name IS NULL OR n.name = '' OR (p.product_id % 2 = 0 AND p.product_id % 7 = 0) AS bad
       FROM v_raw_products p JOIN v_names n ON n.product_id = p.product_id""",
)


@query(
    "k01_create_products",
    """SELECT CAST(r.product_id AS STRING) AS id, r.origin, m.normalized, m.unnormalized, 'product_created' AS event_type
       FROM v_requests r JOIN v_normalised m ON m.product_id = r.product_id WHERE NOT r.bad""",
)
def create_products(t):
    products, events, _ = state.create_products(product_requests(t))
    made = products.select("id", "origin", F.inline("ingredients").alias("name", "normalized", "unnormalized", "amount", "unit"))
    joined = made.join(events.select(F.col("entity_id").alias("id"), "event_type"), "id")
    return joined.select("id", "origin", "normalized", "unnormalized", "event_type")


@query(
    "k01_quarantined_products",
    """SELECT CAST(product_id AS STRING) AS id, CONCAT_WS(',',
         CASE WHEN LENGTH(name) NOT BETWEEN 1 AND 200 THEN 'name_length' END,
         CASE WHEN product_type = 'STANDARD' THEN 'product_type_unknown' END,
         CASE WHEN LENGTH(packaging) > 200 THEN 'packaging_length' END,
         CASE WHEN ingredient IS NULL OR ingredient = '' THEN 'name_length' END,
         CASE WHEN amount IS NOT NULL AND no_unit THEN 'amount_needs_unit' END) AS reasons FROM v_requests WHERE bad""",
)
def quarantined_products(t):
    _, _, quarantine = state.create_products(product_requests(t))
    return quarantine.select("id", F.array_join("reasons", ",").alias("reasons"))


PATCHED_SQL = """SELECT b.product_id, COALESCE(p.name, b.name) AS name, COALESCE(UPPER(p.origin), b.origin) AS origin,
         COALESCE(p.packaging, b.packaging, 'none') AS packaging FROM v_twins b LEFT JOIN v_patches p ON p.product_id = b.product_id"""


@query("h13_patch_merge", PATCHED_SQL)
def patch_merge(t):
    snapshot, _ = state.patch_products(twins(t), patches(t), "product_id")
    return snapshot.select("product_id", "name", "origin", F.coalesce("packaging", F.lit("none")).alias("packaging"))


_DIFF_SQL = """SELECT b.product_id,
         CONCAT('{', CONCAT_WS(',', CASE WHEN p.name IS NOT NULL THEN CONCAT('"name":"', b.name, '"') END,
           CASE WHEN p.origin IS NOT NULL THEN CONCAT('"origin":"', b.origin, '"') END,
           CASE WHEN p.packaging IS NOT NULL THEN CONCAT('"packaging":', COALESCE('"' || b.packaging || '"', 'null')) END),
           '}') AS before,
         CONCAT('{', CONCAT_WS(',', CASE WHEN p.name IS NOT NULL THEN CONCAT('"name":"', p.name, '"') END,
           CASE WHEN p.origin IS NOT NULL THEN CONCAT('"origin":"', UPPER(p.origin), '"') END,
           CASE WHEN p.packaging IS NOT NULL THEN CONCAT('"packaging":"', p.packaging, '"') END), '}') AS after
       FROM v_twins b JOIN v_patches p ON p.product_id = b.product_id"""


@query("h14_before_after", _DIFF_SQL)
def before_after(t):
    return state.patch_rows(twins(t), patches(t), "product_id").select("product_id", "before", "after")


@query(
    "k02_patch_products",
    f"""SELECT CAST(product_id AS STRING) AS entity_id, before, after, 'product_updated' AS event_type FROM ({_DIFF_SQL})
        WHERE after <> '{{}}'""",
)
def patch_products(t):
    _, events = state.patch_products(twins(t), patches(t), "product_id")
    return events.select("entity_id", "before", "after", "event_type")


@query(
    "k03_apply_verdicts",
    """SELECT clause_id, was, status, verdict, COALESCE(supersedes, -1) AS supersedes, COALESCE(superseded_by, -1) AS superseded_by,
         COALESCE(change, 'none') AS change FROM v_verdicts""",
)
def apply_verdicts(t):
    decided = reconcile.verdicts(t.stored_clauses())
    return decided.select(
        "clause_id",
        "was",
        "status",
        "verdict",
        F.coalesce("supersedes", F.lit(-1)).alias("supersedes"),
        F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"),
        F.coalesce("change", F.lit("none")).alias("change"),
    )


@query(
    "k03_verdict_events",
    """SELECT CAST(clause_id AS STRING) AS entity_id, CASE status WHEN 'superseded' THEN 'clause_superseded'
         WHEN 'active' THEN 'clause_created' ELSE 'clause_flagged_review' END AS event_type FROM v_verdicts
       WHERE was <> status""",
)
def verdict_events(t):
    return reconcile.verdict_events(reconcile.verdicts(t.stored_clauses())).select("entity_id", "event_type")


add_view(
    "v_actions",
    """SELECT o_orderkey AS clause_id, CASE WHEN o_orderkey % 3 = 0 THEN 'superseded' ELSE 'needs_review' END AS wanted FROM orders
       WHERE o_totalprice > 250000""",
)


@query(
    "k04_human_actions",
    """SELECT c.clause_id, c.status AS was, a.wanted, CASE WHEN (c.status = 'pending_reconciliation' OR c.status = 'active')
         THEN 'accepted' ELSE 'rejected' END AS outcome FROM v_clauses c JOIN v_actions a ON a.clause_id = c.clause_id""",
)
def human_actions(t):
    expensive = t.table("orders").where("o_totalprice > 250000")
    to = F.when(F.col("o_orderkey") % 3 == 0, "superseded").otherwise("needs_review")
    actions = expensive.select(F.col("o_orderkey").alias("clause_id"), to.alias("to"))
    _, accepted, rejected = state.apply_moves(t.clauses().select("clause_id", "status"), actions, "clause_id", CLAUSE_MOVES)
    both = accepted.withColumn("outcome", F.lit("accepted")).unionByName(rejected.withColumn("outcome", F.lit("rejected")))
    return both.withColumnRenamed("to", "wanted")


@query(
    "k05_advance_documents",
    """SELECT document_id, steps, failures, stage AS status, CASE WHEN stage = 'failed' THEN CONCAT('step ', CAST(seq AS STRING))
         ELSE 'none' END AS error FROM (
           SELECT *, COUNT(*) OVER (PARTITION BY document_id) AS steps,
             COUNT(*) FILTER (stage = 'failed') OVER (PARTITION BY document_id) AS failures,
             ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY "at" DESC, seq DESC) AS n FROM v_stage_log) WHERE n = 1""",
)
def advance_documents(t):
    error = F.when(F.col("stage") == "failed", F.concat(F.lit("step "), F.col("seq").cast("string")))
    latest = state.latest_status(t.stage_log().withColumn("error", error))
    return latest.withColumn("error", F.coalesce("error", F.lit("none")))


@query(
    "k06_fold_log",
    """SELECT entity_id, event_type AS state FROM v_events QUALIFY ROW_NUMBER() OVER (
         PARTITION BY entity_id ORDER BY occurred_at DESC, event_id DESC) = 1""",
)
def fold_log(t):
    return state.fold(t.events(), "entity_id", "event_type", "occurred_at", "event_id")
