"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from complyframe.constants import PRODUCT_TYPES
from complyframe.operators import impact, normalize, reconcile, timeline, validate
from complyframe.plans.registry import query
from complyframe.plans.views import add_view
from complyframe.sources import tables as source


@query(
    "b01_events_of_entity",
    "SELECT event_id, entity_id, event_type, value FROM v_events WHERE entity_id = 'prod_7'",
)
def events_of_entity(t):
    return source.where_all(t.events(), entity_id="prod_7").select("event_id", "entity_id", "event_type", "value")


@query(
    "b02_clause_filter",
    """SELECT clause_id, substance, jurisdiction, status FROM v_clauses
       WHERE jurisdiction = 'R2' AND substance = 'sub_3' AND status = 'active'""",
)
def clause_filter(t):
    found = source.where_all(t.clauses(), jurisdiction="R2", substance="sub_3", status="active", unit=None)
    return found.select("clause_id", "substance", "jurisdiction", "status")


@query(
    "b03_open_conflicts",
    """SELECT clause_a, clause_b, substance, severity FROM v_conflicts WHERE status = 'open'""",
)
def open_conflicts(t):
    found = source.where_all(reconcile.conflicts(t.current()), status="open")
    return found.select("clause_a", "clause_b", "substance", "severity")


add_view(
    "v_raw_ingredients",
    """SELECT product_id, substance, CASE WHEN product_id % 13 = 0 THEN '' WHEN product_id % 17 = 0
         THEN REPEAT(substance, 60) ELSE substance END AS name,
         CAST(CASE WHEN product_id % 11 = 0 THEN 0 - amount ELSE amount END AS DECIMAL(18,6)) AS amount,
         CASE WHEN product_id % 7 = 0 THEN NULL WHEN product_id % 5 = 0 THEN 'cups' ELSE unit END AS unit
       FROM v_ingredients""",
)


def raw_ingredients(t):
    """Ingredient rows with defects of every kind worked in."""
    key = F.col("product_id")
    return t.ingredients().select(
        "product_id",
        "substance",
        F.when(key % 13 == 0, "").when(key % 17 == 0, F.repeat("substance", F.lit(60))).otherwise(F.col("substance")).alias("name"),
        F.when(key % 11 == 0, -F.col("amount")).otherwise(F.col("amount")).cast("decimal(18,6)").alias("amount"),
        F.when(key % 7 == 0, None).when(key % 5 == 0, "cups").otherwise(F.col("unit")).alias("unit"),
    )


@query(
    "b04_ingredient_validation",
    """SELECT product_id, substance, CONCAT_WS(',',
         CASE WHEN LENGTH(name) NOT BETWEEN 1 AND 200 THEN 'name_length' END,
         CASE WHEN amount < 0 THEN 'amount_negative' END,
         CASE WHEN amount IS NOT NULL AND unit IS NULL THEN 'amount_needs_unit' END,
         CASE WHEN unit = 'cups' THEN 'unit_unknown' END) AS reasons FROM v_raw_ingredients""",
)
def ingredient_validation(t):
    checked = validate.check_ingredients(raw_ingredients(t))
    return checked.select("product_id", "substance", F.array_join("reasons", ",").alias("reasons"))


add_view(
    "v_raw_products",
    """SELECT p_partkey AS product_id, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_name END AS name,
         CASE p_type WHEN 'ECONOMY' THEN 'food_beverage_powder' WHEN 'LARGE' THEN 'food_beverage_liquid'
           WHEN 'MEDIUM' THEN 'food_solid' WHEN 'PROMO' THEN 'supplement' WHEN 'SMALL' THEN 'cosmetic'
           ELSE p_type END AS product_type,
         CONCAT('N', CAST(p_size % 25 AS STRING)) AS origin, REPEAT(p_name, CAST(p_size AS INTEGER)) AS packaging FROM part""",
)


def raw_products(t):
    kinds = dict(zip(("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"), PRODUCT_TYPES, strict=True))
    kind = F.col("p_type")
    for label, name in kinds.items():
        kind = F.when(F.col("p_type") == label, name).otherwise(kind)
    return t.table("part").select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 19 == 0, "").otherwise(F.col("p_name")).alias("name"),
        kind.alias("product_type"),
        F.concat(F.lit("N"), (F.col("p_size") % 25).cast("string")).alias("origin"),
        F.repeat("p_name", F.col("p_size")).alias("packaging"),
    )


@query(
    "b05_product_validation",
    """SELECT product_id, CONCAT_WS(',', CASE WHEN LENGTH(name) NOT BETWEEN 1 AND 200 THEN 'name_length' END,
         CASE WHEN product_type = 'STANDARD' THEN 'product_type_unknown' END,
         CASE WHEN LENGTH(origin) <> 2 THEN 'origin_length' END,
         CASE WHEN LENGTH(packaging) > 200 THEN 'packaging_length' END) AS reasons FROM v_raw_products""",
)
def product_validation(t):
    checked = validate.check_products(raw_products(t))
    return checked.select("product_id", F.array_join("reasons", ",").alias("reasons"))


add_view(
    "v_pages_of_documents",
    """SELECT doc_id AS document_id, n_chars // 1000 + 1 AS page_count, CAST(STRLEN(text) AS BIGINT) AS size_bytes
       FROM documents""",
)


@query(
    "b08_document_admission",
    """SELECT document_id, page_count, size_bytes, CASE WHEN page_count > 100 THEN 'too_many_pages'
         WHEN size_bytes > 20971520 THEN 'too_large' ELSE 'admitted' END AS outcome FROM v_pages_of_documents""",
)
def document_admission(t):
    sized = t.documents().select(
        "document_id",
        (F.floor(F.col("n_chars") / 1000) + 1).cast("bigint").alias("page_count"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    )
    admitted = validate.admit_documents(sized)
    return admitted.withColumn("outcome", F.coalesce("reject_reason", F.lit("admitted"))).drop("reject_reason")


@query(
    "b09_market_lookup",
    """SELECT r.custkey, r.wanted, r.market_id, r.market_id IS NOT NULL AS found FROM (
         SELECT c_custkey AS custkey, UPPER(TRIM(code)) AS wanted,
           (SELECT MIN(m.market_id) FROM (
              SELECT market_id, jurisdiction AS code FROM v_market_jurisdictions
              UNION ALL SELECT CONCAT('market_', CAST(n_nationkey AS STRING)), CONCAT('C', CAST(n_nationkey AS STRING))
              FROM nation) m WHERE TRIM(q.code) <> '' AND STARTS_WITH(m.code, UPPER(TRIM(q.code)))) AS market_id
         FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN CONCAT(' n', CAST(c_custkey % 40 AS STRING))
                 WHEN 1 THEN CONCAT('R', CAST(c_custkey % 9 AS STRING), ' ') WHEN 2 THEN 'c' WHEN 3 THEN c_mktsegment
                 ELSE '  ' END AS code FROM customer) q) r""",
)
def market_lookup(t):
    key = F.col("c_custkey")
    code = (
        F.when(key % 5 == 0, F.concat(F.lit(" n"), (key % 40).cast("string")))
        .when(key % 5 == 1, F.concat(F.lit("R"), (key % 9).cast("string"), F.lit(" ")))
        .when(key % 5 == 2, "c")
        .when(key % 5 == 3, F.col("c_mktsegment"))
        .otherwise("  ")
    )
    requests = t.table("customer").select(key.alias("custkey"), code.alias("code"))
    return normalize.lookup_markets(requests, "code", t.markets()).drop("code")


@query(
    "b10_drop_volatile_fields",
    "SELECT product_id, CAST(TO_JSON({'name': name, 'origin': origin}) AS VARCHAR) AS after FROM v_products",
)
def drop_volatile_fields(t):
    stamped = t.products().withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    record = F.struct("name", "origin", "created_at", "updated_at")
    return stamped.select("product_id", F.to_json(record.dropFields("created_at", "updated_at")).alias("after"))


ACKS = "SELECT DISTINCT user_id AS product_id FROM events WHERE event_type = 'purchase' AND value > 20"


@query(
    "b11_alerts",
    f"""SELECT product_id, market_id, was, status FROM v_changes c
       WHERE CASE status WHEN 'unknown' THEN 0 WHEN 'compliant' THEN 1 WHEN 'attention_required' THEN 2 ELSE 3 END
           > CASE was WHEN 'unknown' THEN 0 WHEN 'compliant' THEN 1 WHEN 'attention_required' THEN 2 ELSE 3 END
         AND product_id NOT IN ({ACKS})""",
)
def alerts(t):
    bought = t.table("events").where("event_type = 'purchase' AND value > 20")
    acknowledged = bought.select(F.col("user_id").alias("product_id")).distinct().join(t.product_markets(), "product_id")
    changes = impact.status_changes(t.status(), t.status(after=True))
    return impact.alerts(changes, acknowledged).drop("worsened")


@query(
    "b12_failed_documents",
    """SELECT document_id, failed_at, failed_from FROM (
         SELECT document_id, stage, "at" AS failed_at,
           COALESCE(LAG(stage) OVER (PARTITION BY document_id ORDER BY "at", seq), 'none') AS failed_from,
           ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY "at" DESC, seq DESC) AS n FROM v_stage_log)
       WHERE n = 1 AND stage = 'failed'""",
)
def failed_documents(t):
    failed = timeline.failed_documents(t.stage_log())
    return failed.select(
        "document_id", F.col("at").alias("failed_at"), F.coalesce("was", F.lit("none")).alias("failed_from")
    )
