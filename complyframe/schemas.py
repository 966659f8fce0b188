"""Schemas of the collections, as DDL text (a StructType needs a running session)."""

from __future__ import annotations

INGREDIENT = "STRUCT<name: STRING, normalized: STRING, unnormalized: BOOLEAN, amount: DECIMAL(18,6), unit: STRING>"

MARKETS = (
    "id STRING, country STRING, country_code STRING, jurisdictions ARRAY<STRING>, label STRING, regulator STRING"
)
PRODUCTS = (
    "id STRING, workspace_id STRING, name STRING, product_type STRING, origin STRING, packaging STRING, "
    f"ingredients ARRAY<{INGREDIENT}>, target_markets ARRAY<STRING>, created_at TIMESTAMP, updated_at TIMESTAMP"
)
PRODUCT_INPUT = (
    "id STRING, name STRING, product_type STRING, origin STRING, packaging STRING, "
    "ingredients ARRAY<STRUCT<name: STRING, amount: DECIMAL(18,6), unit: STRING>>, target_markets ARRAY<STRING>, "
    "requested_at TIMESTAMP"
)
DOCUMENTS = (
    "id STRING, workspace_id STRING, filename STRING, text STRING, content_sha256 STRING, source_type STRING, "
    "source_name STRING, jurisdiction STRING, declared_effective_date DATE, page_count INT, size_bytes BIGINT, "
    "status STRING, stage_log ARRAY<STRUCT<stage: STRING, at: TIMESTAMP, ok: BOOLEAN, clause_count: INT>>, "
    "error STRING, uploaded_at TIMESTAMP"
)
CLAUSES = (
    "clause_id STRING, document_id STRING, text STRING, clause_type STRING, substance STRING, limit_value DECIMAL(18,6), "
    "unit STRING, basis STRING, product_type STRING, jurisdiction STRING, effective_date DATE, document_date DATE, "
    "source_type STRING, authority_tier DECIMAL(18,6), confidence DECIMAL(18,6), status STRING, supersedes STRING, "
    "superseded_by STRING"
)
GRAPH_EVENTS = (
    "event_id STRING, event_type STRING, entity_type STRING, entity_id STRING, before STRING, after STRING, "
    "cause STRING, triggered_by STRING, confidence DECIMAL(18,6), trace_id STRING, occurred_at TIMESTAMP"
)
PUSH_MESSAGES = (
    "message STRUCT<data: STRING, attributes: MAP<STRING,STRING>, messageId: STRING, publishTime: STRING>, "
    "subscription STRING"
)
CATALOGUE = (
    "file STRING, register_id STRING, pages INT, sha256_prefix STRING, in_force_from STRING, in_force_to STRING"
)
