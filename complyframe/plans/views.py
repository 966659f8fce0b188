"""SQL text of the derived views, for the queries' twins."""

from __future__ import annotations

import re

from complyframe.constants import SUBSTANCE_SYNONYMS, UNIT_SYNONYMS


def _values(pairs: dict[str, str]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs.items())


VIEWS: dict[str, str] = {
    "v_synonyms": f"SELECT * FROM (VALUES {_values(SUBSTANCE_SYNONYMS)}) AS t(synonym, canonical)",
    "v_units": f"SELECT * FROM (VALUES {_values(UNIT_SYNONYMS)}) AS t(raw, unit)",
    "v_factors": """SELECT * FROM (VALUES ('percent_w_w','percent_w_w',1.0), ('percent_w_w','mg_per_kg',10000.0),
        ('percent_w_w','ppm',10000.0), ('mg_per_kg','percent_w_w',0.0001), ('mg_per_kg','mg_per_kg',1.0),
        ('mg_per_kg','ppm',1.0), ('ppm','percent_w_w',0.0001), ('ppm','mg_per_kg',1.0), ('ppm','ppm',1.0))
        AS t(from_unit, to_unit, factor)""",
    "v_market_jurisdictions": """
        SELECT CONCAT('market_', CAST(n_nationkey AS STRING)) AS market_id,
               CONCAT('R', CAST(n_regionkey AS STRING)) AS jurisdiction FROM nation
        UNION ALL SELECT CONCAT('market_', CAST(n_nationkey AS STRING)), CONCAT('N', CAST(n_nationkey AS STRING))
        FROM nation""",
    "v_products": """
        SELECT p_partkey AS product_id, p_name AS name, p_type AS product_type,
               CONCAT('N', CAST(p_size % 25 AS STRING)) AS origin FROM part""",
    "v_product_markets": """
        SELECT p_partkey AS product_id, p_type AS product_type,
               CONCAT('market_', CAST(p_partkey % 25 AS STRING)) AS market_id FROM part
        UNION ALL SELECT p_partkey, p_type, CONCAT('market_', CAST((p_partkey + 7) % 25 AS STRING)) FROM part""",
    "v_places": """
        SELECT p.product_id, p.product_type, p.market_id, j.jurisdiction
        FROM v_product_markets p JOIN v_market_jurisdictions j ON p.market_id = j.market_id""",
    "v_vocabulary": "SELECT 20 + COUNT(*) // 4 AS substances FROM part",
    "v_ingredients": """
        SELECT l_partkey AS product_id, CONCAT('sub_', CAST((l_partkey + l_suppkey % 20 * 7) % (SELECT substances FROM v_vocabulary) AS STRING)) AS substance,
               MAX(CASE WHEN l_tax = 0.0 THEN NULL ELSE CAST(l_discount AS DECIMAL(18,6)) END) AS amount,
               'percent_w_w' AS unit,
               CAST(MAX(CASE WHEN l_tax = 0.0 THEN NULL ELSE CAST(l_discount AS DECIMAL(10,6)) END)
                    * CAST(10000 AS DECIMAL(6,0)) AS DECIMAL(18,6)) AS amount_base
        FROM lineitem GROUP BY l_partkey, (l_partkey + l_suppkey % 20 * 7) % (SELECT substances FROM v_vocabulary)""",
    "v_clause_rows": """
        SELECT o.o_orderkey AS clause_id, o.o_orderkey % 1000 AS document_id,
          CONCAT('sub_', CAST(o.o_orderkey % (SELECT substances FROM v_vocabulary) AS STRING)) AS substance,
          CASE WHEN o.o_orderkey % 2 = 0 THEN CONCAT('N', CAST(n.n_nationkey AS STRING))
               ELSE CONCAT('R', CAST(n.n_regionkey AS STRING)) END AS jurisdiction,
          CASE o.o_custkey % 10 WHEN 7 THEN 'documentation' WHEN 8 THEN 'labeling' WHEN 9 THEN 'certification'
               ELSE 'numeric_limit' END AS clause_type,
          CASE o.o_orderkey % 3 WHEN 0 THEN 'percent_w_w' WHEN 1 THEN 'mg_per_kg' ELSE 'ppm' END AS unit,
          CASE o.o_orderkey % 3 WHEN 0 THEN CAST(CAST(o.o_orderkey % 11 AS DECIMAL(6,2)) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(18,6))
               ELSE CAST(o.o_orderkey % 11 * 100 AS DECIMAL(18,6)) END AS limit_value,
          CASE o.o_orderkey % 7 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO'
               WHEN 4 THEN 'SMALL' WHEN 5 THEN 'STANDARD' ELSE '*' END AS product_type,
          CAST(o.o_orderdate AS DATE) AS effective_date,
          CAST(o.o_orderdate AS DATE) + CAST(o.o_custkey % 30 AS INTEGER) AS document_date,
          CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'official_regulation'
               WHEN o.o_orderpriority = '3-MEDIUM' THEN 'industry_article' ELSE 'social' END AS source_type,
          CASE o.o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'pending_reconciliation'
               ELSE 'superseded' END AS status,
          CAST(CAST(o.o_custkey % 11 AS DECIMAL(6,2)) * CAST(0.10 AS DECIMAL(4,2)) AS DECIMAL(18,6)) AS parse_quality,
          CAST(CAST(o.o_orderkey % 5 AS DECIMAL(6,2)) * CAST(0.25 AS DECIMAL(4,2)) AS DECIMAL(18,6)) AS self_consistency
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "v_clauses": """
        SELECT *, 'per_weight' AS basis,
          CAST(CASE WHEN unit = 'percent_w_w' THEN CAST(limit_value AS DECIMAL(12,6)) * CAST(10000 AS DECIMAL(6,0))
               ELSE CAST(limit_value AS DECIMAL(12,6)) END AS DECIMAL(18,6)) AS limit_base,
          CAST(CASE source_type WHEN 'official_regulation' THEN 1.0 WHEN 'industry_article' THEN 0.6 ELSE 0.2 END
               AS DECIMAL(18,6)) AS authority_tier,
          CAST(CAST(0.3 AS DECIMAL(4,2)) * CAST(parse_quality AS DECIMAL(8,6))
               + CAST(0.4 AS DECIMAL(4,2)) * CAST(self_consistency AS DECIMAL(8,6))
               + CAST(0.3 AS DECIMAL(4,2)) * CAST(CASE source_type WHEN 'official_regulation' THEN 1.0
                    WHEN 'industry_article' THEN 0.6 ELSE 0.2 END AS DECIMAL(8,6)) AS DECIMAL(18,6)) AS confidence
        FROM v_clause_rows""",
    "v_live": """
        SELECT *, (confidence < 0.5 OR authority_tier < 0.5) AS gated FROM v_clauses
        WHERE status IN ('active', 'pending_reconciliation')""",
    "v_active": "SELECT * FROM v_clauses WHERE status = 'active'",
    "v_pending": "SELECT * FROM v_clauses WHERE status = 'pending_reconciliation'",
    "v_current": """
        SELECT * FROM v_active QUALIFY clause_type <> 'numeric_limit' OR ROW_NUMBER() OVER (
          PARTITION BY jurisdiction, substance, product_type, clause_type
          ORDER BY effective_date DESC, document_date DESC, clause_id DESC) = 1""",
    "v_following": """
        SELECT * FROM v_live WHERE (status = 'active' OR NOT gated) QUALIFY clause_type <> 'numeric_limit' OR ROW_NUMBER() OVER (
          PARTITION BY jurisdiction, substance, product_type, clause_type
          ORDER BY effective_date DESC, document_date DESC, clause_id DESC) = 1""",
    "v_events": """
        SELECT event_id, CONCAT('prod_', CAST(user_id AS STRING)) AS entity_id, event_type, ts AS occurred_at, value,
               CONCAT('trace_', CAST(event_id % 500 AS STRING)) AS trace_id, props FROM events""",
    "v_stage_log": """
        SELECT event_id % 1000 AS document_id, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'extracting'
               WHEN 'click' THEN 'extracted' WHEN 'purchase' THEN 'reconciled' ELSE 'failed' END AS stage,
               ts AS "at", event_id AS seq FROM events""",
    "v_limit_docs": """
        SELECT doc_id, source, CONCAT(text, ' The maximum level of ', CASE doc_id % 4 WHEN 0 THEN 'sodium benzoate'
               WHEN 1 THEN 'natrium benzoat' WHEN 2 THEN 'E211' ELSE 'unlisted extract' END, ' is ',
               CAST(doc_id % 900 AS STRING), CASE doc_id % 3 WHEN 0 THEN ' mg/kg.' WHEN 1 THEN ' ppm.'
               ELSE ' grams per gallon.' END) AS text FROM documents""",
    "v_query_turns": """
        SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a
        ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'""",
    "v_conflicts": """
        SELECT a.clause_id AS clause_a, b.clause_id AS clause_b, 'cross_jurisdiction_limit_mismatch' AS type,
               a.substance, a.limit_base AS limit_a, b.limit_base AS limit_b, 'high' AS severity, 'open' AS status
        FROM v_current a JOIN v_current b ON a.substance = b.substance AND a.jurisdiction <> b.jurisdiction
         AND a.clause_id < b.clause_id AND a.limit_base <> b.limit_base
         AND (a.product_type = b.product_type OR a.product_type = '*' OR b.product_type = '*')
        WHERE a.clause_type = 'numeric_limit' AND b.clause_type = 'numeric_limit'""",
    "v_changes": """
        SELECT a.product_id, a.market_id, b.status AS was, a.status FROM v_status_after a
        JOIN v_status_before b ON a.product_id = b.product_id AND a.market_id = b.market_id WHERE a.status <> b.status""",
    "v_binding": """
        SELECT product_id, market_id, substance, limit_base, clause_id FROM v_req_before
        WHERE clause_type = 'numeric_limit' QUALIFY ROW_NUMBER() OVER (
          PARTITION BY product_id, market_id, substance ORDER BY limit_base, clause_id) = 1""",
}


def _requirements(clauses: str, ingredients: str = "v_ingredients") -> str:
    return f"""
        SELECT *, CASE evaluation WHEN 'fail' THEN 'high' WHEN 'needs_review' THEN 'medium' END AS severity FROM (
          SELECT p.product_id, p.market_id, p.jurisdiction, c.substance, c.clause_id, c.document_id, c.clause_type,
            c.limit_base, c.confidence, i.amount_base,
            CASE WHEN c.confidence < 0.5 OR c.clause_type <> 'numeric_limit' OR i.amount_base IS NULL THEN 'needs_review'
                 WHEN i.amount_base <= c.limit_base THEN 'pass' ELSE 'fail' END AS evaluation
          FROM v_places p JOIN {clauses} c ON c.jurisdiction = p.jurisdiction
          LEFT JOIN {ingredients} i ON i.product_id = p.product_id AND i.substance = c.substance
          WHERE i.product_id IS NOT NULL
             OR (c.clause_type <> 'numeric_limit' AND c.product_type IN (p.product_type, '*')))"""


def _status(required: str) -> str:
    return f"""
        SELECT m.product_id, m.market_id,
          CASE WHEN COUNT(*) FILTER (r.evaluation = 'fail') > 0 THEN 'non_compliant'
               WHEN COUNT(*) FILTER (r.evaluation = 'needs_review') > 0 THEN 'attention_required'
               WHEN COUNT(*) FILTER (r.evaluation = 'pass') > 0 THEN 'compliant' ELSE 'unknown' END AS status,
          COUNT(*) FILTER (r.evaluation = 'fail') AS critical,
          COUNT(*) FILTER (r.evaluation = 'needs_review') AS to_review,
          COUNT(*) FILTER (r.evaluation = 'pass') AS passed
        FROM v_product_markets m LEFT JOIN {required} r ON r.product_id = m.product_id AND r.market_id = m.market_id
        GROUP BY m.product_id, m.market_id"""


VIEWS["v_req_before"] = _requirements("v_current")
VIEWS["v_req_after"] = _requirements("v_following")
VIEWS["v_settled"] = """
        SELECT c.* FROM v_clauses c JOIN v_verdicts d ON d.clause_id = c.clause_id WHERE d.status = 'active' QUALIFY
        c.clause_type <> 'numeric_limit' OR ROW_NUMBER() OVER (PARTITION BY c.jurisdiction, c.substance, c.product_type, c.clause_type
          ORDER BY c.effective_date DESC, c.document_date DESC, c.clause_id DESC) = 1"""
VIEWS["v_req_settled"] = _requirements("v_settled")
VIEWS["v_status_settled"] = _status("v_req_settled")
VIEWS["v_settled_changes"] = """
        SELECT a.product_id, a.market_id, b.status AS was, a.status FROM v_status_settled a
        JOIN v_status_before b ON a.product_id = b.product_id AND a.market_id = b.market_id WHERE a.status <> b.status"""
VIEWS["v_req_full"] = _requirements("v_current", "v_ingredients")
VIEWS["v_status_full"] = _status("v_req_full")
VIEWS["v_status_before"] = _status("v_req_before")
VIEWS["v_status_after"] = _status("v_req_after")

#: The views of substances with 20 of them whatever the number of products, so that clauses and pairs meet as often as they can.
FEW_SUBSTANCES: dict[str, str] = {
    "v_ingredients": VIEWS["v_ingredients"].replace(
        "(l_partkey + l_suppkey % 20 * 7) % (SELECT substances FROM v_vocabulary)", "l_suppkey % 20"
    ),
    "v_clause_rows": VIEWS["v_clause_rows"].replace("(SELECT substances FROM v_vocabulary)", "20"),
}

_NAME = re.compile(r"\bv_[a-z_]+\b")


def add_view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(sql: str, few_substances: bool = False) -> str:
    """Put the views that ``sql`` names, and those they name, in front as CTEs."""
    views = VIEWS | FEW_SUBSTANCES if few_substances else VIEWS
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in views and name not in ordered:
                visit(views[name])
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({views[name]})" for name in ordered)
    return f"WITH {ctes}\n{sql}"
