"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from complyframe.constants import SOURCE_CATALOGUE
from complyframe.operators import extract
from complyframe.plans.registry import query
from complyframe.plans.views import add_view
from complyframe.sources import messages, storage
from complyframe.sources import tables as source


@query(
    "a01_seed_markets",
    """SELECT CONCAT('market_', CAST(n_nationkey AS STRING)) AS id, n_name AS country,
         CONCAT('C', CAST(n_nationkey AS STRING)) AS country_code,
         CONCAT('R', CAST(n_regionkey AS STRING), ',N', CAST(n_nationkey AS STRING)) AS jurisdictions FROM nation""",
)
def seed_markets(t):
    """Seeding again over the seeded table leaves the same rows."""
    folder = storage.run_folder(t.spark)
    once = storage.written(t.markets(), f"{folder}/markets_1")
    twice = storage.written(storage.merge_upsert(once, t.markets(), "id"), f"{folder}/markets_2")
    return twice.withColumn("jurisdictions", F.array_join("jurisdictions", ","))


@query("a02_scan_products", "SELECT product_id, name, product_type, origin FROM v_products")
def scan_products(t):
    return t.products()


@query("a03_point_lookup", "SELECT clause_id, substance, status FROM v_clauses WHERE clause_id = 1042")
def point_lookup(t):
    return source.get(t.clauses(), "clause_id", 1042).select("clause_id", "substance", "status")


@query(
    "a04_document_landing",
    """SELECT doc_id AS document_id, SHA256(text) AS content_sha256, 'social' AS source_type, source AS source_name,
         CONCAT('R', CAST(doc_id % 5 AS STRING)) AS jurisdiction, CAST(STRLEN(text) AS BIGINT) AS size_bytes,
         'uploaded' AS status FROM documents""",
)
def document_landing(t):
    described = t.documents().select(
        "document_id",
        "text",
        F.lit("social").alias("source_type"),
        F.col("source").alias("source_name"),
        F.concat(F.lit("R"), (F.col("document_id") % 5).cast("string")).alias("jurisdiction"),
        F.lit(None).cast("date").alias("declared_effective_date"),
    )
    return source.land_documents(described).drop("text", "declared_effective_date")


def push_messages(t):
    """Deliveries built from the event table.

    Every tenth is delivered twice, every 97th has no id, every 53rd is broken.
    """
    key = F.col("event_id")
    attributes = F.when(key % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("trace_id"), F.concat(F.lit("trace_"), (key % 500).cast("string")))
    )
    body = F.when(key % 53 == 0, F.concat(F.lit("{broken "), F.col("props"))).otherwise(F.col("props"))
    ident = F.when(key % 97 == 0, "").otherwise(F.concat(F.lit("msg-"), key.cast("string")))
    copies = F.when(key % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t.table("events").select(
        "event_id",
        messages.encode(body, attributes, ident, F.col("ts").cast("string")).alias("message"),
        F.lit("uploads").alias("subscription"),
        F.explode(copies).alias("delivery"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )


add_view(
    "v_messages",
    """SELECT event_id, CASE WHEN event_id % 97 = 0 THEN '' ELSE CONCAT('msg-', CAST(event_id AS STRING)) END AS message_id,
         CASE WHEN event_id % 3 = 0 THEN 'none' ELSE CONCAT('trace_', CAST(event_id % 500 AS STRING)) END AS trace_id,
         event_id % 53 = 0 AS broken, props, ts FROM events""",
)


@query(
    "a05_envelope_decode",
    """SELECT event_id, message_id, trace_id, CASE WHEN broken THEN CONCAT('{broken ', props) ELSE props END AS payload,
         CASE WHEN broken THEN 'bad_json' ELSE 'none' END AS problem FROM v_messages""",
)
def envelope_decode(t):
    decoded = messages.decode(push_messages(t).where("delivery = 1"))
    return decoded.select(
        "event_id",
        "message_id",
        F.coalesce("trace_id", F.lit("none")).alias("trace_id"),
        "payload",
        F.coalesce("problem", F.lit("none")).alias("problem"),
    )


@query(
    "a06_event_sink",
    """SELECT event_id, entity_id, event_type, CAST(CAST(occurred_at AS DATE) AS STRING) AS event_date FROM v_events""",
)
def event_sink(t):
    """The same batch appended twice leaves one copy of each event."""
    path = f"{storage.run_folder(t.spark)}/graph_events"
    batch = t.events().select("event_id", "entity_id", "event_type", "occurred_at")
    storage.append_events(batch, path)
    storage.append_events(batch, path)
    logged = t.spark.read.parquet(path)
    return logged.select("event_id", "entity_id", "event_type", F.col("event_date").cast("string").alias("event_date"))


@query(
    "a07_merge_upsert",
    """SELECT COALESCE(b.product_id, p.product_id) AS product_id, COALESCE(p.name, b.name) AS name,
         COALESCE(p.origin, b.origin) AS origin, COALESCE(b.product_type, 'none') AS product_type
       FROM v_products b FULL OUTER JOIN (
         SELECT CASE WHEN p_size = 1 THEN p_partkey + 1000000 ELSE p_partkey END AS product_id,
           CASE WHEN p_size > 25 THEN UPPER(p_name) END AS name, CASE WHEN p_size < 10 THEN 'N0' END AS origin
         FROM part WHERE p_size <> 7) p ON p.product_id = b.product_id""",
)
def merge_upsert(t):
    size = F.col("p_size")
    patch = t.table("part").where(size != 7).select(
        F.when(size == 1, F.col("p_partkey") + 1000000).otherwise(F.col("p_partkey")).alias("product_id"),
        F.when(size > 25, F.upper("p_name")).alias("name"),
        F.when(size < 10, "N0").alias("origin"),
    )
    merged = storage.merge_upsert(t.products(), patch, "product_id")
    return merged.withColumn("product_type", F.coalesce("product_type", F.lit("none")))


@query(
    "a08_clause_fan_out",
    """SELECT 'clause.extracted' AS topic,
         CONCAT('msg_', SUBSTRING(SHA256(CONCAT('clause.extracted|', CAST(clause_id AS STRING))), 1, 32)) AS message_id,
         CAST(TO_JSON({'clause_id': clause_id, 'document_id': document_id}) AS VARCHAR) AS data,
         CONCAT('trace_', CAST(document_id AS STRING)) AS trace_id FROM v_pending""",
)
def clause_fan_out(t):
    clauses = t.pending().withColumn("trace_id", F.concat(F.lit("trace_"), F.col("document_id").cast("string")))
    sent = messages.fan_out(clauses, "clause.extracted")
    return sent.select("topic", "message_id", "data", F.col("attributes")["trace_id"].alias("trace_id"))


@query(
    "a09_baseline_reset",
    """SELECT 'products' AS collection, COUNT(*) AS rows, CAST(0 AS BIGINT) AS differing FROM v_products
       UNION ALL SELECT 'markets', COUNT(*), 0 FROM nation UNION ALL SELECT 'clauses', COUNT(*), 0 FROM v_active""",
)
def baseline_reset(t):
    """Seed, change, seed again: the baseline comes back row for row."""
    folder = storage.run_folder(t.spark)
    baseline = {
        "products": t.products(),
        "markets": t.markets().withColumn("jurisdictions", F.array_join("jurisdictions", ",")),
        "clauses": t.active().select("clause_id", "jurisdiction", "substance", "limit_base", "status"),
    }
    first = storage.write_snapshot(baseline, f"{folder}/seed_1")
    again = storage.write_snapshot(baseline, f"{folder}/seed_2")
    report = None
    for name, left in first.items():
        differing = storage.snapshot_difference(left, again[name]).agg(F.count(F.lit(1)))
        counted = left.agg(F.count(F.lit(1)).alias("rows"))
        line = counted.select(F.lit(name).alias("collection"), "rows", differing.scalar().alias("differing"))
        report = line if report is None else report.unionByName(line)
    return report


@query(
    "a10_reprocess_documents",
    r"""SELECT doc_id, CAST(REGEXP_EXTRACT(text, 'level of ([^.\n]+) is ([0-9]+) ', 2) AS DECIMAL(18,6)) AS limit_value,
          REGEXP_EXTRACT(text, 'level of ([^.\n]+) is ([0-9]+) ', 1) AS raw_substance FROM v_limit_docs""",
)
def reprocess_documents(t):
    """A backfill over stored documents adds nothing: ids are derived from content."""
    from complyframe.functions.ids import prefixed_id

    found = extract.candidates(t.limit_docs(), "doc_id").withColumn(
        "clause_id", prefixed_id("clause", F.col("doc_id"), F.col("ordinal"), F.col("statement"), width=32)
    )
    folder = storage.run_folder(t.spark)
    stored = storage.written(found, f"{folder}/clauses")
    fresh = found.join(stored.select("clause_id"), "clause_id", "left_anti")
    both = stored.unionByName(fresh)
    return both.select("doc_id", "limit_value", "raw_substance")


_CATALOGUE_ROWS = ", ".join(
    f"('src{i}', '{row[0]}', {row[2]}, '{row[3]}', {repr(row[4]) if row[4] else 'NULL'})"
    for i, row in enumerate(SOURCE_CATALOGUE)
)


@query(
    "a11_source_catalogue",
    f"""SELECT d.doc_id AS document_id, COALESCE(c.file, 'none') AS file, COALESCE(c.sha256_prefix, 'none') AS sha256_prefix,
          COALESCE(CAST(c.in_force_from AS STRING), 'none') AS in_force_from FROM documents d
        LEFT JOIN (SELECT * FROM (VALUES {_CATALOGUE_ROWS}) AS t(source, file, pages, sha256_prefix, in_force_from)) c
          ON c.source = d.source""",
)
def source_catalogue(t):
    names = F.create_map(
        *[F.lit(x) for i, row in enumerate(SOURCE_CATALOGUE) for x in (row[0], f"src{i}")]
    )
    catalogue = source.source_catalogue(t.spark).withColumn("source", names[F.col("file")])
    joined = source.with_catalogue(t.documents(), catalogue, ["source"], "document_id")
    return joined.select(
        "document_id",
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c)
            for c in ("file", "sha256_prefix", "in_force_from")
        ],
    )
