"""State is the fold of accepted changes.

Each operator takes current state and a frame of changes and gives back
(new snapshot, events): both come from one frame of decisions, so neither can
exist without the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complyframe.constants import WORKSPACE_ID
from complyframe.functions import text
from complyframe.functions.ids import prefixed_id
from complyframe.operators import validate
from complyframe.operators.joins import salted_join


def normalised_ingredients(ingredients: Column) -> Column:
    """Recompute the normalised name of every ingredient; what the client sent is ignored."""

    def one(i: Column) -> Column:
        name = text.substance(i["name"])
        return F.struct(
            i["name"].alias("name"),
            name["normalized"].alias("normalized"),
            name["unnormalized"].alias("unnormalized"),
            i["amount"].cast(text.AMOUNT).alias("amount"),
            i["unit"].alias("unit"),
        )

    return F.transform(F.coalesce(ingredients, F.array().cast("array<struct<name:string,amount:decimal(18,6),unit:string>>")), one)


def checked_products(requests: DataFrame) -> DataFrame:
    """Add ``reasons``: the product's own, then those of any ingredient."""
    checked = validate.check_products(requests)
    inner = F.flatten(
        F.transform("ingredients", lambda i: validate.ingredient_reasons(i["name"], i["amount"], i["unit"]))
    )
    return checked.withColumn("reasons", F.concat("reasons", F.coalesce(F.array_distinct(inner), F.array().cast("array<string>"))))


def create_products(requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, events, quarantine) for a batch of new products."""
    valid, quarantine = validate.split(checked_products(requests))
    products = valid.select(
        "id",
        F.lit(WORKSPACE_ID).alias("workspace_id"),
        "name",
        "product_type",
        F.upper("origin").alias("origin"),
        "packaging",
        normalised_ingredients(F.col("ingredients")).alias("ingredients"),
        F.coalesce("target_markets", F.array().cast("array<string>")).alias("target_markets"),
        F.col("requested_at").alias("created_at"),
        F.col("requested_at").alias("updated_at"),
    )
    record = F.struct(*[F.col(c) for c in products.columns if c not in ("id", "created_at", "updated_at")])
    events = products.select(
        prefixed_id("evt", F.lit("product_created"), F.col("id"), width=32).alias("event_id"),
        F.lit("product_created").alias("event_type"),
        F.lit("product").alias("entity_type"),
        F.col("id").alias("entity_id"),
        F.lit(None).cast("string").alias("before"),
        F.to_json(record, {"ignoreNullFields": "false"}).alias("after"),
        F.col("created_at").alias("occurred_at"),
    )
    return products, events, quarantine


def changed_fields_json(fields: Sequence[str], changed: dict[str, Column], values: dict[str, Column]) -> Column:
    """JSON of the changed fields only; a changed field that is null is kept as null."""
    entries = [
        F.when(changed[f], F.concat(F.to_json(F.create_map(F.lit(f), values[f]), {"ignoreNullFields": "false"})))
        for f in fields
    ]
    inner = F.transform(F.array_compact(F.array(*entries)), lambda e: F.substring(e, F.lit(2), F.length(e) - 2))
    return F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}"))


def folded_patches(patches: DataFrame, key: str, at: str) -> DataFrame:
    """One patch per id: of each field the last value given, by ``at``; ties go to the larger value."""
    fields = [c for c in patches.columns if c not in (key, at)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(at, F.col(c).cast("string")))).alias(c) for c in fields]
    return patches.groupBy(key).agg(*last)


def patch_rows(base: DataFrame, patches: DataFrame, key: str, upper: Sequence[str] = ("origin",)) -> DataFrame:
    """Every base row with its patch applied, ``changed`` and JSON ``before``/``after``.

    Null leaves a field as it is. A field given the value it has still counts
    as changed. Several patches of one id are folded first: by ``patched_at``
    where they have that column, else field by field, the largest value last.
    """
    if "patched_at" not in patches.columns:
        patches = patches.withColumn("patched_at", F.lit(0))
    patches = folded_patches(patches, key, "patched_at")
    fields = [c for c in patches.columns if c != key]
    p = patches.select(
        key, *[(F.upper(c) if c in upper else F.col(c)).alias(f"_{c}") for c in fields]
    )
    joined = base.join(p, key, "left")
    given = {c: F.col(f"_{c}").isNotNull() for c in fields}
    before = changed_fields_json(fields, given, {c: F.col(c) for c in fields})
    after = changed_fields_json(fields, given, {c: F.col(f"_{c}") for c in fields})
    any_given = F.lit(False)
    for flag in given.values():
        any_given = any_given | flag
    marked = joined.withColumns({"changed": any_given, "before": before, "after": after})
    return marked.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(*[f"_{c}" for c in fields])


def patch_products(base: DataFrame, patches: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot, events): an empty patch writes no event."""
    rows = patch_rows(base, patches, key)
    events = rows.where("changed").select(
        prefixed_id("evt", F.lit("product_updated"), F.col(key), F.col("after"), width=32).alias("event_id"),
        F.lit("product_updated").alias("event_type"),
        F.lit("product").alias("entity_type"),
        F.col(key).cast("string").alias("entity_id"),
        "before",
        "after",
    )
    return rows.drop("changed", "before", "after"), events


def apply_moves(
    state: DataFrame, actions: DataFrame, key: str, allowed: Sequence[tuple[str, str]]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshot, accepted, rejected): set statuses people asked for, where the machine allows it.

    ``actions``: key, to. The rejected ones come with the status they found.
    """
    moves = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    wanted = actions.groupBy(key).agg(F.max("to").alias("to"))
    joined = salted_join(state, wanted, [key], [key], "left")
    legal = F.array_contains(moves, F.concat("status", F.lit(">"), "to"))
    judged = joined.withColumn("_legal", F.coalesce(legal, F.lit(False)))
    asked = judged.where("to IS NOT NULL").select(key, F.col("status").alias("was"), "to", "_legal")
    snapshot = judged.withColumn("status", F.when(F.col("_legal"), F.col("to")).otherwise(F.col("status")))
    return (
        snapshot.drop("to", "_legal"),
        asked.where("_legal").drop("_legal"),
        asked.where("NOT _legal").drop("_legal"),
    )


def advance_documents(documents: DataFrame, steps: DataFrame) -> DataFrame:
    """Documents with the status and error of their newest step.

    ``steps``: document_id, stage, at, seq, error. The steps themselves are
    appended to the stage log, which is kept in long form and never gathered.
    """
    newest = latest_status(steps).select(
        "document_id", F.col("status").alias("_status"), F.col("error").alias("_error"), F.lit(True).alias("_moved")
    )
    joined = documents.join(newest, "document_id", "left")
    return joined.withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "error": F.when(F.col("_moved"), F.col("_error")).otherwise(F.col("error")),
        }
    ).drop("_status", "_error", "_moved")


def latest_status(steps: DataFrame) -> DataFrame:
    """Status per document from its steps alone: aggregated map-side."""
    last = F.max_by(F.struct("stage", "error"), F.struct("at", "seq")).alias("_last")
    return steps.groupBy("document_id").agg(
        last, F.count(F.lit(1)).alias("steps"), F.count_if(F.col("stage") == "failed").alias("failures")
    ).select("document_id", F.col("_last.stage").alias("status"), F.col("_last.error").alias("error"), "steps", "failures")


def fold(events: DataFrame, entity: str, after: str, at: str, key: str) -> DataFrame:
    """Current state of each entity: what its newest event says."""
    return events.groupBy(entity).agg(F.max_by(after, F.struct(at, key)).alias("state"))
