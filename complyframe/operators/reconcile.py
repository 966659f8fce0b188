"""Which clauses may be compared, what they are to each other, what becomes state.

A clause's *scope* is jurisdiction, substance, product type, clause type and
measurement basis. Within a scope the latest clause is current. Clauses of
different jurisdictions never replace each other; differing limits there are a
conflict in which both stay active.

Pairs are never enumerated over whole tables: counts come from grouped counts
joined on equal keys, and pair rows are produced between current clauses only,
of which there is one per scope.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from complyframe.constants import ANY_PRODUCT_TYPE
from complyframe.functions import scoring, text
from complyframe.functions.ids import prefixed_id
from complyframe.operators.joins import salted_join
from complyframe.operators.ordered import neighbours
from complyframe.sources import storage

SCOPE = ["jurisdiction", "substance", "product_type", "clause_type", "basis"]
RECENCY = ["effective_date", "document_date", "clause_id"]


def comparable_form(clauses: DataFrame) -> DataFrame:
    """Add basis (by weight unless stated) and the limit in the base unit."""
    if "basis" not in clauses.columns:
        clauses = clauses.withColumn("basis", F.lit(None).cast("string"))
    # Every known unit is a mass fraction, hence the default basis.
    return clauses.withColumn("basis", F.coalesce("basis", F.lit("per_weight"))).withColumn(
        "limit_base", text.in_base_unit(F.col("limit_value"), F.col("unit"))
    )


def needs_review(clauses: DataFrame) -> DataFrame:
    """Add ``gated``: too uncertain or too weak a source to change state."""
    return clauses.withColumn("gated", scoring.review_gate(F.col("confidence"), F.col("authority_tier")))


def _recency() -> Column:
    return F.struct(*RECENCY)


def current_clauses(clauses: DataFrame) -> DataFrame:
    """The latest numeric clause of each scope, and all others: only limits replace each other.

    Map-side aggregated, so no hot scope.
    """
    columns = clauses.columns
    numeric = F.coalesce(F.col("clause_type") == "numeric_limit", F.lit(False))
    latest = clauses.where(numeric).groupBy(*SCOPE).agg(F.max_by(F.struct(*columns), _recency()).alias("_row"))
    return latest.select("_row.*").unionByName(clauses.where(~numeric))


def _chain_slices(clauses: DataFrame) -> DataFrame:
    numeric_id = dict(clauses.dtypes)["clause_id"] in ("bigint", "int")
    part = F.floor(F.col("clause_id") / F.lit(1 << 17)) if numeric_id else F.substring("clause_id", 1, 12)
    return clauses.withColumn("_slice", F.struct("document_date", part.alias("part")))


def supersede_chain(clauses: DataFrame, keys: Sequence[str] = SCOPE) -> DataFrame:
    """Add supersedes, superseded_by (neighbours in the scope) and the limit change.

    ``change`` is limit_tightened, limit_loosened, or null where nothing changed.
    """
    sliced = _chain_slices(clauses.drop("supersedes", "superseded_by"))
    levels = ["effective_date", "_slice"]
    linked = neighbours(sliced, keys, levels, ["clause_id"], ["clause_id", "limit_base"], "_before", "_after")
    old, new = F.col("_before.limit_base"), F.col("limit_base")
    return linked.withColumns(
        {
            "supersedes": F.col("_before.clause_id"),
            "superseded_by": F.col("_after.clause_id"),
            "change": F.when(new < old, "limit_tightened").when(new > old, "limit_loosened"),
        }
    ).drop("_before", "_after", "_slice")


DATES = ("effective_date", "document_date")


def date_conflicts(clauses: DataFrame, dates: Sequence[str] = DATES) -> DataFrame:
    """Scopes and dates at which clauses give different limits: undecidable by date."""
    return (
        clauses.groupBy(*SCOPE, *dates)
        .agg(
            F.count(F.lit(1)).alias("clauses"),
            F.min("limit_base").alias("lowest"),
            F.max("limit_base").alias("highest"),
        )
        .where("lowest <> highest")
        .withColumn("type", F.lit("effective_date_conflict"))
    )


# --- Pairs -------------------------------------------------------------------


def compatible_types(a: Column, b: Column) -> Column:
    """Equal, or one is the documented superset of all types."""
    return (a == b) | (a == ANY_PRODUCT_TYPE) | (b == ANY_PRODUCT_TYPE)


def type_closure(types: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(product_type, ancestor): itself, the catch-all, and any documented parents."""
    own = types.select("product_type", F.col("product_type").alias("ancestor"))
    every = types.select("product_type", F.lit(ANY_PRODUCT_TYPE).alias("ancestor"))
    closure = own.unionByName(every)
    return (closure if parents is None else closure.unionByName(parents)).distinct()


def guardrail_reason(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """First reason why two clauses may not be compared; null when they may."""
    convertible = text.convert(F.lit(1), a("unit"), b("unit")).isNotNull()
    numeric = (a("clause_type") == "numeric_limit") & (b("clause_type") == "numeric_limit")
    return (
        F.when(~a("substance").eqNullSafe(b("substance")), "substance_mismatch")
        .when(~F.coalesce(compatible_types(a("product_type"), b("product_type")), F.lit(False)), "product_type_mismatch")
        .when(~convertible, "unit_mismatch")
        .when(~a("basis").eqNullSafe(b("basis")), "basis_mismatch")
        .when(~numeric, "clause_type_mismatch")
    )


def relationship(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """What a comparable pair is; a pair with equal limits is no finding at all."""
    return (
        F.when(a("limit_base") == b("limit_base"), "no_finding")
        .when(a("jurisdiction") == b("jurisdiction"), "supersede_question")
        .otherwise("cross_jurisdiction_conflict")
    )


def _side(prefix: str) -> Callable[[str], Column]:
    return lambda name: F.col(f"{prefix}_{name}")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def candidate_pairs(new: DataFrame, current: DataFrame) -> DataFrame:
    """Pairs worth checking: same substance, or same jurisdiction.

    Two equality joins that cannot overlap, instead of one OR join. ``current``
    holds one clause per scope, so a new clause meets a bounded number of them.
    """
    a, b = _prefixed(new, "a"), _prefixed(current, "b")
    spread = ["a_clause_id"]
    by_substance = salted_join(
        a.withColumn("_key", F.col("a_substance")), b.withColumn("_key", F.col("b_substance")), ["_key"], spread
    )
    by_jurisdiction = salted_join(
        a.withColumn("_key", F.col("a_jurisdiction")), b.withColumn("_key", F.col("b_jurisdiction")), ["_key"], spread
    ).where(~F.col("a_substance").eqNullSafe(F.col("b_substance")))
    return by_substance.unionByName(by_jurisdiction).drop("_key")


def judged_pairs(pairs: DataFrame) -> DataFrame:
    """Add the guardrail's reason and, for comparable pairs, the relationship."""
    a, b = _side("a"), _side("b")
    return pairs.withColumn("reason", guardrail_reason(a, b)).withColumn(
        "relationship", F.when(F.col("reason").isNull(), relationship(a, b))
    )


def candidate_counts(new: DataFrame, active: DataFrame) -> DataFrame:
    """Per new clause, how many active clauses share its substance, jurisdiction, both."""
    by_substance = active.groupBy("substance").agg(F.count(F.lit(1)).alias("same_substance"))
    by_jurisdiction = active.groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("same_jurisdiction"))
    by_both = active.groupBy("substance", "jurisdiction").agg(F.count(F.lit(1)).alias("same_both"))
    ids = new.select("clause_id", "substance", "jurisdiction")
    counted = salted_join(ids, by_substance, ["substance"], ["clause_id"], "left")
    counted = salted_join(counted, by_jurisdiction, ["jurisdiction"], ["clause_id"], "left")
    counted = salted_join(counted, by_both, ["substance", "jurisdiction"], ["clause_id"], "left")
    counted = counted.fillna(0, ["same_substance", "same_jurisdiction", "same_both"])
    return counted.withColumn("candidates", F.expr("same_substance + same_jurisdiction - same_both"))


_PROFILE = ["substance", "product_type", "unit", "basis", "clause_type"]


def _counted(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def guardrail_counts(new: DataFrame, active: DataFrame, by: str = "substance") -> DataFrame:
    """Candidate pairs per (``by`` of the new clause, decision), exactly.

    The guardrail reads enumerated columns only, so it is decided once per pair
    of profiles and weighted. Pairs that share just the jurisdiction fail on
    substance; they are counted by subtraction.
    """
    extra = [] if by in _PROFILE else [by]
    a = _prefixed(_counted(new, [*_PROFILE, *extra], "n"), "a")
    b = _prefixed(_counted(active, _PROFILE, "n"), "b")
    profiles = salted_join(a.withColumn("_key", F.col("a_substance")), b.withColumn("_key", F.col("b_substance")),
                           ["_key"], a.columns)
    decided = profiles.select(
        F.col(f"a_{by}").alias(by),
        F.coalesce(guardrail_reason(_side("a"), _side("b")), F.lit("comparable")).alias("decision"),
        (F.col("a_n") * F.col("b_n")).alias("pairs"),
    )
    both = ["jurisdiction", "substance"]
    new_both, active_both = _counted(new, [*both, *extra], "n"), _counted(active, both, "m")
    in_jurisdiction = active_both.groupBy("jurisdiction").agg(F.sum("m").alias("all_m"))
    elsewhere = (
        new_both.join(in_jurisdiction, "jurisdiction")
        .join(active_both, both, "left")
        .select(
            by,
            F.lit("substance_mismatch").alias("decision"),
            (F.col("n") * (F.col("all_m") - F.coalesce("m", F.lit(0)))).alias("pairs"),
        )
    )
    return (
        decided.unionByName(elsewhere).groupBy(by, "decision").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")
    )


def _matches(new: DataFrame, active: DataFrame, equal: Sequence[str], name: str) -> DataFrame:
    """Comparable pairs that also agree on ``equal``, summed per substance."""
    keys = ["substance", "basis", *equal]
    a = _counted(new, [*keys, "product_type"], "n").withColumnRenamed("product_type", "a_type")
    b = _counted(active, [*keys, "product_type"], "m").withColumnRenamed("product_type", "b_type")
    met = a.join(b, keys).where(compatible_types(F.col("a_type"), F.col("b_type")))
    return met.groupBy("substance").agg(F.sum(F.col("n") * F.col("m")).alias(name))


def relationship_counts(new: DataFrame, active: DataFrame) -> DataFrame:
    """Comparable pairs per substance by relationship, plus those dates cannot settle."""
    new, active = (df.where("clause_type = 'numeric_limit' AND limit_base IS NOT NULL") for df in (new, active))
    here, dates = ["jurisdiction"], ["effective_date", "document_date"]
    counts = _matches(new, active, [], "comparable")
    for equal, name in (
        (here, "same"),
        (["limit_base"], "equal"),
        ([*here, "limit_base"], "same_equal"),
        ([*here, *dates], "dated"),
        ([*here, *dates, "limit_base"], "dated_equal"),
    ):
        counts = counts.join(_matches(new, active, equal, name), "substance", "left")
    counts = counts.fillna(0)
    return counts.select(
        "substance",
        "comparable",
        F.col("equal").alias("no_finding"),
        F.expr("same - same_equal").alias("supersede_question"),
        F.expr("comparable - same - equal + same_equal").alias("cross_jurisdiction_conflict"),
        F.expr("dated - dated_equal").alias("ambiguous"),
    )


def conflicts(current: DataFrame) -> DataFrame:
    """Current numeric limits of different jurisdictions that differ.

    One clause per scope on both sides, so the number of rows depends on the
    jurisdictions that regulate a substance and not on the number of clauses.
    """
    limits = current.where("clause_type = 'numeric_limit' AND limit_base IS NOT NULL").select(
        "clause_id", "substance", "basis", "product_type", "jurisdiction", "limit_base"
    )
    a, b = _prefixed(limits, "a"), _prefixed(limits, "b")
    met = a.join(
        b,
        (F.col("a_substance") == F.col("b_substance"))
        & (F.col("a_basis") == F.col("b_basis"))
        & (F.col("a_jurisdiction") != F.col("b_jurisdiction"))
        & (F.col("a_clause_id") < F.col("b_clause_id"))
        & (F.col("a_limit_base") != F.col("b_limit_base"))
        & compatible_types(F.col("a_product_type"), F.col("b_product_type")),
    )
    return met.select(
        F.col("a_clause_id").alias("clause_a"),
        F.col("b_clause_id").alias("clause_b"),
        F.lit("cross_jurisdiction_limit_mismatch").alias("type"),
        F.col("a_substance").alias("substance"),
        F.struct(
            F.col("a_limit_base").alias("a"), F.col("b_limit_base").alias("b"), F.lit("mg_per_kg").alias("unit")
        ).alias("detail"),
        F.lit("high").alias("severity"),
        F.lit("open").alias("status"),
        F.lit("reconciliation").alias("detected_by"),
    )


# --- Verdicts ----------------------------------------------------------------


def _cuts(pool: DataFrame) -> DataFrame:
    """Per scope, the last clause whose limit is not the current one, as ``_cut``.

    The newest clause of each distinct limit is enough to tell: the first of
    them is current, the second is the cut.
    """
    newest = pool.groupBy(*SCOPE, "limit_base").agg(F.max(_recency()).alias("_cut"))
    ranked = newest.withColumn("_n", F.row_number().over(Window.partitionBy(*SCOPE).orderBy(F.desc("_cut"))))
    return ranked.where("_n <= 2").where("_n = 2").select(*SCOPE, "_cut")


def verdicts(
    clauses: DataFrame, settled: DataFrame | None = None, history: DataFrame | None = None
) -> DataFrame:
    """New status of every active or pending clause, whatever order they came in.

    Gated clauses, and pending ones that contradict another at the same dates,
    go to review and touch nothing. Of the rest, a clause is superseded when a
    later one in its scope gives another limit. Everything is one pass over old
    and new together, so the outcome does not depend on arrival order.

    ``history`` holds clauses superseded earlier, in comparable form: what they
    replaced stays replaced, and what contradicts them at their dates goes to
    review, so arrival in several batches ends the same way.
    ``settled`` (clause_id, verdict) may decide ambiguous clauses: "keep" lets
    one take part, anything else leaves it for review.
    """
    pending, numeric = F.col("was") == "pending_reconciliation", F.col("clause_type") == "numeric_limit"
    live = clauses.where("status IN ('active', 'pending_reconciliation')").withColumn("was", F.col("status"))
    # A numeric clause without a usable limit is absent data: for review too.
    usable = F.col("limit_base").isNotNull()
    live = needs_review(live).withColumn("gated", pending & (F.col("gated") | (numeric & ~usable)))
    live = live.withColumn("_in", numeric & usable & ~F.col("gated"))

    # Rows that take no part keep _in = false and meet nothing in the joins.
    tie = [*SCOPE, *DATES, "_in"]
    dated = live.where("_in").select(*SCOPE, *DATES, "limit_base")
    if history is not None:
        dated = dated.unionByName(history.where(numeric & usable).select(*SCOPE, *DATES, "limit_base"))
    ties = date_conflicts(dated).withColumns({"_in": F.lit(True), "_tied": F.lit(True)})
    live = salted_join(live, ties.select(*tie, "_tied"), tie, ["clause_id"], "left", null_safe=True)
    unsettled = F.coalesce("_tied", F.lit(False)) & pending
    if settled is not None:
        keep = settled.where("verdict = 'keep'").select("clause_id", F.lit(True).alias("_keep")).distinct()
        live = live.join(keep, "clause_id", "left")
        unsettled = unsettled & F.col("_keep").isNull()
    live = live.withColumn("_review", F.col("gated") | unsettled).withColumn("_in", F.col("_in") & ~F.col("_review"))

    limits = [*SCOPE, *RECENCY, "limit_base"]
    seen = live.where("_in").select(*limits)
    if history is not None:
        seen = seen.unionByName(history.where(numeric & usable).select(*limits))
    cuts = _cuts(seen).withColumn("_in", F.lit(True))
    live = salted_join(live, cuts, [*SCOPE, "_in"], ["clause_id"], "left", null_safe=True)
    replaced = F.coalesce(_recency() <= F.col("_cut"), F.lit(False))
    # Written once: the chain reads it several times. Rows that take no part have no neighbours.
    live = live.withColumn("_replaced", replaced).drop("supersedes", "superseded_by")
    live = storage.written(live, storage.run_folder(live.sparkSession))
    chained = supersede_chain(live.where("_in"))
    links = ("supersedes", "superseded_by", "change")
    alone = live.where("NOT _in").withColumns({c: F.lit(None).cast(dict(chained.dtypes)[c]) for c in links})
    linked = chained.unionByName(alone)

    changed = F.col("_in") & F.col("change").isNotNull()
    gone, review = F.col("_replaced"), F.col("_review")
    return linked.withColumns(
        {
            "status": F.when(review, "needs_review").when(gone, "superseded").otherwise("active"),
            "verdict": F.when(review, "needs_review")
            .when(F.col("was") == "active", F.when(gone, "superseded").otherwise("unchanged"))
            .when(changed, "supersedes")
            .when(gone, "superseded")
            .otherwise("new"),
            "supersedes": F.when(changed, F.col("supersedes")),
            "superseded_by": F.when(gone, F.col("superseded_by")),
            "change": F.when(changed, F.col("change")),
        }
    ).drop("_in", "_tied", "_keep", "_review", "_cut", "_replaced")


EVENT_OF_VERDICT = {
    ("pending_reconciliation", "active"): "clause_created",
    ("pending_reconciliation", "superseded"): "clause_superseded",
    ("active", "superseded"): "clause_superseded",
    ("pending_reconciliation", "needs_review"): "clause_flagged_review",
}


def verdict_events(decided: DataFrame) -> DataFrame:
    """One audit event per clause whose status moved."""
    event = F.lit(None).cast("string")
    for (was, now), name in EVENT_OF_VERDICT.items():
        event = F.when((F.col("was") == was) & (F.col("status") == now), name).otherwise(event)
    return decided.withColumn("event_type", event).where("event_type IS NOT NULL").select(
        prefixed_id("evt", F.col("event_type"), F.col("clause_id"), F.col("status"), width=32).alias("event_id"),
        "event_type",
        F.lit("clause").alias("entity_type"),
        F.col("clause_id").cast("string").alias("entity_id"),
        F.to_json(F.struct(F.col("was").alias("status"))).alias("before"),
        F.to_json(F.struct("status", F.col("superseded_by"))).alias("after"),
        F.to_json(F.struct("document_id", "clause_id")).alias("cause"),
        F.lit("reconciliation").alias("triggered_by"),
        "confidence",
    )


def conflict_events(opened: DataFrame) -> DataFrame:
    key = F.concat_ws(":", F.col("clause_a").cast("string"), F.col("clause_b").cast("string"))
    return opened.select(
        prefixed_id("evt", F.lit("conflict_opened"), key, width=32).alias("event_id"),
        F.lit("conflict_opened").alias("event_type"),
        F.lit("conflict").alias("entity_type"),
        key.alias("entity_id"),
        F.lit(None).cast("string").alias("before"),
        F.to_json("detail").alias("after"),
        F.to_json(F.struct("clause_a", "clause_b")).alias("cause"),
        F.lit("reconciliation").alias("triggered_by"),
        F.lit(None).cast("decimal(18,6)").alias("confidence"),
    )


def newly_opened(after: DataFrame, before: DataFrame) -> DataFrame:
    return after.join(before.select("clause_a", "clause_b"), ["clause_a", "clause_b"], "left_anti")
