"""Reading the event log: timelines, differences, transitions, audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complyframe.operators.ordered import neighbours, positions


# A busy entity is cut into days and those into minutes.
SLICES = ["_day", "_minute"]


def sliced(events: DataFrame, at: str) -> DataFrame:
    """Add the slice columns for time-ordered neighbours and positions."""
    return events.withColumns({"_day": F.to_date(at), "_minute": F.date_trunc("minute", F.col(at))})


def assemble(edges: Sequence[DataFrame], events: DataFrame) -> DataFrame:
    """Events of a product and of everything it depends on.

    ``edges``: (product_id, entity_id) frames.
    """
    reach = reduce(DataFrame.unionByName, edges).distinct()
    return reach.join(events, "entity_id")


def in_time_order(events: DataFrame, newest_first: bool = False) -> DataFrame:
    at = F.desc_nulls_last("occurred_at") if newest_first else F.asc_nulls_last("occurred_at")
    return events.orderBy(at, F.asc("event_id"))


def audit_gaps(mutations: DataFrame, events: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys with a mutation but no event, and the other way round; must be empty.

    One aggregation over both sides: a key with many rows collapses map-side.
    """
    made = mutations.select(*on, F.lit(True).alias("made"), F.lit(False).alias("logged"))
    logged = events.select(*on, F.lit(False).alias("made"), F.lit(True).alias("logged"))
    sides = made.unionByName(logged).groupBy(*on).agg(F.bool_or("made").alias("made"), F.bool_or("logged").alias("logged"))
    side = F.when(~F.col("logged"), "mutation_without_event").when(~F.col("made"), "event_without_mutation")
    return sides.select(side.alias("side"), *on).where("side IS NOT NULL")


def previous_states(
    events: DataFrame, entity: str, state: Sequence[str], at: str, key: str, levels: Sequence[str] = SLICES
) -> DataFrame:
    """Add struct ``previous``: the entity's state at its event before."""
    return neighbours(events, [entity], levels, [at, key], state, "previous")


def changed_keys(before: Column, after: Column) -> Column:
    """Sorted keys of two maps whose values differ, including keys of one side only."""
    keys = F.array_union(F.map_keys(before), F.map_keys(after))
    differing = F.filter(keys, lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k)))
    return F.array_sort(differing)


def transitions(events: DataFrame, entity: str, state: str, at: str, key: str) -> DataFrame:
    """Only the events at which the state differs from the one before; the first counts."""
    seen = previous_states(events, entity, [state], at, key)
    seen = seen.withColumn("was", F.col(f"previous.{state}")).drop("previous")
    return seen.where(~F.col(state).eqNullSafe(F.col("was")))


def illegal_moves(
    events: DataFrame, entity: str, state: str, at: str, key: str, allowed: Sequence[tuple]
) -> DataFrame:
    """Moves between states that the machine does not allow.

    The allowed list is a handful of fixed pairs, so it is an expression.
    """
    seen = previous_states(events, entity, [state], at, key)
    seen = seen.withColumn("was", F.col(f"previous.{state}")).drop("previous").where("was IS NOT NULL")
    moves = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    return seen.where(~F.array_contains(moves, F.concat("was", F.lit(">"), state)))


def latest(events: DataFrame, entity: str, fields: Sequence[str], at: str, key: str) -> DataFrame:
    """The newest event of each entity: aggregated map-side."""
    newest = F.max_by(F.struct(*fields), F.struct(at, key)).alias("_last")
    return events.groupBy(entity).agg(newest).select(entity, "_last.*")


def journeys(rows: DataFrame, trace: str, order: Sequence[str]) -> DataFrame:
    """Rows of each trace, numbered in order; long form, so a trace may be of any length."""
    return positions(rows, [trace], SLICES, order, "step")


def failed_documents(log: DataFrame) -> DataFrame:
    """Documents whose newest step failed, with the stage they failed from.

    Expects document_id, stage, at, seq.
    """
    seen = previous_states(sliced(log, "at"), "document_id", ["stage"], "at", "seq")
    seen = seen.withColumn("was", F.col("previous.stage"))
    return latest(seen, "document_id", ["stage", "at", "was"], "at", "seq").where("stage = 'failed'")
