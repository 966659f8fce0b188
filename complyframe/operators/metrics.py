"""Pipeline and quality metrics."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complyframe.constants import EXTRACT_P95_SECONDS, PROPAGATION_SECONDS
from complyframe.operators.ordered import neighbours, quantiles
from complyframe.operators.timeline import SLICES, sliced


def _count(df: DataFrame, stage: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n")


def funnel(stages: Mapping[str, DataFrame], counted: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Rows that reached each stage; ``counted`` are stages as frames of counts, column ``n``, to be added up."""
    rows = [_count(df, name) for name, df in stages.items()]
    for name, df in (counted or {}).items():
        total = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
        rows.append(df.agg(total.alias("n")).select(F.lit(name).alias("stage"), "n"))
    return reduce(DataFrame.unionByName, rows)


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def stage_durations(log: DataFrame) -> DataFrame:
    """Seconds from each stage entry of a document to its next one.

    Expects document_id, stage, at, seq. The last stage has no duration.
    """
    steps = sliced(log, "at")
    linked = neighbours(steps, ["document_id"], SLICES, ["at", "seq"], ["at"], before=None, after="_next")
    return linked.where("_next IS NOT NULL").select(
        "document_id", "stage", "seq", seconds_between(F.col("at"), F.col("_next.at")).alias("seconds")
    )


def stage_log_rows(documents: DataFrame) -> DataFrame:
    """The nested stage log of documents in long form."""
    return documents.select("document_id", F.posexplode("stage_log").alias("seq", "entry")).select(
        "document_id", "entry.stage", "entry.at", "seq"
    )


def duration_report(durations: DataFrame) -> DataFrame:
    """Median and 95th percentile per stage; extraction is flagged when it is too slow."""
    ranks = quantiles(durations, ["stage"], "seconds", [50, 95])
    wide = ranks.groupBy("stage").agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("percent") == 50, F.col("seconds"))).alias("p50"),
        F.max(F.when(F.col("percent") == 95, F.col("seconds"))).alias("p95"),
    )
    slow = (F.col("stage") == "extracting") & (F.col("p95") > EXTRACT_P95_SECONDS)
    return wide.withColumn("breach", slow)


def end_to_end(events: DataFrame, start: str, end: str, limit: int = PROPAGATION_SECONDS) -> DataFrame:
    """First start to the first end at or after it, per trace, in seconds; expects trace_id, event_type, occurred_at.

    Ends before the start belong to something else. A start without an end has
    no seconds and is a breach.
    """
    at = F.col("occurred_at")
    began = events.where(F.col("event_type") == start).groupBy("trace_id").agg(F.min("occurred_at").alias("started"))
    ends = events.where(F.col("event_type") == end).select("trace_id", at.alias("ended"))
    later = ends.join(began, "trace_id").where("ended >= started").groupBy("trace_id").agg(F.min("ended").alias("ended"))
    timed = began.join(later, "trace_id", "left").withColumn("seconds", seconds_between(F.col("started"), F.col("ended")))
    return timed.withColumn("breach", F.coalesce(F.col("seconds") > limit, F.lit(True))).drop("started", "ended")


def gauges(**flags: tuple[DataFrame, Column]) -> DataFrame:
    """Named counts of the rows a condition holds for."""
    counted = [
        df.agg(F.count_if(condition).alias("value")).select(F.lit(name).alias("gauge"), "value")
        for name, (df, condition) in flags.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def call_costs(calls: DataFrame) -> DataFrame:
    """Tokens and latency per stage and day."""
    daily = calls.withColumn("day", F.to_date("at"))
    totals = daily.groupBy("stage", "day").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("response_tokens").alias("response_tokens"),
        F.sum("latency_ms").alias("total_ms"),
    )
    p95 = quantiles(daily, ["stage", "day"], "latency_ms", [95]).select(
        "stage", "day", F.col("latency_ms").alias("p95_ms")
    )
    return totals.join(p95, ["stage", "day"], "left")


def confidence_histogram(clauses: DataFrame) -> DataFrame:
    """Clauses per tenth of confidence; 1.0 counts into the last."""
    tenth = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("bigint")
    return clauses.groupBy(tenth.alias("tenth")).agg(F.count(F.lit(1)).alias("clauses"))


def by_failing_field(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("reasons").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("rows"))
