"""Neighbours, positions and exact quantiles of ordered groups of any size.

A plain window sorts each group inside one task, which fails once a single key
holds a large share of the table. Here the caller names *levels*: columns that
cut a group into ordered slices (a day, then a range of ids), coarse to fine,
each consistent with the ordering. The window then runs per slice, one summary
row per slice is aggregated map-side, and the summaries are linked one level
up. The answer is the same as that of one window over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_slice(column: str, rows: int = 1 << 17) -> Column:
    """Slice of a dense numeric id; at most ``rows`` distinct ids share one."""
    return F.floor(F.col(column) / F.lit(rows)).cast("bigint")


def _ascending(columns: Sequence[str]) -> list[Column]:
    """Rows without a value come last, in windows as in :func:`_rank`."""
    return [F.asc_nulls_last(c) for c in columns]


def _rank(columns: Sequence[str]) -> Column:
    return F.struct(*[part for c in columns for part in (F.col(c).isNull(), F.col(c))])


def _joined(rows: DataFrame, slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys of which any may be null: a null key is a key."""
    renamed = slices.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return rows.join(renamed, same, "left").drop(*[f"_on_{k}" for k in keys])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    before: str | None = "before",
    after: str | None = None,
) -> DataFrame:
    """Add struct columns with the payload of the previous and/or the next row.

    Both sides share one sort of the slices; give None for a side not wanted.
    """
    held = df.withColumn("_held", F.struct(*payload))
    if before:
        held = held.withColumn("_last", F.col("_held"))
    if after:
        held = held.withColumn("_first", F.col("_held"))
    return _link(held, list(keys), list(levels), list(order), before, after).drop("_held", "_last", "_first")


def _link(df, keys, levels, order, before, after):
    """``_last`` and ``_first`` are what a row shows to the row after and before it."""
    slice_keys = keys + levels
    window = Window.partitionBy(*slice_keys).orderBy(*_ascending(order))
    linked = df
    if before:
        linked = linked.withColumn(before, F.lag("_last").over(window))
    if after:
        linked = linked.withColumn(after, F.lead("_first").over(window))
    if not levels:
        return linked
    edges = []
    if before:
        edges.append(F.max_by("_last", _rank(order)).alias("_last"))
    if after:
        edges.append(F.min_by("_first", _rank(order)).alias("_first"))
    outer = {name: f"_{side}_{len(levels)}" for side, name in (("before", before), ("after", after)) if name}
    summary = df.groupBy(*slice_keys).agg(*edges)
    beyond = _link(summary, keys, levels[:-1], levels[-1:], outer.get(before), outer.get(after))
    joined = _joined(linked, beyond.drop("_last", "_first"), slice_keys)
    return joined.withColumns({name: F.coalesce(name, far) for name, far in outer.items()}).drop(*outer.values())


def positions(
    df: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """Add the 1-based rank of each row within its group (order must be unique)."""
    slice_keys = [*keys, *levels]
    window = Window.partitionBy(*slice_keys).orderBy(*_ascending(order))
    ranked = df.withColumn(name, F.row_number().over(window).cast("bigint"))
    if not levels:
        return ranked
    sizes = df.groupBy(*slice_keys).agg(F.count(F.lit(1)).alias("_size"))
    offsets = _running(sizes, list(keys), list(levels)).drop("_size")
    joined = _joined(ranked, offsets, slice_keys)
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def _running(sizes: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """Add ``_before``: how many rows the earlier slices of the group hold."""
    within = Window.partitionBy(*keys, *levels[:-1]).orderBy(*_ascending(levels[-1:]))
    running = sizes.withColumn("_before", F.sum("_size").over(within) - F.col("_size"))
    if len(levels) == 1:
        return running
    parent = [*keys, *levels[:-1]]
    above = sizes.groupBy(*parent).agg(F.sum("_size").alias("_size"))
    offsets = _running(above, keys, levels[:-1]).select(*parent, F.col("_before").alias("_above"))
    joined = _joined(running, offsets, parent)
    return joined.withColumn("_before", F.col("_before") + F.col("_above")).drop("_above")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int], width: int = 1024
) -> DataFrame:
    """Exact nearest-rank percentiles of an integer column per group.

    Rows collapse to (key, value, count) map-side. Slices of ``width``
    consecutive values find the one slice that holds each rank, and only that
    slice is walked. Output: keys, percent, ``value``, ``n``.
    """
    if not keys:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, percents, width).drop("_all")
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_slice", F.floor(F.col(value) / F.lit(width)).cast("bigint"))
    )
    slices = counts.groupBy(*keys, "_slice").agg(F.sum("_size").alias("_slice_size"))
    totals = counts.groupBy(*keys).agg(F.sum("_size").alias("n"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    ranked = slices.withColumn("_until", F.sum("_slice_size").over(by_slice))
    wanted = totals.select(
        *keys,
        "n",
        F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"),
    ).withColumn("_rank", F.expr("(percent * n + 99) div 100"))
    target = ranked.join(wanted, keys)
    target = target.where("_rank <= _until AND _rank > _until - _slice_size").select(
        *keys, "percent", "n", "_slice", (F.col("_rank") - F.col("_until") + F.col("_slice_size")).alias("_inner")
    )
    walked = counts.join(target, [*keys, "_slice"])
    by_value = Window.partitionBy(*keys, "percent").orderBy(value)
    walked = walked.withColumn("_reach", F.sum("_size").over(by_value))
    return walked.where("_inner <= _reach AND _inner > _reach - _size").select(*keys, "percent", value, "n")
