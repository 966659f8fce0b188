"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complyframe.operators.ordered import positions

#: Hash slices within which rows of a shard are numbered.
SLICES = 256


def cost(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight for u uniform in (0, 1] by key and shard; the lowest cost wins.

    u comes from 52 bits of MD5 over ``key:shard``, which any language can redo.
    """
    drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return -F.log((drawn + 1) / float(1 << 52)) / float(weight)


def shard_of(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The shard of a key, given (number, weight) pairs; a tie goes to the lower number."""
    return F.least(*[F.struct(cost(key, n, w).alias("cost"), F.lit(n).alias("shard")) for n, w in shards])["shard"]


def assign(
    df: DataFrame,
    shards: Sequence[tuple[int, float]],
    grown: tuple[int, float] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot, and ``grown_shard`` once the shard ``grown`` joins.

    A key's cost at a shard depends on nothing but the two, so a new shard can
    only win rows for itself and a removed one only gives up its own. Shares
    follow the weights. ``slot`` numbers the rows of a shard from 0 without
    gaps; rows are counted per hash slice, so no shard is sorted in one task.

    Size is the text's UTF-8 bytes plus 16, a null text has none and the CRC of
    an empty one. A null id is a key of its own. Rows that repeat an id share
    its shard and get a slot each. Other columns are dropped.
    """
    key = F.coalesce(F.col(id_column).cast("string"), F.lit("\\N"))
    data = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_column).alias("doc_id"),
        key.alias("_key"),
        (F.octet_length(data) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    best = F.least(*[F.struct(cost(F.col("_key"), n, w).alias("cost"), F.lit(n).alias("shard")) for n, w in shards])
    rows = rows.withColumn("_best", best)
    late = F.lit(None).cast("int")
    if grown:
        late = F.when(cost(F.col("_key"), *grown) < F.col("_best.cost"), F.lit(grown[0])).otherwise(F.col("_best.shard"))
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("_best.shard").alias("shard"),
        late.alias("grown_shard"),
        F.pmod(F.xxhash64("_key"), F.lit(SLICES)).cast("int").alias("_slice"),
    )
    order = ["doc_id", "text_crc32", "size"]
    numbered = positions(rows, ["shard"], ["_slice"], order, "slot")
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"), "grown_shard")
