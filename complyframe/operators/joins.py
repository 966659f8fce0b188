"""Joins for keys of which one may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Rows of one key that travel and meet as one.
PACK = 256


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
    null_safe: bool = False,
    broadcast: bool = True,
    dealt: bool = False,
    in_packs: bool = False,
) -> DataFrame:
    """Equi-join that spreads each key of ``facts`` over ``salts`` tasks.

    ``lookup`` must be the side with few rows per key; it is repeated once per
    salt. ``spread`` names the columns that tell the rows of one key apart.
    Spark still broadcasts ``lookup`` by itself where its size allows that; an
    unpivot, unlike an explode, counts there as all of its copies.
    With ``null_safe`` a null in a key meets a null. Without ``broadcast`` both
    sides are shuffled whatever the size Spark takes the copies for. With
    ``dealt`` they go to several partitions per task: where few bytes become many
    rows, adaptive execution would leave these to a few tasks of uneven size.
    ``in_packs`` is for an inner join with a ``lookup`` of hundreds of rows per
    key: packs of these travel and meet ``facts``, and are rows again afterwards.
    """
    if in_packs:
        return unpacked(salted_join(facts, packed(lookup, on), on, spread, how, salts, null_safe, broadcast, dealt))
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salting the left side does not fit a {how} join")
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    names = [f"_salt_{n}" for n in range(salts)]
    copies = lookup.select("*", *[F.lit(n).alias(name) for n, name in enumerate(names)])
    repeated = copies.unpivot(lookup.columns, names, "_copy", "_salt").drop("_copy")
    if dealt:
        partitions = 4 * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted, repeated = (side.repartition(partitions, *on, "_salt") for side in (salted, repeated))
    repeated = repeated if broadcast else repeated.hint("merge")
    if not null_safe:
        return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
    renamed = repeated.withColumnsRenamed({c: f"_on_{c}" for c in (*on, "_salt")})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in (*on, "_salt")]
    return salted.join(renamed, same, how).drop("_salt", *[f"_on_{c}" for c in (*on, "_salt")])


def shuffled_join(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on many keys of which none holds a large share, with ``lookup`` neither repeated nor broadcast.

    Spark goes by compressed files, and a lookup of a few MB there may be
    hundreds once it is a hash table in the driver. A partition that is crowded
    all the same is split by adaptive execution.
    """
    return facts.join(lookup.hint("merge"), list(on), how)


def packed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` with ``_rows``, some `PACK` rows of one key each; a key with more has several."""
    body = [c for c in rows.columns if c not in keys]
    sizes = rows.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    part = F.pmod(F.xxhash64(*body), F.ceil(F.col("_n") / PACK)).alias("_part")
    counted = rows.join(sizes, same).select(*keys, part, F.struct(*body).alias("_row"))
    return counted.groupBy(*keys, "_part").agg(F.collect_list("_row").alias("_rows")).drop("_part")


def unpacked(packs: DataFrame) -> DataFrame:
    """The rows of `packed`, each with what its pack has been joined with."""
    return packs.select(*[c for c in packs.columns if c != "_rows"], F.inline("_rows"))
