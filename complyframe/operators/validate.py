"""Row validation: every check names its reason, both halves are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complyframe.constants import (
    MAX_BYTES,
    MAX_PAGES,
    NAME_MAX,
    ORIGIN_LENGTH,
    PACKAGING_MAX,
    PRODUCT_TYPES,
    UNIT_FACTORS,
)
from complyframe.functions import text

UNITS = tuple(dict.fromkeys(source for source, _ in UNIT_FACTORS))


def reasons(**checks: Column) -> Column:
    """Names of the failed checks, in the order given; each check is true when it fails."""
    flags = [F.when(F.coalesce(failed, F.lit(False)), F.lit(name)) for name, failed in checks.items()]
    return F.array_compact(F.array(*flags))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) of a frame that carries ``reasons``."""
    return df.where(F.size("reasons") == 0).drop("reasons"), df.where(F.size("reasons") > 0)


def _bad_length(column: Column, low: int, high: int) -> Column:
    return column.isNull() | ~F.length(column).between(low, high)


def ingredient_reasons(name: Column, amount: Column, raw_unit: Column) -> Column:
    return reasons(
        name_length=_bad_length(name, 1, NAME_MAX),
        amount_negative=amount < 0,
        amount_needs_unit=amount.isNotNull() & raw_unit.isNull(),
        unit_unknown=raw_unit.isNotNull() & ~raw_unit.isin(*UNITS),
    )


def check_ingredients(df: DataFrame) -> DataFrame:
    """Expects name, amount, unit."""
    return df.withColumn("reasons", ingredient_reasons(F.col("name"), F.col("amount"), F.col("unit")))


def check_products(df: DataFrame, product_types=PRODUCT_TYPES) -> DataFrame:
    """Expects name, product_type, origin, packaging."""
    return df.withColumn(
        "reasons",
        reasons(
            name_length=_bad_length(F.col("name"), 1, NAME_MAX),
            product_type_unknown=F.col("product_type").isNull() | ~F.col("product_type").isin(*product_types),
            origin_length=_bad_length(F.col("origin"), ORIGIN_LENGTH, ORIGIN_LENGTH),
            packaging_length=F.length("packaging") > PACKAGING_MAX,
        ),
    )


def check_candidates(df: DataFrame) -> DataFrame:
    """Expects raw_unit, limit_value, substance, unnormalized of extracted candidates."""
    return df.withColumn(
        "reasons",
        reasons(
            substance_unrecognised=F.coalesce("substance", F.lit("")).eqNullSafe("") | F.col("unnormalized"),
            limit_missing=F.col("limit_value").isNull(),
            limit_negative=F.col("limit_value") < 0,
            unit_unrecognised=text.unit(F.col("raw_unit"))["unit"].isNull(),
        ),
    )


def demote_unknown_units(df: DataFrame) -> DataFrame:
    """Keep a clause whose unit is not normalisable, as type ``other`` for review."""
    known = text.unit(F.col("raw_unit"))["unit"]
    return (
        df.withColumn("unit", known)
        .withColumn("status", F.when(known.isNull(), "needs_review").otherwise(F.col("status")))
        .withColumn("clause_type", F.when(known.isNull(), "other").otherwise(F.col("clause_type")))
    )


def admit_documents(df: DataFrame, max_pages: int = MAX_PAGES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Expects page_count, size_bytes; adds reject_reason (null when admitted)."""
    return df.withColumn(
        "reject_reason",
        F.when(F.col("page_count") > max_pages, "too_many_pages").when(F.col("size_bytes") > max_bytes, "too_large"),
    )
