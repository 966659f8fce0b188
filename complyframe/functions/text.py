"""Names, slugs, substances and units."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from complyframe.constants import BASE_UNIT, SUBSTANCE_SYNONYMS, UNIT_FACTORS, UNIT_SYNONYMS

AMOUNT = "decimal(18,6)"
# Java's \s is ASCII unless (?U) is set, and even then leaves out the four
# separator control characters.
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def _sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, Decimal):
        return f"CAST({value} AS DECIMAL(18,6))"
    return str(value)


def literal_map(pairs: dict) -> Column:
    """A constant map, parsed in one go and folded by the optimizer."""
    return F.expr("map(" + ", ".join(_sql_literal(x) for pair in pairs.items() for x in pair) + ")")


def name_key(name: Column) -> Column:
    """Lower case, one space between words, none around; null gives ''."""
    collapsed = F.regexp_replace(F.lower(name), _SPACES, " ")
    return F.coalesce(F.trim(collapsed), F.lit(""))


def slugify(value: Column) -> Column:
    slug = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_")
    return F.regexp_replace(slug, "^_+|_+$", "")


def name_parts(key: Column) -> Column:
    return F.transform(F.split(key, "[(),/]"), lambda part: F.trim(part))


def substance(name: Column, synonyms: dict[str, str] = SUBSTANCE_SYNONYMS) -> Column:
    """struct(normalized, unnormalized): whole key first, then its parts in order.

    The map is a literal, so no join is planned. It fits tens of entries; use
    ``normalize_by_join`` for a dictionary that is itself a table.
    """
    lookup = literal_map(synonyms)
    key = name_key(name)
    by_part = F.get(F.filter(F.transform(name_parts(key), lambda p: lookup[p]), F.isnotnull), F.lit(0))
    hit = F.coalesce(lookup[key], by_part)
    return F.struct(
        F.coalesce(hit, slugify(key)).alias("normalized"),
        hit.isNull().alias("unnormalized"),
    )


def unit(raw: Column) -> Column:
    """struct(unit, reason): exactly one of the two is null."""
    hit = literal_map(UNIT_SYNONYMS)[name_key(raw)]
    reason = F.when(raw.isNull(), "unit_required").when(hit.isNull(), "unrecognised_unit")
    return F.struct(F.when(raw.isNotNull(), hit).alias("unit"), reason.alias("reason"))


def convert(value: Column, source: Column, target: Column) -> Column:
    """Convert through the factor table; null where no factor is listed."""
    factors = literal_map({f"{a}>{b}": factor for (a, b), factor in UNIT_FACTORS.items()})
    return (value.cast(AMOUNT) * factors[F.concat(source, F.lit(">"), target)]).cast(AMOUNT)


def in_base_unit(value: Column, source: Column) -> Column:
    """Every known unit in mg/kg; null for an unknown unit."""
    factors = literal_map({a: factor for (a, b), factor in UNIT_FACTORS.items() if b == BASE_UNIT})
    return (value.cast(AMOUNT) * factors[source]).cast(AMOUNT)
