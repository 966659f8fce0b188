"""From document text to clause candidates, and how far to trust them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complyframe.constants import SUBSTANCE_SYNONYMS, UNIT_SYNONYMS
from complyframe.functions import text
from complyframe.operators.joins import salted_join

# Ours: how a limit is stated in prose. Groups: substance, number, raw unit. The
# listed unit spellings go first, so that prose behind them is not taken along.
_LISTED_UNITS = "|".join(re.escape(u) for u in sorted(UNIT_SYNONYMS, key=lambda u: (-len(u), u)))
OPENING = r"(?:maximum|permitted) (?:level|limit|amount) of\s"
NUMBER = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:[.,][0-9]+)?"
# A statement stays within its sentence, which may run over a line end but not over an empty line. Without
# a unit it is still a statement, for review.
STATEMENT = rf"(?is){OPENING}((?:(?!(?-i:\.\s+[A-Z])|\n\s*\n).)+?)\sis\s({NUMBER})(?: ?((?:{_LISTED_UNITS})(?![a-z/_])|[a-z%][a-z/% ]*))?"

# Ours: what makes a section worth extracting from, tried in this order.
CATEGORIES = (
    ("limit", "maximum level|maximum limit|mg/kg|ppm|percent|not exceed"),
    ("labeling", "label"),
    ("documentation", "document|dossier"),
    ("certification", "certif"),
)


def mentions(body: Column, synonyms: dict[str, str] = SUBSTANCE_SYNONYMS) -> Column:
    """Canonical substances named anywhere in the text, each once."""
    longest_first = sorted(synonyms, key=lambda s: (-len(s), s))
    pattern = r"\b(" + "|".join(longest_first) + r")\b"
    found = F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(pattern), F.lit(1)))
    lookup = text.literal_map(synonyms)
    return F.array_distinct(F.transform(found, lambda s: lookup[s]))


def statements(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(STATEMENT), F.lit(0))


def stated_substance(statement: Column) -> Column:
    """The name between the last opening and the number."""
    return F.regexp_replace(F.regexp_extract(statement, STATEMENT, 1), f"(?is)^.*{OPENING}", "")


def stated_number(digits: Column) -> Column:
    """Commas before three digits group thousands unless a zero leads; another comma is a decimal one."""
    grouped = digits.rlike(r"^[1-9][0-9]{0,2}(,[0-9]{3})+(\.|$)")
    return F.when(grouped, F.replace(digits, F.lit(","))).otherwise(F.replace(digits, F.lit(","), F.lit("."))).try_cast(text.AMOUNT)


def candidates(documents: DataFrame, key: str, body: str = "text") -> DataFrame:
    """One row per limit statement of the whole text, nothing filtered out."""
    found = documents.select(key, F.posexplode(statements(F.col(body))).alias("ordinal", "statement"))
    part = lambda n: F.regexp_extract("statement", STATEMENT, n)
    return (
        found.withColumn("raw_substance", stated_substance(F.col("statement")))
        .withColumn("limit_value", stated_number(part(2)))
        .withColumn("raw_unit", F.trim(part(3)))
        .withColumn("_s", text.substance(F.col("raw_substance")))
        .withColumn("unit", text.unit(F.col("raw_unit"))["unit"])
        .select(
            key,
            "ordinal",
            "statement",
            "raw_substance",
            F.col("_s.normalized").alias("substance"),
            F.col("_s.unnormalized").alias("unnormalized"),
            "limit_value",
            "raw_unit",
            "unit",
        )
        .withColumn("clause_type", F.lit("numeric_limit"))
        .withColumn("status", F.lit("pending_reconciliation"))
    )


def vague_candidates(documents: DataFrame, key: str, body: str = "text") -> DataFrame:
    """Known substances named without a stated limit: null limit, for review."""
    stated = F.transform(
        statements(F.col(body)), lambda s: text.substance(stated_substance(s))["normalized"]
    )
    loose = F.array_except(mentions(F.col(body)), stated)
    return documents.select(key, F.explode(loose).alias("substance")).select(
        key,
        "substance",
        F.lit(None).cast(text.AMOUNT).alias("limit_value"),
        F.lit("needs_review").alias("status"),
    )


def chunks(documents: DataFrame, key: str, body: str = "text") -> DataFrame:
    """Paragraphs with their category; null where none applies."""
    cut = documents.select(key, F.posexplode(F.split(body, "\n")).alias("chunk", "content"))
    lowered = F.lower("content")
    (first, pattern), *rest = CATEGORIES
    category = F.when(lowered.rlike(pattern), first)
    for name, pattern in rest:
        category = category.when(lowered.rlike(pattern), name)
    return cut.withColumn("category", category)


def relevance(documents: DataFrame, key: str, body: str = "text") -> DataFrame:
    """Per document: chunks, relevant chunks, characters in all and in the relevant ones.

    Counted inside the row, so no chunk leaves its task; each is matched once.
    """
    any_of = "|".join(pattern for _, pattern in CATEGORIES)
    mark = lambda p: F.struct(F.length(p).alias("length"), F.lower(p).rlike(any_of).alias("hit"))
    marked = documents.select(key, F.transform(F.split(body, "\n"), mark).alias("parts"))
    length = lambda parts: F.aggregate(parts["length"], F.lit(0), lambda acc, n: acc + n)
    hits = F.filter("parts", lambda p: p["hit"])
    return marked.select(
        key,
        F.size("parts").alias("chunks"),
        F.size(hits).alias("relevant"),
        length(F.col("parts")).alias("characters"),
        length(hits).alias("kept_characters"),
    )


def parse_quality(characters: Column, pages: Column, undecodable: Column, fallback: Column) -> Column:
    """Ours: thin pages, undecodable characters and a fallback parser lower it.

    Characters per page count in full from 1,000 on; each undecodable character
    costs its share; the fallback costs a fifth. Never below zero.
    """
    chars = characters.cast("double")
    density = F.least(F.lit(1.0), chars / (F.greatest(pages, F.lit(1)) * F.lit(1000.0)))
    damage = F.coalesce(F.try_divide(undecodable.cast("double"), chars), F.lit(0.0))
    penalty = F.when(fallback, F.lit(0.2)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), density * (F.lit(1.0) - damage) - penalty)


def cache_lookup(documents: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Add cached_from: the first reconciled document with the same content hash."""
    known = reconciled.groupBy("content_sha256").agg(F.min("document_id").alias("cached_from"))
    return salted_join(documents, known, ["content_sha256"], ["document_id"], "left")


def agreement(first: DataFrame, second: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Two extraction passes side by side; self_consistency is the share of equal fields.

    A candidate seen in one pass only scores zero.
    """
    on = [key, "substance", "ordinal"]
    a = first.select(*on, F.struct(*fields).alias("a"))
    b = second.select(*on, F.struct(*fields).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    same = sum((F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")).cast("int") for f in fields), F.lit(0))
    joined = a.join(b, on, "full_outer")
    return joined.withColumn("seen_twice", both).withColumn(
        "self_consistency", F.when(both, same / F.lit(len(fields))).otherwise(F.lit(0.0))
    )


def accuracy(expected: DataFrame, extracted: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per expected clause, whether each field was extracted right."""
    got = extracted.select(key, "ordinal", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = expected.join(got, [key, "ordinal"], "left")
    flags = [F.coalesce(F.col(f) == F.col(f"_{f}"), F.lit(False)).alias(f"{f}_right") for f in fields]
    return joined.select(key, "ordinal", *flags)
