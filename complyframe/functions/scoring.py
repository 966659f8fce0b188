"""Confidence, authority, evaluation, severity, similarity and intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from complyframe.constants import (
    AUTHORITY_FLOOR,
    AUTHORITY_TIERS,
    REVIEW_CONFIDENCE,
    STATUS_ORDINALS,
    WEIGHT_AUTHORITY,
    WEIGHT_CONSISTENCY,
    WEIGHT_PARSE,
)
from complyframe.functions.text import AMOUNT, literal_map


def authority_tier(source_type: Column) -> Column:
    """Score of a source type; an unlisted one scores as the lowest."""
    lowest = min(AUTHORITY_TIERS.values())
    tier = F.lit(lowest).cast(AMOUNT)
    for name, value in AUTHORITY_TIERS.items():
        tier = F.when(source_type == name, F.lit(value).cast(AMOUNT)).otherwise(tier)
    return tier


def composite_confidence(parse: Column, consistency: Column, tier: Column) -> Column:
    weights = ((WEIGHT_PARSE, parse), (WEIGHT_CONSISTENCY, consistency), (WEIGHT_AUTHORITY, tier))
    terms = [F.lit(w).cast("decimal(4,2)") * c.cast(AMOUNT) for w, c in weights]
    return (terms[0] + terms[1] + terms[2]).cast(AMOUNT)


def review_gate(confidence: Column, tier: Column, abstained: Column | None = None) -> Column:
    """True where a clause may not change state on its own."""
    low = (confidence < F.lit(REVIEW_CONFIDENCE)) | (tier < F.lit(AUTHORITY_FLOOR))
    low = F.coalesce(low, F.lit(True))
    return low if abstained is None else low | F.coalesce(abstained, F.lit(False))


def evaluation(
    has_substance: Column,
    confidence: Column,
    clause_type: Column,
    amount: Column,
    limit: Column,
) -> Column:
    """Verdict for one requirement; amount and limit already share a unit.

    A missing amount, limit or conversion is for review: it never passes.
    """
    numeric = clause_type == "numeric_limit"
    return (
        F.when(numeric & ~has_substance, "not_applicable")
        .when(confidence.isNull() | (confidence < F.lit(REVIEW_CONFIDENCE)), "needs_review")
        .when(~numeric, "needs_review")
        .when(amount.isNull() | limit.isNull(), "needs_review")
        .when(amount <= limit, "pass")
        .otherwise("fail")
    )


def severity(verdict: Column, unresolved: Column | None = None) -> Column:
    levels = F.when(verdict == "fail", "high").when(verdict == "needs_review", "medium")
    return levels if unresolved is None else levels.when(unresolved, "medium")


def status_ordinal(status: Column) -> Column:
    return literal_map(STATUS_ORDINALS)[status]


def rollup_status(any_fail: Column, any_review: Column, any_pass: Column) -> Column:
    return (
        F.when(F.coalesce(any_fail, F.lit(False)), "non_compliant")
        .when(F.coalesce(any_review, F.lit(False)), "attention_required")
        .when(F.coalesce(any_pass, F.lit(False)), "compliant")
        .otherwise("unknown")
    )


def readiness_label(status: Column) -> Column:
    return F.when(status == "compliant", "READY").when(status == "unknown", "NO DATA").otherwise("NOT READY")


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    dot = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(dot, norm(a) * norm(b))


# Ours: keyword lists for the closed set of question kinds, tried in this order.
INTENT_KEYWORDS = (
    ("remediation", "fix|remed|reformulat|resolve|perbaiki"),
    ("cause", "why|cause|reason|at risk|mengapa|kenapa"),
    ("change", "chang|updat|new rule|berubah"),
    ("status", "can i|export|ready|compliant|status|bisa"),
    ("clause_lookup", "what does|limit|clause|regulation|say about|batas"),
)


def question_intent(question: Column) -> Column:
    text = F.lower(question)
    (first, pattern), *rest = INTENT_KEYWORDS
    intent = F.when(text.rlike(pattern), first)
    for name, pattern in rest:
        intent = intent.when(text.rlike(pattern), name)
    return intent.otherwise("unknown")


def log_record(severity_: Column, message: Column, logger: Column, trace_id: Column, extras: Column) -> Column:
    """One JSON line: base fields, overlaid by the extras (map<string,string>)."""
    base = F.create_map(
        F.lit("severity"), severity_, F.lit("message"), message, F.lit("logger"), logger, F.lit("trace_id"), trace_id
    )
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(extras), k))
    return F.to_json(F.map_concat(kept, extras))
