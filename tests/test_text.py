from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from complyframe.constants import SUBSTANCE_SYNONYMS, UNIT_FACTORS
from complyframe.functions import scoring, text
from complyframe.operators.normalize import lookup_markets, normalize_by_join
from complyframe.sources.tables import seed_markets

NAMES = [
    ("sodium benzoate", "sodium_benzoate", False),
    ("Sodium Benzoate", "sodium_benzoate", False),
    ("natrium benzoat", "sodium_benzoate", False),
    ("E211", "sodium_benzoate", False),
    ("e 211", "sodium_benzoate", False),
    ("INS 211", "sodium_benzoate", False),
    ("Sodium Benzoate (E211)", "sodium_benzoate", False),
    ("Preservative, jahe", "ginger", False),
    ("unknown (gula / salt)", "sucrose", False),
    ("Fictional Extract 9000", "fictional_extract_9000", True),
    ("E 202", "e_202", True),
    ("E 212", "e_212", True),
    (None, "", True),
    ("", "", True),
    ("\tsodium  benzoate \n", "sodium_benzoate", False),
    ("\x1fsodium\x1cbenzoate", "sodium_benzoate", False),
    ("--- (((", "", True),
]


def test_the_dictionary_is_complete():
    assert len(SUBSTANCE_SYNONYMS) == 79
    assert len(set(SUBSTANCE_SYNONYMS.values())) == 20


def test_substances(spark):
    rows = spark.createDataFrame([(n,) for n, _, _ in NAMES], "name STRING")
    by_map = rows.select("name", text.substance(F.col("name")).alias("s")).select("name", "s.*")
    dictionary = spark.createDataFrame(list(SUBSTANCE_SYNONYMS.items()), "synonym STRING, canonical STRING")
    by_join = normalize_by_join(rows, "name", dictionary)
    want = sorted(map(str, NAMES))
    assert sorted(str(tuple(r)) for r in by_map.collect()) == want
    assert sorted(str(tuple(r)) for r in by_join.collect()) == want


@pytest.mark.parametrize(
    ("raw", "unit", "reason"),
    [
        ("%", "percent_w_w", None),
        ("percent", "percent_w_w", None),
        ("% w/w", "percent_w_w", None),
        ("mg/kg", "mg_per_kg", None),
        ("MG/KG", "mg_per_kg", None),
        (" Mg   per KG ", "mg_per_kg", None),
        ("ppm", "ppm", None),
        ("grams per gallon", None, "unrecognised_unit"),
        ("", None, "unrecognised_unit"),
        (None, None, "unit_required"),
    ],
)
def test_units(spark, raw, unit, reason):
    row = spark.createDataFrame([(raw,)], "u STRING").select(text.unit(F.col("u")).alias("r")).select("r.*").first()
    assert (row["unit"], row["reason"]) == (unit, reason)


def test_conversion_is_exact_and_only_through_the_table(spark):
    rows = spark.createDataFrame([("percent_w_w", "mg_per_kg"), ("ppm", "percent_w_w"), ("cups", "ppm"), (None, "ppm")], "a STRING, b STRING")
    got = [r[0] for r in rows.select(text.convert(F.lit(Decimal("0.07")), F.col("a"), F.col("b"))).collect()]
    assert got == [Decimal("700.000000"), Decimal("0.000007"), None, None]
    assert len(UNIT_FACTORS) == 9


def test_confidence_and_gate(spark):
    one = spark.range(1)
    score = scoring.composite_confidence(F.lit("0.95").cast("decimal(18,6)"), F.lit(1), F.lit(1))
    weak = scoring.composite_confidence(F.lit("0.95").cast("decimal(18,6)"), F.lit(1), F.lit(0))
    row = one.select(score.alias("s"), weak.alias("w"), scoring.review_gate(weak, F.lit(Decimal("0.2"))).alias("g"), scoring.review_gate(F.lit(None).cast("decimal(18,6)"), F.lit(1)).alias("n")).first()
    assert row["s"] == Decimal("0.985000") and row["w"] == Decimal("0.685000")
    assert row["g"] and row["n"]


@pytest.mark.parametrize(
    ("code", "found", "market"),
    [
        ("id", True, "market_id"),
        ("ID_BPOM", True, "market_id"),
        ("Eu", True, "market_de"),
        (" e ", True, "market_de"),
        ("US", False, None),
        ("", False, None),
        (None, False, None),
        ("ID_BPOMX", False, None),
    ],
)
def test_market_lookup(spark, code, found, market):
    requests = spark.createDataFrame([(code,)], "code STRING")
    row = lookup_markets(requests, "code", seed_markets(spark)).first()
    assert (row["found"], row["market_id"]) == (found, market)


def test_blank_request_meets_a_blank_code_only(spark):
    markets = spark.createDataFrame([("m1", [""], "AA"), ("m2", ["B"], "BB")], "id STRING, jurisdictions ARRAY<STRING>, country_code STRING")
    rows = lookup_markets(spark.createDataFrame([(" ",), ("b",)], "code STRING"), "code", markets).collect()
    assert {r["code"]: r["market_id"] for r in rows} == {" ": "m1", "b": "m2"}


def test_intents(spark):
    cases = {
        "Why is my product at risk?": "cause",
        "What changed in the EU regulation?": "change",
        "Can I export to Germany?": "status",
        "What do I fix?": "remediation",
        "What does the EU say about benzoate?": "clause_lookup",
        "hello": "unknown",
    }
    rows = spark.createDataFrame([(q,) for q in cases], "q STRING").select("q", scoring.question_intent(F.col("q")).alias("i"))
    assert {r["q"]: r["i"] for r in rows.collect()} == cases


def test_log_record_extras_win_and_stay_queryable(spark):
    import json

    extras = F.create_map(F.lit("logger"), F.lit("worker"), F.lit("topic"), F.lit("uploads"))
    line = spark.range(1).select(scoring.log_record(F.lit("INFO"), F.lit("published"), F.lit("api"), F.lit("t1"), extras)).first()[0]
    assert json.loads(line) == {"severity": "INFO", "message": "published", "logger": "worker", "trace_id": "t1", "topic": "uploads"}
