"""Documents to clauses, events and alerts, broken off and started again."""

import json

import pytest
from pyspark.sql import functions as F
from test_scenarios import clause, clauses, product, world

from complyframe.functions.ids import content_hash
from complyframe.operators import counts, extract, impact
from complyframe.sources import messages, storage
from complyframe.sources.tables import stream_of
from complyframe.streaming.intake import DocumentIntake
from complyframe.streaming.logs import Outputs, drain
from complyframe.streaming.stages import ComplianceState

LIMIT = "Intro.\n\nThe maximum level of sodium benzoate is {} % w/w.\nMore prose."


def document(name, body, minute, **more):
    base = {"document_id": name, "text": body, "page_count": 1, "size_bytes": 10, "source_type": "official_regulation",
            "jurisdiction": "EU", "product_type": "food_beverage_powder", "effective_date": "2026-02-01", "document_date": f"2026-02-{minute:02d}"}
    return f"delivery-{name}", json.dumps(base | more), f"2026-02-02T00:{minute:02d}:00Z", f"trace of {name}"


def deliveries(spark, rows):
    df = spark.createDataFrame(rows, "id STRING, body STRING, at STRING, trace STRING")
    attributes = F.create_map(F.lit("trace_id"), F.col("trace"))
    return df.select("at", messages.encode(F.col("body"), attributes, F.col("id"), F.col("at")).alias("message"))


FIRST = [
    document("d1", LIMIT.format("0.05"), 1),
    document("big", LIMIT.format("0.01"), 2, page_count=500),
    document("blank", "", 3),
    ("delivery-x", "{oops", "2026-02-02T00:04:00Z", None),
    ("delivery-y", "{}", "2026-02-02T00:05:00Z", None),
]
SECOND = [
    document("d1", LIMIT.format("0.99"), 9),
    document("d2", LIMIT.format("0.05"), 6, jurisdiction="ID_BPOM"),
    document("d3", "The maximum level of unheard-of extract is 12 per gallon. The permitted limit of E211 is 0,050 %.", 7, jurisdiction="CODEX"),
    document("weak", LIMIT.format("0.01"), 8, source_type="social"),
]


def loop(spark, folder, again=False):
    places, _, ingredients = world(spark, product())
    compliance = ComplianceState(spark, f"{folder}/state", places, ingredients)
    if not again:
        compliance.seed(clauses(spark, clause("e1", "EU", "0.10"), clause("b1", "ID_BPOM", "0.10")))
    return compliance, DocumentIntake(spark, f"{folder}/intake", compliance.on_clauses)


def landed(spark, folder):
    """One file per part, so one batch each."""
    for k, part in enumerate((FIRST, SECOND)):
        deliveries(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/topic")
    return stream_of(spark, f"{folder}/topic", deliveries(spark, FIRST).schema, files_per_batch=1)


def results(compliance, intake):
    """What a reader sees, without ids of batches."""
    rows = {name: sorted(map(str, intake.outputs.rows(name).drop("batch").collect())) for name in
            ("quarantine", "documents", "stages", "candidates", "rejected", "clauses", "messages", "events")}
    rows["alerts"] = sorted(map(str, compliance.alerts().collect()))
    rows["state"] = sorted(map(str, compliance.clauses.state().select("clause_id", "status").collect()))
    return rows


@pytest.fixture(scope="module")
def whole(spark):
    folder = storage.run_folder(spark)
    compliance, intake = loop(spark, folder)
    drain(landed(spark, folder), f"{folder}/cp", intake.on_messages)
    return compliance, intake, results(compliance, intake)


def test_from_text_to_alert(spark, whole):
    compliance, intake, _ = whole
    assert [tuple(r) for r in compliance.alerts().orderBy("market_id").collect()] == [
        ("p1", "market_de", "compliant", "non_compliant"), ("p1", "market_id", "compliant", "non_compliant")]
    seen = {r["document_id"]: (r["status"], r["error"]) for r in intake.outputs.rows("documents").collect()}
    assert seen == {"d1": ("extracted", None), "big": ("failed", "too_many_pages"), "blank": ("failed", "no_text"),
                    "d2": ("extracted", None), "d3": ("extracted", None), "weak": ("extracted", None)}
    assert {tuple(r) for r in intake.outputs.rows("quarantine").select("message_id", "problem").collect()} == {
        ("delivery-x", "bad_json"), ("delivery-y", "document_missing")}
    got = {(r["document_id"], r["ordinal"]): r for r in intake.outputs.rows("clauses").collect()}
    assert (str(got["d1", 0]["limit_base"]), got["d1", 0]["substance"], got["d1", 0]["trace_id"]) == ("500.000000", "sodium_benzoate", "trace of d1")
    # An unknown unit and substance stay, for review; a comma behind a leading zero is a decimal one.
    odd = got["d3", 0]
    assert (odd["clause_type"], odd["status"], odd["unnormalized"]) == ("other", "needs_review", True)
    assert str(got["d3", 1]["limit_base"]) == "500.000000"
    # The second d1 is a redelivery under the same document; d2's text was read in the first batch.
    assert intake.outputs.rows("candidates").where(F.col("content_sha256") == content_hash(F.lit(LIMIT.format("0.05")))).count() == 1
    assert str(got["d2", 0]["limit_base"]) == "500.000000"
    statuses = {r["clause_id"]: r["status"] for r in compliance.clauses.state().collect()}
    assert statuses[got["weak", 0]["clause_id"]] == "needs_review" and statuses["e1"] == "superseded"
    steps = {(r["document_id"], r["seq"], r["stage"], r["ok"], r["clause_count"], r["error"]) for r in intake.outputs.rows("stages").collect()}
    assert {("d1", 2, "extracted", True, 1, None), ("big", 2, "failed", False, 0, "too_many_pages")} <= steps and len(steps) == 18
    events = intake.outputs.rows("events").collect()
    assert len(events) == 6 and all(e["trace_id"] and e["occurred_at"] and e["workspace_id"] for e in events)


@pytest.mark.parametrize(("name", "batch"), [("clauses", 1), ("events", 2)])
def test_broken_between_two_outputs_and_started_again(spark, whole, monkeypatch, name, batch):
    folder = storage.run_folder(spark)
    compliance, intake = loop(spark, folder)
    stream, write = landed(spark, folder), Outputs.write

    def breaking(self, output, rows, number):
        if (output, number) == (name, batch):
            raise RuntimeError("lost")
        return write(self, output, rows, number)

    monkeypatch.setattr(Outputs, "write", breaking)
    with pytest.raises(Exception, match="lost"):
        drain(stream, f"{folder}/cp", intake.on_messages)
    monkeypatch.undo()
    # Nothing of the broken batch is seen, though some of its outputs are there.
    assert {r["batch"] for r in intake.outputs.rows("documents").select("batch").distinct().collect()} == set(range(1, batch))
    compliance, intake = loop(spark, folder, again=True)
    drain(stream, f"{folder}/cp", intake.on_messages)
    assert results(compliance, intake) == whole[2]
    # A finished batch that runs once more changes nothing.
    intake.on_messages(deliveries(spark, SECOND), 2)
    assert results(compliance, intake) == whole[2]


@pytest.mark.parametrize(
    ("body", "found"),
    [
        ("The maximum level of alpha is 0,050 %.", [("alpha", "0.050000", "percent_w_w")]),
        ("The maximum level of alpha is 1,500 ppm.", [("alpha", "1500.000000", "ppm")]),
        ("The maximum level of alpha is set by annex II. Sulphite content of beta is 5 mg/kg.", []),
        ("The maximum level of alpha is 150.", [("alpha", "150.000000", None)]),
        ("The maximum level of\nalpha is\n7 ppm. Then", [("alpha", "7.000000", "ppm")]),
        ("The maximum level of alpha\n\nis 7 ppm", []),
    ],
)
def test_limit_statements(spark, body, found):
    rows = extract.candidates(spark.createDataFrame([(1, body)], "id INT, text STRING"), "id").collect()
    assert [(r["substance"], str(r["limit_value"]), r["unit"]) for r in rows] == found


@pytest.mark.parametrize("seed", range(3))
def test_counts_without_requirements(spark, seed):
    """Equal to counting all requirements: equal limits, amounts at a limit, unknown amounts, doubtful and typed clauses."""
    import random

    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    rows = [
        clause(f"c{k}", pick("EU", "ID_BPOM", "X"), pick("0.05", "0.08", "0.10", "3", None), kind=pick("numeric_limit", "numeric_limit", "labeling"),
               substance=pick("sodium_benzoate", "ginger", "other"), product_type=pick("*", "food_beverage_powder", "cosmetic"),
               confidence=pick("0.9", "0.4"))
        for k in range(60)
    ]
    held = clauses(spark, *rows)
    places, pairs, ingredients = world(spark, *[product(f"p{k}", pick("0.05", "0.08", "0.2", None), pick(("market_de",), ("market_de", "market_id"))) for k in range(8)])
    required = impact.requirements(places, ingredients, held)
    want = sorted(map(str, impact.rollup(required, pairs).collect()))
    assert sorted(map(str, counts.issue_counts(places, pairs, ingredients, held).collect())) == want
    kinds = ["evaluation", "jurisdiction", "clause_type"]
    want = sorted(map(tuple, required.groupBy(*kinds).count().collect()))
    assert sorted(map(tuple, counts.requirement_counts(places, ingredients, held).select(*kinds, "requirements").collect())) == want
