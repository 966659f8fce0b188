"""The acceptance scenarios, on a product, two markets and a handful of clauses."""

import itertools
import json
import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from complyframe.functions import scoring
from complyframe.operators import extract, grounding, impact, reconcile, state, timeline, validate
from complyframe.schemas import PRODUCT_INPUT
from complyframe.sources.tables import seed_markets

CLAUSE = (
    "clause_id STRING, document_id STRING, jurisdiction STRING, substance STRING, product_type STRING, "
    "clause_type STRING, limit_value DECIMAL(18,6), unit STRING, effective_date DATE, document_date DATE, "
    "confidence DECIMAL(18,6), authority_tier DECIMAL(18,6), status STRING"
)


def clause(name, place, limit, unit="percent_w_w", day=1, status="active", kind="numeric_limit", substance="sodium_benzoate",
           product_type="food_beverage_powder", confidence="0.9", tier="1.0", doc_day=1):
    limit = None if limit is None else Decimal(limit)
    return (name, "doc_" + name, place, substance, product_type, kind, limit, unit, date(2026, 1, day), date(2026, 1, doc_day),
            Decimal(confidence), Decimal(tier), status)


def clauses(spark, *rows):
    return reconcile.comparable_form(spark.createDataFrame(list(rows), CLAUSE))


def product(name="p1", amount="0.08", markets=("market_de", "market_id"), ingredient="natrium benzoat"):
    from datetime import datetime

    line = (ingredient, None if amount is None else Decimal(amount), None if amount is None else "percent_w_w")
    return (name, "Herbal Drink Powder", "food_beverage_powder", "id", "pouch", [("ginger", None, None), line], list(markets),
            datetime(2026, 1, 1))


def world(spark, *requests):
    products, _, _ = state.create_products(spark.createDataFrame(list(requests), PRODUCT_INPUT))
    pairs, ingredients = impact.explode_products(products)
    places = impact.expand_markets(pairs, impact.explode_markets(seed_markets(spark)))
    return places, pairs, ingredients


def statuses(spark, rows, *requests):
    places, pairs, ingredients = world(spark, *requests)
    current = reconcile.current_clauses(rows.where("status = 'active'"))
    fast = impact.product_status(places, pairs, ingredients, current)
    slow = impact.rollup(impact.requirements(places, ingredients, current), pairs)
    got = {(r["product_id"], r["market_id"]): r["status"] for r in fast.collect()}
    assert got == {(r["product_id"], r["market_id"]): r["status"] for r in slow.collect()}
    return got


def test_new_market_without_data_is_unknown(spark):
    got = statuses(spark, clauses(spark, clause("b", "ID_BPOM", "0.10")), product())
    assert got == {("p1", "market_de"): "unknown", ("p1", "market_id"): "compliant"}


def test_changed_regulation_flips_one_market(spark):
    before = clauses(spark, clause("b", "ID_BPOM", "0.10"), clause("e1", "EU", "0.10"))
    after = reconcile.verdicts(before.unionByName(clauses(spark, clause("e2", "EU", "0.05", day=9, status="pending_reconciliation"))))
    decided = {r["clause_id"]: r for r in after.collect()}
    assert decided["e1"]["status"] == "superseded" and decided["e1"]["superseded_by"] == "e2"
    assert decided["e2"]["verdict"] == "supersedes" and decided["e2"]["change"] == "limit_tightened"
    assert decided["b"]["status"] == "active"
    was, now = statuses(spark, before, product()), statuses(spark, after, product())
    assert was == {("p1", "market_de"): "compliant", ("p1", "market_id"): "compliant"}
    assert now == {("p1", "market_de"): "non_compliant", ("p1", "market_id"): "compliant"}
    places, _, ingredients = world(spark, product())
    required = [impact.requirements(places, ingredients, reconcile.current_clauses(c.where("status = 'active'"))) for c in (before, after)]
    changes = {(r["clause_id"], r["change"]) for r in impact.requirement_changes(*required).collect()}
    assert changes == {("b", "unchanged"), ("e1", "withdrawn"), ("e2", "created")}
    events = {r["entity_id"]: r["event_type"] for r in reconcile.verdict_events(after).collect()}
    assert events == {"e1": "clause_superseded", "e2": "clause_created"}


def test_jurisdictions_that_differ_conflict_and_stay_active(spark):
    rows = clauses(spark, clause("b", "ID_BPOM", "0.10"), clause("e", "EU", "500", unit="mg_per_kg"))
    assert {r["status"] for r in reconcile.verdicts(rows).collect()} == {"active"}
    (found,) = reconcile.conflicts(reconcile.current_clauses(rows)).collect()
    assert (found["clause_a"], found["clause_b"], found["type"]) == ("b", "e", "cross_jurisdiction_limit_mismatch")
    assert (found["detail"]["a"], found["detail"]["b"]) == (Decimal("1000"), Decimal("500"))


def test_equal_limits_in_other_units_are_no_finding(spark):
    rows = clauses(spark, clause("b", "ID_BPOM", "0.10"), clause("e", "EU", "1000", unit="ppm"), clause("e2", "EU", "0.1", day=5))
    assert reconcile.conflicts(reconcile.current_clauses(rows)).count() == 0
    assert {r["status"] for r in reconcile.verdicts(rows).collect()} == {"active"}


@pytest.mark.parametrize("flaw", [{"tier": "0.2"}, {"confidence": "0.4"}, {"limit": None}, {"unit": None}])
def test_weak_source_goes_to_review_and_mutates_nothing(spark, flaw):
    limit = flaw.pop("limit", "0.05")
    new = clause("x", "EU", limit, day=9, status="pending_reconciliation", **flaw)
    decided = reconcile.verdicts(clauses(spark, clause("e", "EU", "0.10"), new))
    assert {r["clause_id"]: r["status"] for r in decided.collect()} == {"e": "active", "x": "needs_review"}
    assert [r["event_type"] for r in reconcile.verdict_events(decided).collect()] == ["clause_flagged_review"]


def test_same_dates_other_limit_is_ambiguous_until_settled(spark):
    rows = clauses(spark, clause("e", "EU", "0.10"), clause("x", "EU", "0.05", status="pending_reconciliation"))
    assert {r["clause_id"]: r["status"] for r in reconcile.verdicts(rows).collect()} == {"e": "active", "x": "needs_review"}
    keep = spark.createDataFrame([("x", "keep")], "clause_id STRING, verdict STRING")
    assert {r["clause_id"]: r["status"] for r in reconcile.verdicts(rows, keep).collect()} == {"e": "superseded", "x": "active"}


def test_readiness_names_the_worst_issue(spark):
    rows = clauses(spark, clause("e", "EU", "0.05"), clause("l", "EU", None, kind="labeling", substance="", unit=None))
    places, pairs, ingredients = world(spark, product(markets=("market_de",)))
    required = impact.requirements(places, ingredients, rows)
    (row,) = impact.readiness(required, pairs).collect()
    assert (row["label"], row["most_critical"]) == ("NOT READY", "e")
    counts = impact.rollup(required, pairs).first()
    assert (counts["critical"], counts["to_review"], counts["passed"]) == (1, 1, 0)


def test_two_products_one_clause_two_changes(spark):
    before = clauses(spark, clause("e1", "EU", "0.10"))
    after = clauses(spark, clause("e2", "EU", "0.05", day=9))
    requests = (product("p1", markets=("market_de",)), product("p2", markets=("market_de",)))
    places, pairs, ingredients = world(spark, *requests)
    old, new = (impact.product_status(places, pairs, ingredients, c) for c in (before, after))
    changes = impact.status_changes(old, new)
    assert {(r["product_id"], r["was"], r["status"], r["worsened"]) for r in changes.collect()} == {
        ("p1", "compliant", "non_compliant", True), ("p2", "compliant", "non_compliant", True)}
    acks = changes.where("product_id = 'p1'")
    assert [r["product_id"] for r in impact.alerts(changes, acks).collect()] == ["p2"]


def test_unmeasured_amount_never_passes(spark):
    got = statuses(spark, clauses(spark, clause("e", "EU", "0.10")), product(amount=None, markets=("market_de",)))
    assert got == {("p1", "market_de"): "attention_required"}


def test_a_product_exactly_at_the_limit_passes(spark):
    got = statuses(spark, clauses(spark, clause("e", "EU", "700", unit="mg_per_kg")), product(amount="0.07", markets=("market_de",)))
    assert got == {("p1", "market_de"): "compliant"}


def test_one_substance_under_two_names_adds_up(spark):
    request = list(product(amount="0.04", markets=("market_de",)))
    request[5] = [("natrium benzoat", Decimal("0.04"), "percent_w_w"), ("E211", Decimal("400"), "mg_per_kg")]
    rows = clauses(spark, clause("e", "EU", "0.05"))
    assert statuses(spark, rows, tuple(request)) == {("p1", "market_de"): "non_compliant"}


# --- Guardrail ---------------------------------------------------------------


def _random_clauses(spark, n, seed, prefix, status):
    rng = random.Random(seed)
    rows = [
        clause(f"{prefix}{i:03d}", rng.choice(["EU", "ID_BPOM", "X"]), rng.choice(["0.05", "0.1", "500"]),
               unit=rng.choice(["percent_w_w", "mg_per_kg", "ppm", None]), day=rng.randrange(1, 9), status=status,
               kind=rng.choice(["numeric_limit"] * 3 + ["labeling"]), substance=rng.choice(["a", "b"]),
               product_type=rng.choice(["food_solid", "cosmetic", "*"]), doc_day=rng.randrange(1, 4))
        for i in range(n)
    ]
    return clauses(spark, *rows)


def test_counts_equal_the_pairs_they_stand_for(spark):
    new, active = (_random_clauses(spark, 60, s, p, t) for s, p, t in ((1, "n", "pending_reconciliation"), (2, "a", "active")))
    pairs = reconcile.judged_pairs(reconcile.candidate_pairs(new, active)).cache()
    brute = pairs.groupBy(F.col("a_substance").alias("substance"), F.coalesce("reason", F.lit("comparable")).alias("decision")).agg(F.count(F.lit(1)).alias("pairs"))
    assert sorted(map(tuple, reconcile.guardrail_counts(new, active).collect())) == sorted(map(tuple, brute.collect()))
    counts = {r["substance"]: r for r in reconcile.relationship_counts(new, active).collect()}
    for row in pairs.where("reason IS NULL").groupBy("a_substance", "relationship").count().collect():
        if row["relationship"]:
            assert counts[row["a_substance"]][row["relationship"]] == row["count"]
    per_clause = {r["clause_id"]: r["candidates"] for r in reconcile.candidate_counts(new, active).collect()}
    brute = {r["a_clause_id"]: r["count"] for r in pairs.groupBy("a_clause_id").count().collect()}
    assert {k: v for k, v in per_clause.items() if v} == brute


def test_guardrail_is_symmetric(spark):
    a, b = (_random_clauses(spark, 40, s, p, "active") for s, p in ((3, "x", ), (4, "y")))
    one = reconcile.judged_pairs(reconcile.candidate_pairs(a, b)).select("a_clause_id", "b_clause_id", "reason", "relationship")
    two = reconcile.judged_pairs(reconcile.candidate_pairs(b, a)).select("b_clause_id", "a_clause_id", "reason", "relationship")
    assert sorted(map(str, map(tuple, one.collect()))) == sorted(map(str, map(tuple, two.collect())))


@pytest.mark.parametrize(
    ("other", "reason"),
    [
        ({"substance": "salt"}, "substance_mismatch"),
        ({"product_type": "cosmetic"}, "product_type_mismatch"),
        ({"unit": None}, "unit_mismatch"),
        ({"kind": "labeling"}, "clause_type_mismatch"),
        ({"product_type": "*"}, None),
    ],
)
def test_incomparable_pairs_are_no_conflict(spark, other, reason):
    a, b = clauses(spark, clause("a", "EU", "0.05")), clauses(spark, clause("b", "EU", "0.10", **other))
    (row,) = reconcile.judged_pairs(reconcile.candidate_pairs(a, b)).collect()
    assert row["reason"] == reason
    if reason:
        elsewhere = clauses(spark, clause("b", "ID_BPOM", "0.10", **other))
        assert reconcile.conflicts(a.unionByName(elsewhere)).count() == 0


def test_verdicts_do_not_depend_on_row_order(spark):
    rows = _random_clauses(spark, 80, 7, "c", "active").unionByName(_random_clauses(spark, 80, 8, "p", "pending_reconciliation"))
    columns = ["clause_id", "status", "verdict", "supersedes", "superseded_by", "change"]
    outcomes = [
        sorted(map(str, reconcile.verdicts(rows.orderBy(F.hash("clause_id", F.lit(i)))).select(columns).collect())) for i in range(2)
    ]
    assert outcomes[0] == outcomes[1]


# --- Validation, state, text -------------------------------------------------


@pytest.mark.parametrize(
    ("name", "amount", "unit", "reasons"),
    [
        ("sodium benzoate", "0.08", None, ["amount_needs_unit"]),
        ("sodium benzoate", "0.08", "percent_w_w", []),
        ("ginger", None, None, []),
        ("", None, None, ["name_length"]),
        (None, "-1", "ppm", ["name_length", "amount_negative"]),
        ("x" * 201, "1", "cups", ["name_length", "unit_unknown"]),
    ],
)
def test_ingredients(spark, name, amount, unit, reasons):
    row = spark.createDataFrame([(name, amount and Decimal(amount), unit)], "name STRING, amount DECIMAL(18,6), unit STRING")
    assert validate.check_ingredients(row).first()["reasons"] == reasons


def test_products(spark):
    rows = [("X", "herbal drink", "ID", None), ("X", "cosmetic", "Indonesia", None), ("X", "cosmetic", "ID", "p" * 201), ("X", "cosmetic", "ID", None)]
    checked = validate.check_products(spark.createDataFrame(rows, "name STRING, product_type STRING, origin STRING, packaging STRING"))
    assert [r["reasons"] for r in checked.collect()] == [["product_type_unknown"], ["origin_length"], ["packaging_length"], []]


def test_create_and_patch(spark):
    products, events, bad = state.create_products(spark.createDataFrame([product()], PRODUCT_INPUT))
    row, event = products.first(), events.first()
    assert row["origin"] == "ID" and bad.count() == 0
    assert [(i["normalized"], i["unnormalized"]) for i in row["ingredients"]] == [("ginger", False), ("sodium_benzoate", False)]
    after = json.loads(event["after"])
    assert "created_at" not in after and after["ingredients"][0]["amount"] is None
    patches = spark.createDataFrame([("p1", None, "de", "pouch")], "id STRING, name STRING, origin STRING, packaging STRING")
    snapshot, changed = state.patch_products(products, patches, "id")
    assert snapshot.first()["origin"] == "DE" and snapshot.first()["name"] == "Herbal Drink Powder"
    (event,) = changed.collect()
    assert json.loads(event["before"]) == {"origin": "ID", "packaging": "pouch"}
    assert json.loads(event["after"]) == {"origin": "DE", "packaging": "pouch"}
    empty = spark.createDataFrame([("p1", None, None, None)], "id STRING, name STRING, origin STRING, packaging STRING")
    assert state.patch_products(products, empty, "id")[1].count() == 0


def test_limits_are_read_from_prose(spark):
    text = (
        "Scope.\nThe maximum level of Natrium Benzoat is 150 mg/kg. The permitted amount of jahe is 0.05 % w/w.\n"
        "The maximum limit of mystery dust is 3 grams per gallon. Gula is mentioned."
    )
    docs = spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id INT, text STRING")
    got = [(r["ordinal"], r["substance"], r["limit_value"], r["unit"], r["unnormalized"]) for r in extract.candidates(docs, "doc_id").orderBy("ordinal").collect()]
    assert got == [
        (0, "sodium_benzoate", Decimal("150"), "mg_per_kg", False),
        (1, "ginger", Decimal("0.05"), "percent_w_w", False),
        (2, "mystery_dust", Decimal("3"), None, True),
    ]
    assert [r["substance"] for r in extract.vague_candidates(docs, "doc_id").collect()] == ["sucrose"]
    demoted = validate.demote_unknown_units(extract.candidates(docs, "doc_id")).where("ordinal = 2").first()
    assert (demoted["clause_type"], demoted["status"]) == ("other", "needs_review")


def test_grounding(spark):
    log = spark.createDataFrame(
        [(1, ["a", "b"], ["a"]), (2, ["a"], ["b"]), (3, ["z"], ["z"]), (4, ["a"], [])],
        "query_id INT, retrieved_clause_ids ARRAY<STRING>, cited_clause_ids ARRAY<STRING>")
    known = spark.createDataFrame([("a", Decimal("0.9")), ("b", Decimal("0.5"))], "clause_id STRING, confidence DECIMAL(18,6)")
    got = {r["query_id"]: r["outcome"] for r in grounding.check(log, known).collect()}
    assert got == {1: "grounded", 2: "not_retrieved", 3: "unknown_clause", 4: "no_citation"}


def test_audit_and_moves(spark):
    made = spark.createDataFrame([("a",), ("b",)], "entity_id STRING")
    logged = spark.createDataFrame([("b",), ("c",)], "entity_id STRING")
    assert {tuple(r) for r in timeline.audit_gaps(made, logged, ["entity_id"]).collect()} == {
        ("mutation_without_event", "a"), ("event_without_mutation", "c")}
    assert timeline.audit_gaps(made, made, ["entity_id"]).count() == 0
    held = spark.createDataFrame([("x", "needs_review"), ("y", "superseded")], "clause_id STRING, status STRING")
    asked = spark.createDataFrame([("x", "active"), ("y", "active")], "clause_id STRING, to STRING")
    from complyframe.constants import CLAUSE_MOVES

    snapshot, accepted, rejected = state.apply_moves(held, asked, "clause_id", CLAUSE_MOVES)
    assert {tuple(r) for r in snapshot.collect()} == {("x", "active"), ("y", "superseded")}
    assert [r["clause_id"] for r in accepted.collect()] == ["x"] and [r["clause_id"] for r in rejected.collect()] == ["y"]


def test_evaluation_table(spark):
    for numeric, sure, amount, limit in itertools.product((True, False), (True, False), (None, 1, 2), (None, 1)):
        row = spark.range(1).select(
            scoring.evaluation(
                F.lit(True), F.lit(Decimal("0.9" if sure else "0.4")), F.lit("numeric_limit" if numeric else "labeling"),
                F.lit(amount).cast("decimal(18,6)"), F.lit(limit).cast("decimal(18,6)")).alias("e")).first()
        decided = numeric and sure and amount is not None and limit is not None
        assert row["e"] == (("pass" if amount <= limit else "fail") if decided else "needs_review")


def test_statements_as_they_are_written(spark):
    """Thousands, decimal commas, prose behind the unit, a full stop in a name, a long name."""
    from decimal import Decimal

    from complyframe.operators import extract

    lines = [
        "The maximum level of benzoic acid is 150 mg/kg in flavoured drinks.",
        "The permitted limit of salt is 1,000 mg/kg.",
        "The maximum amount of salt is 0,05 % in all.",
        "The maximum level of salt in No. 3 drinks is 7 ppm, at most.",
        f"The maximum level of {'x' * 250} is 3 ppm.",
        "The maximum level of sugar applies. The maximum level of salt is 2 furlongs.",
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "d bigint, text string")
    got = {r.d: (r.raw_substance, r.limit_value, r.unit) for r in extract.candidates(docs, "d").collect()}
    assert got == {
        0: ("benzoic acid", Decimal(150), "mg_per_kg"),
        1: ("salt", Decimal(1000), "mg_per_kg"),
        2: ("salt", Decimal("0.05"), "percent_w_w"),
        3: ("salt in No. 3 drinks", Decimal(7), "ppm"),
        4: ("x" * 250, Decimal(3), "ppm"),
        5: ("salt", Decimal(2), None),
    }


def test_patches_of_one_product_fold(spark):
    from complyframe.operators import state

    base = spark.createDataFrame([("p", "a", "de")], "id string, name string, origin string")
    rows = [("p", "b", None, 1), ("p", None, "fr", 2), ("p", "c", None, 3)]
    patches = spark.createDataFrame(rows, "id string, name string, origin string, patched_at int")
    snapshot, events = state.patch_products(base, patches, "id")
    assert [tuple(r) for r in snapshot.collect()] == [("p", "c", "FR")]
    assert events.count() == 1


def test_latency_ignores_ends_before_the_start(spark):
    from datetime import datetime

    from complyframe.operators import metrics

    at = lambda s: datetime(2026, 1, 1, 0, 0, s)
    rows = [("t", "end", at(1)), ("t", "start", at(2)), ("t", "end", at(9)), ("u", "start", at(3))]
    events = spark.createDataFrame(rows, "trace_id string, event_type string, occurred_at timestamp")
    got = {r.trace_id: (r.seconds, r.breach) for r in metrics.end_to_end(events, "start", "end").collect()}
    assert got == {"t": (7, False), "u": (None, True)}


def test_impact_chain_names_the_document_behind_a_change(spark):
    places, pairs, ingredients = world(spark, product())
    old, new = clauses(spark, clause("e1", "EU", "0.10")), clauses(spark, clause("e2", "EU", "0.05", day=9))
    changes = impact.status_changes(*(impact.product_status(places, pairs, ingredients, c) for c in (old, new)))
    required = impact.evaluate(impact.requirements(places, ingredients, new))
    known = spark.createDataFrame([("doc_e2", "journal"), ("doc_other", "blog")], "document_id string, source string")
    for documents, source in ((known, "journal"), (known.limit(0), None)):
        chain = impact.impact_chain(changes, required, documents)
        columns = ("product_id", "market_id", "clause_id", "document_id", "source", "was", "status")
        assert [tuple(r) for r in chain.select(*columns).collect()] == [
            ("p1", "market_de", "e2", "doc_e2", source, "compliant", "non_compliant")]


def test_other_clauses_than_limits_all_stay_current(spark):
    rows = clauses(spark, clause("a", "EU", None, kind="labeling", day=1), clause("b", "EU", None, kind="labeling", day=2),
                   clause("c", "EU", "0.10", day=1), clause("d", "EU", "0.05", day=2))
    assert sorted(r["clause_id"] for r in reconcile.current_clauses(rows).collect()) == ["a", "b", "d"]


def test_a_scope_without_product_type_is_a_scope(spark):
    rows = clauses(spark, clause("old", "EU", "0.10", day=1, product_type=None), clause("new", "EU", "0.05", day=2, product_type=None))
    assert {r["clause_id"]: r["status"] for r in reconcile.verdicts(rows).collect()} == {"old": "superseded", "new": "active"}


def test_jurisdictions_side_by_side(spark):
    required = spark.createDataFrame(
        [(1, "s", "EU", "numeric_limit", 5, 7, "fail"), (1, "s", "EU", "numeric_limit", 9, 7, "pass"),
         (1, "s", "N3", "numeric_limit", 8, 7, "pass"), (1, "s", "N3", "labeling", None, None, "needs_review")],
        "product_id INT, substance STRING, jurisdiction STRING, clause_type STRING, limit_base INT, amount_base INT, evaluation STRING",
    )
    rows = {tuple(r) for r in impact.compare_jurisdictions(required).collect()}
    assert rows == {(1, "s", "EU", 5, 7, "fail"), (1, "s", "N3", 8, 7, "pass")}
