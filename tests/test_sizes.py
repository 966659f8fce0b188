"""What must not grow beside the result: broadcasts and what is shuffled after a fan-out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from complyframe.operators import counts, grounding, impact
from complyframe.operators.joins import PACK, packed, salted_join, shuffled_join, unpacked
from complyframe.plans import QUERIES, oracles


def final_plan(df) -> str:
    """The plan as it ran, after Spark has seen the sizes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_salted_lookup_is_broadcast_by_the_size_of_all_copies(spark, tmp_path):
    """Below the threshold of 10 MB as a file, above it with 16 copies of every row."""
    spark.range(200_000).select(F.col("id").alias("k"), F.lit("known").alias("w")).write.parquet(f"{tmp_path}/lookup")
    wide = [F.xxhash64("id", F.lit(n)).alias(f"v{n}") for n in range(5)]
    spark.range(500_000).select((F.col("id") % 7).alias("k"), "id", *wide).write.parquet(f"{tmp_path}/facts")
    facts, lookup = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("facts", "lookup"))
    total = F.sum(F.hash(*[f"v{n}" for n in range(5)], "w"))
    large = salted_join(facts, lookup, ["k"], ["id"]).agg(total)
    assert "BroadcastExchange" not in final_plan(large)
    small = salted_join(facts, lookup.where("k < 7"), ["k"], ["id"]).agg(total)
    assert "BroadcastExchange" in final_plan(small)
    assert large.collect() == small.collect()


def test_requirements_are_not_shuffled_after_the_fan_out(spark):
    """A clause that binds by substance and by type is one row, with no join of the rows afterwards."""
    places = spark.createDataFrame(
        [(1, "m", "SNACK", "EU"), (2, "m", "*", "EU"), (3, "m", None, "EU")],
        "product_id LONG, market_id STRING, product_type STRING, jurisdiction STRING",
    )
    ingredients = spark.createDataFrame(
        [(1, "salt", 5), (2, "salt", 5), (3, "salt", 5)], "product_id LONG, substance STRING, amount LONG"
    ).selectExpr("product_id", "substance", "CAST(amount AS DECIMAL(18,6)) AS amount_base")
    clauses = spark.createDataFrame(
        [
            (1, "EU", "salt", "SNACK", "labeling"),
            (2, "EU", "salt", "DRINK", "labeling"),
            (3, "EU", "sugar", "*", "labeling"),
            (4, "EU", "salt", "SNACK", "numeric_limit"),
            (5, "EU", "salt", "SNACK", None),
            (6, "EU", "salt", None, "labeling"),
        ],
        "clause_id LONG, jurisdiction STRING, substance STRING, product_type STRING, clause_type STRING",
    ).selectExpr("*", "CAST(9 AS DECIMAL(18,6)) AS limit_base", "CAST(0.9 AS DECIMAL(18,6)) AS confidence", "1L AS document_id")
    found = impact.requirements(places, ingredients, clauses)
    rows = sorted((r.product_id, r.clause_id) for r in found.collect())
    assert rows == [(p, c) for p in (1, 2, 3) for c in (1, 2, 3, 4, 5, 6)]
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", [
    "c05_requirements",
    "c06_requirement_changes",
    "c10_relationships",
    "d02_issue_counts",
    "d04_stage_funnel",
    "d07_rejections_by_reason",
    "d09_verdict_distribution",
    "d18_requirement_counts",
    "e04_effective_date_conflicts",
    "g01_union_of_branches",
])
def test_substances_stay_few(name):
    """These see 20 substances whatever the number of products; more of them made their job smaller."""
    sql = oracles()[name]
    assert "v_vocabulary" not in sql and "% 20" in sql


def test_first_requirements_need_only_the_leading_clauses(spark):
    """The same three per product, from a bounded number of clauses per substance and per type."""
    places = spark.range(6).selectExpr("id AS product_id", "'m' AS market_id", "concat('T', id % 2) AS product_type", "'EU' AS jurisdiction")
    ingredients = spark.range(6).selectExpr("id AS product_id", "concat('s', id % 3) AS substance", "CAST(1 AS DECIMAL(18,6)) AS amount_base")
    clauses = spark.range(600).selectExpr(
        "id AS clause_id", "'EU' AS jurisdiction", "concat('s', id % 5) AS substance",
        "CASE WHEN id % 4 = 3 THEN '*' ELSE concat('T', id % 4) END AS product_type",
        "CASE WHEN id % 7 < 4 THEN 'numeric_limit' ELSE 'labeling' END AS clause_type",
        "CAST(id % 3 AS DECIMAL(18,6)) AS limit_base", "CAST(id * 37 % 11 / 11 AS DECIMAL(18,6)) AS confidence", "1L AS document_id",
    )
    few = impact.leading(clauses, [F.desc("confidence"), F.asc("clause_id")], 3)
    assert few.count() <= 3 * (5 + 4 * 2)
    results = [
        sorted(map(tuple, grounding.strongest_clauses(impact.requirements(places, ingredients, c), 3).collect())) for c in (clauses, few)
    ]
    assert results[0] == results[1] and len(results[0]) == 18


def test_readiness_evaluates_few_clauses_besides_limits(spark, monkeypatch):
    """One clause other than a limit per substance and per type and jurisdiction."""
    seen, whole = [], impact.requirements
    monkeypatch.setattr(impact, "requirements", lambda p, i, c: (seen.append((p, i, c)), whole(p, i, c))[1])
    QUERIES["h22_readiness"](spark, "/root/testdata/sf0.001")
    others = seen[-1][2].where("clause_type <> 'numeric_limit'")
    scopes = [others.select("jurisdiction", c).distinct().count() for c in ("substance", "product_type")]
    assert 0 < others.count() <= sum(scopes)


def test_a_lookup_of_clauses_is_not_broadcast(spark, tmp_path):
    """Small as a file, large as a hash table in the driver: it is shuffled, not repeated."""
    spark.range(2000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/lookup")
    lookup = spark.read.parquet(f"{tmp_path}/lookup")
    facts = spark.range(5000).select((F.col("id") % 70).alias("k"), F.col("id").alias("f"))
    met = shuffled_join(facts, lookup, ["k"])
    assert "BroadcastExchange" not in final_plan(met.agg(F.count("v")))
    assert met.count() == facts.join(F.broadcast(lookup), "k").count()


def test_counted_requirements_stand_for_all_rows(spark):
    """By substance, by type, both ways, for types that are null or the catch-all, in two markets of one jurisdiction."""
    places = spark.createDataFrame(
        [(p, m, t, j) for p, t in ((1, "SNACK"), (2, "*"), (3, None), (4, "DRINK")) for m, j in (("m", "EU"), ("n", "EU"), ("n", "DE"))],
        "product_id LONG, market_id STRING, product_type STRING, jurisdiction STRING",
    )
    ingredients = spark.createDataFrame(
        [(1, "salt", 5), (2, "salt", 12), (3, "salt", None), (4, "sugar", 5)], "product_id LONG, substance STRING, amount LONG"
    ).selectExpr("product_id", "substance", "CAST(amount AS DECIMAL(18,6)) AS amount_base")
    kinds = [(s, t, k) for s in ("salt", "sugar") for t in ("SNACK", "DRINK", "*", None) for k in ("labeling", "numeric_limit")]
    clauses = spark.createDataFrame(
        [(10 * n + len(j), j, *kind) for n, kind in enumerate(kinds) for j in ("EU", "R")],
        "clause_id LONG, jurisdiction STRING, substance STRING, product_type STRING, clause_type STRING",
    ).selectExpr("*", "CAST(9 AS DECIMAL(18,6)) AS limit_base", "CAST(0.9 AS DECIMAL(18,6)) AS confidence", "1L AS document_id")
    rows = impact.requirements(places, ingredients, clauses).localCheckpoint()
    per_clause = lambda df, n: sorted(map(tuple, df.groupBy("clause_id", "evaluation").agg(n).collect()))
    counted = impact.counted_requirements(places, ingredients, clauses)
    assert per_clause(counted, F.sum("bound")) == per_clause(rows, F.count(F.lit(1)))
    reached = impact.portfolio(impact.counted_requirements(places, ingredients, clauses, of=["product_id"])).drop("worst")
    products = rows.groupBy("clause_id").agg(F.countDistinct("product_id"))
    assert sorted(map(tuple, reached.collect())) == sorted(map(tuple, products.collect()))
    limits = impact.limit_requirements(places, ingredients, clauses)
    assert sorted(map(str, limits.collect())) == sorted(map(str, rows.where("clause_type = 'numeric_limit'").select(limits.columns).collect()))
    by_market = counts.requirement_counts(places, ingredients, clauses, by=["market_id"])
    keys = ["market_id", "evaluation", "jurisdiction", "clause_type"]
    want = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("requirements"))
    assert sorted(map(str, by_market.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_status_sends_an_ingredient_once_and_not_once_per_place(spark):
    """Two markets of shared jurisdictions; the same statuses as from all requirements, and the same affected pairs."""
    places = spark.createDataFrame(
        [(p, m, t, j) for p, t in ((1, "SNACK"), (2, "*"), (3, None), (4, "DRINK"), (5, "SNACK")) for m, j in (("m", "EU"), ("n", "EU"), ("n", "DE"))],
        "product_id LONG, market_id STRING, product_type STRING, jurisdiction STRING",
    )
    pairs = places.select("product_id", "market_id").distinct().unionByName(spark.createDataFrame([(1, "bare")], "product_id LONG, market_id STRING"))
    ingredients = spark.createDataFrame(
        [(1, "salt", 5), (1, "sugar", 1), (2, "salt", 12), (3, "salt", None), (4, "sugar", 5), (5, "water", 1)], "product_id LONG, substance STRING, amount LONG"
    ).selectExpr("product_id", "substance", "CAST(amount AS DECIMAL(18,6)) AS amount_base")
    held = impact.content(places, ingredients)
    assert held.count() == ingredients.count()
    assert {tuple(sorted(r.sold_in)) for r in held.collect()} == {("DE", "EU")}
    kinds = [
        [(1, "EU", "salt", "SNACK", "numeric_limit", 9, 0.9)],
        [(1, "EU", "salt", "SNACK", "numeric_limit", 9, 0.9), (2, "DE", "salt", "*", "numeric_limit", 3, 0.9)],
        [(1, "DE", "sugar", "DRINK", "numeric_limit", 5, 0.1), (2, "EU", "fat", "SNACK", "labeling", None, 0.9)],
        [(1, "DE", "fat", "*", "labeling", None, 0.9), (2, "EU", "salt", "*", "numeric_limit", 12, 0.9)],
        [(1, "DE", "salt", None, "labeling", None, 0.9), (2, "EU", "sugar", None, "numeric_limit", None, 0.9)],
    ]
    for rows in kinds:
        clauses = spark.createDataFrame(
            rows, "clause_id LONG, jurisdiction STRING, substance STRING, product_type STRING, clause_type STRING, l LONG, c DOUBLE"
        ).selectExpr("*", "CAST(l AS DECIMAL(18,6)) AS limit_base", "CAST(c AS DECIMAL(18,6)) AS confidence", "1L AS document_id")
        required = impact.requirements(places, ingredients, clauses)
        want = sorted(map(tuple, impact.rollup(required, pairs).select("product_id", "market_id", "status").collect()))
        for given in (ingredients, held):
            assert sorted(map(tuple, impact.product_status(places, pairs, given, clauses).collect())) == want
            reached = sorted(map(tuple, impact.affected_pairs(places, given, clauses).collect()))
            assert reached == sorted(map(tuple, required.select("product_id", "market_id").distinct().collect()))


@pytest.mark.parametrize("few", [100, 0])
def test_amounts_are_looked_up_without_sending_every_row(spark, monkeypatch, few):
    """Few different amounts go to the rows; many are met by a shuffle, with the same counts."""
    monkeypatch.setattr(counts, "FEW_AMOUNTS", few)
    places = spark.range(40).selectExpr("id AS product_id", "'m' AS market_id", "concat('T', id % 2) AS product_type", "'EU' AS jurisdiction")
    ingredients = spark.range(40).selectExpr(
        "id AS product_id", "concat('s', id % 3) AS substance", "CAST(CASE WHEN id % 5 > 0 THEN id % 4 END AS DECIMAL(18,6)) AS amount_base"
    )
    clauses = spark.range(30).selectExpr(
        "id AS clause_id", "'EU' AS jurisdiction", "concat('s', id % 4) AS substance", "concat('T', id % 3) AS product_type",
        "CASE WHEN id % 7 < 5 THEN 'numeric_limit' ELSE 'labeling' END AS clause_type",
        "CAST(id % 4 AS DECIMAL(18,6)) AS limit_base", "CAST(id % 3 / 3 + 0.1 AS DECIMAL(18,6)) AS confidence", "1L AS document_id",
    )
    decided = counts._decided(counts._met(places, ingredients, clauses), clauses)
    assert ("BroadcastHashJoin" in final_plan(decided)) == (few > 0)
    rows = impact.requirements(places, ingredients, clauses)
    pairs = places.select("product_id", "market_id")
    want = impact.rollup(rows, pairs)
    got = counts.issue_counts(places, pairs, ingredients, clauses)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    keys = ["evaluation", "jurisdiction", "clause_type"]
    want = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("requirements"))
    assert sorted(map(str, counts.requirement_counts(places, ingredients, clauses).select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_leading_clauses_meet_products_only_the_way_they_lead(spark):
    """Every clause has a substance of its own, so it leads there; by type it must lead as well to meet a product."""
    places = spark.createDataFrame(
        [(p, m, t, j) for p, t in ((1, "SNACK"), (2, "*"), (3, None)) for m, j in (("m", "EU"), ("n", "EU"), ("n", "DE"))],
        "product_id LONG, market_id STRING, product_type STRING, jurisdiction STRING",
    )
    ingredients = spark.createDataFrame(
        [(p, s, a) for p in (1, 2, 3) for s, a in (("s40", 5), ("s41", None), ("s2", 5), ("water", 1))], "product_id LONG, substance STRING, amount LONG"
    ).selectExpr("product_id", "substance", "CAST(amount AS DECIMAL(18,6)) AS amount_base")
    clauses = spark.range(200).selectExpr(
        "id % 190 AS clause_id", "IF(id % 2 = 0, 'EU', 'DE') AS jurisdiction", "concat('s', id % 190) AS substance",
        "CASE WHEN id % 5 = 1 THEN '*' WHEN id % 5 < 4 THEN 'SNACK' END AS product_type",
        "CASE WHEN id % 190 IN (2, 40) THEN 'numeric_limit' WHEN id % 7 > 0 THEN 'labeling' END AS clause_type",
        "CAST(id % 3 AS DECIMAL(18,6)) AS limit_base", "CAST(id % 190 % 11 / 11 AS DECIMAL(18,6)) AS confidence", "1L AS document_id",
    )
    order = [F.desc("confidence"), F.asc("clause_id")]
    found = impact.requirements(places, ingredients, impact.leading(clauses, order, 3))
    # Three per jurisdiction and type (own and any), each perhaps twice, and those of the product's own substances.
    assert found.groupBy("product_id", "market_id").count().agg(F.max("count")).first()[0] <= 2 * 2 * 3 * 2 + 8
    whole = impact.requirements(places, ingredients, clauses)
    assert whole.count() > 5 * found.count()
    want, got = (sorted(map(tuple, grounding.strongest_clauses(rows, 3).collect())) for rows in (whole, found))
    assert want == got and len(got) == 9
    # By substance nothing but the way it travels differs.
    rows = [impact._by_substance(places, ingredients, impact._fields(clauses), few) for few in (False, True)]
    want, got = (sorted(map(str, r.select(found.columns[:8] + ["amount_base"]).collect())) for r in rows)
    assert want == got and len(got) > 0


def test_readiness_evaluates_few_clauses_by_type(spark, monkeypatch):
    """However many substances there are: one clause per type and jurisdiction, and the others not by type."""
    seen, whole = [], impact.requirements
    monkeypatch.setattr(impact, "requirements", lambda p, i, c: (seen.append(c), whole(p, i, c))[1])
    QUERIES["h22_readiness"](spark, "/root/testdata/sf0.01")
    others = seen[-1].where("clause_type <> 'numeric_limit'")
    typed = others.where("leads_type")
    assert 0 < typed.count() <= others.select("jurisdiction", "product_type").distinct().count() < others.count() / 2
    assert seen[-1].where("leads_type AND (leads_substance OR clause_type = 'numeric_limit')").isEmpty()


def test_rows_of_one_key_travel_and_meet_in_packs(spark):
    """A crowded key, a small one, one without a match, a null; in bounded packs, and the same rows as the plain join."""
    lookup = spark.range(2000).selectExpr("CASE WHEN id < 1900 THEN 1 WHEN id < 1950 THEN 2 WHEN id < 1990 THEN 3 END AS k", "id AS v", "IF(id % 3 = 0, NULL, 'w') AS w")
    facts = spark.range(40).selectExpr("CASE WHEN id % 4 > 0 THEN id % 4 END AS k", "id % 30 AS id")
    facts = facts.where("k IS NULL OR k < 3")
    packs = packed(lookup, ["k"])
    sizes = packs.select("k", F.size("_rows").alias("n")).collect()
    assert max(r.n for r in sizes) < 2 * PACK and len(sizes) < 20
    assert sorted(map(str, unpacked(packs).select("k", "v", "w").collect())) == sorted(map(str, lookup.collect()))
    want = facts.join(lookup, "k")
    got = salted_join(facts, lookup, ["k"], ["id"], broadcast=False, dealt=True, in_packs=True)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("SortMergeJoin")[0] and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["c05_requirements", "c06_requirement_changes"])
def test_what_is_no_limit_meets_the_products_told_and_bare(spark, monkeypatch, name):
    """Verdict or change are worked out among clauses, and only what the result names travels, in packs."""
    met, whole = [], impact.salted_join

    def spied(facts, lookup, on, *more, **how):
        met.append((on, set(lookup.columns), how))
        return whole(facts, lookup, on, *more, **how)

    monkeypatch.setattr(impact, "salted_join", spied)
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    [(columns, how)] = [(columns, how) for on, columns, how in met if "product_type" in on]
    assert how["in_packs"] and columns <= {*found.columns, "jurisdiction", "substance", "product_type"}
    assert columns & {"evaluation", "change"}


def test_the_chain_of_changes_is_not_shuffled_after_the_fan_out(spark):
    """The same rows as from given requirements; documents that repeat, are missing, or name no clause."""
    places = spark.createDataFrame(
        [(p, m, t, j) for p, t in ((1, "SNACK"), (2, "*"), (3, None)) for m, j in (("m", "EU"), ("n", "EU"), ("n", "DE"))],
        "product_id LONG, market_id STRING, product_type STRING, jurisdiction STRING",
    )
    ingredients = spark.createDataFrame([(p, s, a) for p in (1, 2, 3) for s, a in (("salt", 5), ("fat", None))], "product_id LONG, substance STRING, amount LONG")
    ingredients = ingredients.selectExpr("product_id", "substance", "CAST(amount AS DECIMAL(18,6)) AS amount_base")
    kinds = [(s, t, k) for s in ("salt", "fat", "water") for t in ("SNACK", "*", None) for k in ("labeling", "numeric_limit", None)]
    clauses = spark.createDataFrame(
        [(10 * n + len(j), j, *kind, n % 4) for n, kind in enumerate(kinds) for j in ("EU", "R", "DE")],
        "clause_id LONG, jurisdiction STRING, substance STRING, product_type STRING, clause_type STRING, document_id LONG",
    ).selectExpr("*", "CAST(4 AS DECIMAL(18,6)) AS limit_base", "CAST(0.9 AS DECIMAL(18,6)) AS confidence")
    documents = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d")], "document_id LONG, source STRING")
    changes = spark.createDataFrame(
        [(1, "m", "unknown", "compliant"), (2, "n", "compliant", "non_compliant"), (3, "n", "unknown", "attention_required")],
        "product_id LONG, market_id STRING, was STRING, status STRING",
    )
    moved = places.join(changes, ["product_id", "market_id"], "left_semi")
    want = impact.impact_chain(changes, impact.requirements(moved, ingredients, clauses), documents)
    found = impact.chain_of_changes(changes, places, ingredients, clauses, documents)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(found.columns).collect())) != []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Exchange" not in plan.split("Union")[0]
