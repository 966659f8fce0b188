"""How many requirements pass, fail or need review, without writing any of them out.

The clauses of a (jurisdiction, substance) collapse to their different limits
with running counts. An amount is looked up there: limits below it fail, the
others pass. Only the places where a product's ingredient meets a jurisdiction
are rows; the clauses behind them are numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from complyframe.constants import ANY_PRODUCT_TYPE, REVIEW_CONFIDENCE
from complyframe.functions import scoring
from complyframe.operators.impact import PAIR, _before_fan_out
from complyframe.operators.joins import salted_join
from complyframe.sources import storage

SCOPE = ["jurisdiction", "substance"]
#: Limits and amounts this far apart, in base units, are summed in slices of their own first.
SLICE = 1000


def _decidable() -> Column:
    """Numeric, confident and with a limit: the amount alone decides."""
    confident = F.coalesce(F.col("confidence") >= F.lit(REVIEW_CONFIDENCE), F.lit(False))
    return (F.col("clause_type") == "numeric_limit") & confident & F.col("limit_base").isNotNull()


def limits_below(clauses: DataFrame, amounts: DataFrame) -> DataFrame:
    """jurisdiction, substance, amount_base, below: how many decidable limits lie below each different amount.

    ``amounts``: jurisdiction, substance, amount_base, not null, each once.
    Limits and amounts are put in one order and running counts taken, first
    within slices of values, then over slices; no limit meets an amount as a pair.
    """
    limits = clauses.where(_decidable()).groupBy(*SCOPE, F.col("limit_base").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    probes = amounts.select(*SCOPE, F.col("amount_base").alias("value"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("probe"))
    # An amount comes before an equal limit, which it does not break.
    line = limits.withColumn("probe", F.lit(False)).unionByName(probes)
    line = line.withColumn("slice", F.floor(F.col("value") / SLICE))
    within = Window.partitionBy(*SCOPE, "slice").orderBy("value", F.desc("probe"))
    inner = line.withColumn("inner", F.sum("n").over(within)).where("probe")
    sums = line.groupBy(*SCOPE, "slice").agg(F.sum("n").alias("n"))
    outer = sums.withColumn("outer", F.sum("n").over(Window.partitionBy(*SCOPE).orderBy("slice")) - F.col("n"))
    joined = inner.join(outer.drop("n"), [*SCOPE, "slice"])
    return joined.select(*SCOPE, F.col("value").alias("amount_base"), (F.col("inner") + F.col("outer")).alias("below"))


def scope_totals(clauses: DataFrame) -> DataFrame:
    """Per jurisdiction and substance: decidable limits, numeric clauses in doubt, other clauses."""
    numeric = F.col("clause_type") == "numeric_limit"
    return clauses.groupBy(*SCOPE).agg(
        F.count_if(_decidable()).alias("limits"),
        F.count_if(numeric & ~_decidable()).alias("doubtful"),
        F.count_if(~numeric).alias("others"),
    )


#: Up to so many different amounts are looked up in every task; beyond, rows are sent to their amount.
FEW_AMOUNTS = 100_000


def _met(places: DataFrame, ingredients: DataFrame, clauses: DataFrame) -> DataFrame:
    """Where an ingredient meets clauses: its amount, and how many limits, doubtful limits and other clauses there are."""
    content = _before_fan_out(places).select(*PAIR, "product_type", "jurisdiction").join(ingredients, "product_id")
    met = salted_join(content, scope_totals(clauses), SCOPE, PAIR)
    # Written once: looked up, and read for its amounts.
    kept = [*PAIR, "product_type", *SCOPE, "amount_base", "limits", "doubtful", "others"]
    return storage.written(met.select(*kept), storage.run_folder(places.sparkSession))


def _decided(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """Rows of `_met`, or groups of them, with pass, fail and review of the numeric clauses of one such row."""
    amounts = rows.where("amount_base IS NOT NULL").select(*SCOPE, "amount_base").distinct()
    # Written for its size, which Spark takes for the product of what it is joined from, and so shuffles every row.
    below = storage.written(limits_below(clauses, amounts), storage.run_folder(rows.sparkSession))
    # Otherwise nearly as many amounts as rows, so not repeated per salt; adaptive execution splits one that many products share.
    below = F.broadcast(below) if below.count() <= FEW_AMOUNTS else below.hint("merge")
    known = rows.join(below, [*SCOPE, "amount_base"], "left")
    fails = F.coalesce("below", F.lit(0).cast("bigint"))
    unknown = F.col("amount_base").isNull()
    return known.withColumns(
        {
            "critical": F.when(unknown, 0).otherwise(fails),
            "passed": F.when(unknown, 0).otherwise(F.col("limits") - fails),
            "to_review": F.col("doubtful") + F.when(unknown, F.col("limits")).otherwise(0),
        }
    ).drop("below")


def _types(product_type: Column) -> Column:
    return F.explode(F.array_distinct(F.array(product_type, F.lit(ANY_PRODUCT_TYPE))))


def issue_counts(places: DataFrame, product_markets: DataFrame, ingredients: DataFrame, clauses: DataFrame) -> DataFrame:
    """Status per product × market with counts, as ``impact.rollup`` gives from all requirements.

    A non-numeric clause binds by substance or by product type. It counts once:
    those of a type, less those of the type whose substance the product has.
    """
    met = _met(places, ingredients, clauses)
    decided = _decided(met, clauses)
    by_substance = decided.select(*PAIR, "critical", "passed", (F.col("to_review") + F.col("others")).alias("to_review"))
    typed = clauses.where("clause_type <> 'numeric_limit'")
    per_type = typed.groupBy("jurisdiction", "product_type").agg(F.count(F.lit(1)).alias("n"))
    per_both = typed.groupBy(*SCOPE, "product_type").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    scopes = _before_fan_out(places).withColumn("product_type", _types(F.col("product_type")))
    by_type = salted_join(scopes, per_type, ["jurisdiction", "product_type"], PAIR)
    again = met.where("others > 0").withColumn("product_type", _types(F.col("product_type")))
    again = salted_join(again, per_both, [*SCOPE, "product_type"], PAIR)
    review = lambda rows, n: rows.select(*PAIR, zero.alias("critical"), zero.alias("passed"), n.alias("to_review"))
    rows = by_substance.unionByName(review(by_type, F.col("n"))).unionByName(review(again, -F.col("n")))
    rows = rows.unionByName(review(product_markets, zero))
    counts = rows.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in ("critical", "to_review", "passed")])
    return counts.withColumn(
        "status", scoring.rollup_status(F.col("critical") > 0, F.col("to_review") > 0, F.col("passed") > 0)
    )


def requirement_counts(places: DataFrame, ingredients: DataFrame, clauses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """evaluation, jurisdiction, clause_type, requirements: counts of counts, with no row per clause and product.

    ``by`` names further columns of ``places`` to count by, such as market_id.
    """
    met = _met(places, ingredients, clauses)
    kinds = F.explode(
        F.array(
            *[F.struct(F.lit(name).alias("evaluation"), (F.col(c) * F.col("_places")).alias("n")) for name, c in (("fail", "critical"), ("pass", "passed"), ("needs_review", "to_review"))]
        )
    )
    columns = [*by, "jurisdiction", "clause_type", "evaluation", "n"]
    # Places of one amount are decided as one.
    alike = met.groupBy(*by, *SCOPE, "amount_base", "limits", "doubtful").agg(F.count(F.lit(1)).alias("_places"))
    numeric = _decided(alike, clauses).withColumns({"clause_type": F.lit("numeric_limit"), "k": kinds}).select(*columns[:-2], "k.*")
    typed = clauses.where("clause_type <> 'numeric_limit'")

    def product(rows: DataFrame, keys: list[str], sign: int) -> DataFrame:
        """Rows per key times clauses per key and type."""
        sizes = rows.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_rows"))
        each = typed.groupBy(*keys, "clause_type").agg(F.count(F.lit(1)).alias("_each"))
        joined = sizes.join(each, keys)
        n = F.col("_rows") * F.col("_each") * sign
        return joined.withColumns({"evaluation": F.lit("needs_review"), "n": n}).select(*columns)

    apart = _types(F.col("product_type"))
    others = met.where("others > 0")
    rows = numeric.unionByName(product(others, SCOPE, 1))
    rows = rows.unionByName(product(places.withColumn("product_type", apart), ["jurisdiction", "product_type"], 1))
    rows = rows.unionByName(product(others.withColumn("product_type", apart), [*SCOPE, "product_type"], -1))
    counts = rows.groupBy(*by, "evaluation", "jurisdiction", "clause_type").agg(F.sum("n").alias("requirements"))
    return counts.where("requirements > 0")
