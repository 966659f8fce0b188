"""Answers and the clauses they cite; retrieval."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from complyframe.functions import scoring
from complyframe.operators.joins import salted_join, shuffled_join


def check(log: DataFrame, clauses: DataFrame) -> DataFrame:
    """Outcome per query: every citation was retrieved, exists, and there is one."""
    outside = F.size(F.array_except("cited_clause_ids", "retrieved_clause_ids")) > 0
    cited = log.select("query_id", outside.alias("outside"), F.explode_outer("cited_clause_ids").alias("clause_id"))
    known = clauses.select("clause_id").distinct().withColumn("known", F.lit(True))
    seen = salted_join(cited, known, ["clause_id"], ["query_id"], "left")
    per_query = seen.groupBy("query_id").agg(
        F.bool_or("outside").alias("outside"),
        F.count("clause_id").alias("citations"),
        F.count_if(F.col("clause_id").isNotNull() & F.col("known").isNull()).alias("missing"),
    )
    return per_query.withColumn(
        "outcome",
        F.when(F.col("citations") == 0, "no_citation")
        .when(F.col("outside"), "not_retrieved")
        .when(F.col("missing") > 0, "unknown_clause")
        .otherwise("grounded"),
    )


def evidence(log: DataFrame, clauses: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per cited clause that exists, with its text fields and source document."""
    cited = log.select("query_id", F.explode("cited_clause_ids").alias("clause_id"))
    found = salted_join(cited, clauses, ["clause_id"], ["query_id"])
    return salted_join(found, documents, ["document_id"], ["query_id", "clause_id"], "left")


def answer_confidence(log: DataFrame, clauses: DataFrame) -> DataFrame:
    """The weakest cited clause sets the confidence of the answer."""
    cited = log.select("query_id", F.explode("cited_clause_ids").alias("clause_id"))
    found = salted_join(cited, clauses.select("clause_id", "confidence"), ["clause_id"], ["query_id"])
    return found.groupBy("query_id").agg(F.min("confidence").alias("confidence"))


def conflicts_of(required: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Open conflicts that touch a clause binding a product, on either side."""
    pairs = conflicts.select("clause_a", "clause_b")
    bound = required.select("product_id", "clause_id").distinct()
    sides = [
        shuffled_join(bound, pairs.withColumn("clause_id", F.col(side)), ["clause_id"])
        for side in ("clause_a", "clause_b")
    ]
    return sides[0].unionByName(sides[1]).select("product_id", "clause_a", "clause_b").distinct()


def strongest_clauses(required: DataFrame, k: int) -> DataFrame:
    """The k most trusted clauses of each product: what to fall back on."""
    distinct = required.groupBy("product_id", "clause_id").agg(F.max("confidence").alias("confidence"))
    window = Window.partitionBy("product_id").orderBy(F.desc("confidence"), F.asc("clause_id"))
    return distinct.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def find_similar(vectors: DataFrame, query: DataFrame, key: str, vector: str, k: int, **where) -> DataFrame:
    """Top k by cosine against one query vector (a frame of one row and one column)."""
    for column, value in where.items():
        if value is not None:
            vectors = vectors.where(F.col(column) == F.lit(value))
    asked = vectors.withColumn("query", query.scalar())
    score = scoring.cosine(F.col(vector), F.col("query"))
    return asked.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), F.asc(key)).limit(k).drop("query")


def provenance(branches: Mapping[str, DataFrame], decisions: DataFrame) -> DataFrame:
    """Counts per document of everything it led to.

    ``branches``: kind -> (document_id, label) rows. ``decisions``: guardrail
    counts by document (document_id, decision, pairs).
    """
    counted = [
        rows.groupBy("document_id", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        for kind, rows in branches.items()
    ]
    judged = decisions.select(
        "document_id", F.col("decision").alias("label"), F.col("pairs").alias("n"), F.lit("guardrail").alias("kind")
    )
    return reduce(DataFrame.unionByName, [*counted, judged])
