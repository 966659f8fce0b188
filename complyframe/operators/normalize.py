"""Dictionary joins for names and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complyframe.functions import text
from complyframe.operators.joins import salted_join


def normalize_by_join(names: DataFrame, name: str, dictionary: DataFrame) -> DataFrame:
    """Substance normalisation where the dictionary (synonym, canonical) is a table.

    Distinct names are looked up once, so a popular name costs one row of join.
    """
    keys = names.select(text.name_key(F.col(name)).alias("_key")).distinct()
    tried = keys.select(
        "_key", F.posexplode(F.concat(F.array("_key"), text.name_parts(F.col("_key")))).alias("_pos", "synonym")
    )
    hits = (
        tried.join(dictionary, "synonym")
        .groupBy("_key")
        .agg(F.min_by("canonical", "_pos").alias("_canonical"))
    )
    keyed = names.withColumn("_key", text.name_key(F.col(name)))
    return (
        salted_join(keyed, hits, ["_key"], names.columns, "left")
        .withColumn("normalized", F.coalesce("_canonical", text.slugify(F.col("_key"))))
        .withColumn("unnormalized", F.col("_canonical").isNull())
        .drop("_key", "_canonical")
    )


def market_prefixes(markets: DataFrame) -> DataFrame:
    """(prefix, market_id): the first market, by id, with a code that starts so.

    Spelling out the prefixes turns "starts with" into an equality join.
    """
    codes = F.transform(F.array_union("jurisdictions", F.array("country_code")), F.upper)
    spelled = markets.select(F.col("id"), F.explode(F.array_distinct(codes)).alias("code"))
    # A blank code is met by a blank request only, so its one prefix is itself.
    ends = F.when(F.length("code") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.length("code")))
    cut = spelled.select("id", F.explode(F.transform(ends, lambda n: F.substring("code", F.lit(1), n))).alias("prefix"))
    return cut.groupBy("prefix").agg(F.min("id").alias("market_id"))


def lookup_markets(requests: DataFrame, code: str, markets: DataFrame) -> DataFrame:
    """Add wanted, found and market_id to each request."""
    wanted = requests.withColumn("wanted", F.upper(F.trim(F.coalesce(code, F.lit("")))))
    prefixes = market_prefixes(markets).withColumnRenamed("prefix", "wanted")
    joined = salted_join(wanted, prefixes, ["wanted"], requests.columns, "left")
    return joined.withColumn("found", F.col("market_id").isNotNull())
