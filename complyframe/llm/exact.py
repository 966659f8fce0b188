"""Exact deduplication with skew-safe combining, on built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which the copies of one text are dealt before the last step.
SALTS = 16


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty.

    The two branches leave a lone space alone, so that most of a text is copied in one go.
    """
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "
    )


def combine(rows: DataFrame, digest: str, text: str, key: str, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, smallest key, number of copies.

    Copies meet three times, each time by digest *and* whole text: in the map
    task that read them (the partial aggregate), within a salt of their digest,
    then across the salts, where a text has at most ``salts`` rows left.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    winners = salted.groupBy(digest, "_salt", text).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("_n"))
    return winners.groupBy(digest, text).agg(F.min(key).alias("keep_id"), F.sum("_n").alias("group_size")).drop(text)


def duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, and ``copy``.

    Texts are equal when identical once normalised; null counts as empty, and
    so all empty texts are one group. Of a group the smallest id stays; null
    ids come last. ``copy`` numbers rows that repeat id and text, and only the
    first of them is kept. A row finds its group by SHA-256, XXH64 and length
    of the text; the groups themselves were told apart by the whole text. That
    join has one row per group on one side, so Spark can split a hot group's
    rows. Other columns are dropped.
    """
    rows = df.select(F.col(id_column).alias("doc_id"), normalised(F.col(text_column)).alias("_text"))
    digest = F.struct(
        F.sha2("_text", 256).alias("sha"), F.xxhash64("_text").alias("xx"), F.length("_text").alias("length")
    )
    rows = rows.withColumn("_digest", digest)
    groups = combine(rows, "_digest", "_text", "doc_id", salts)
    repeats = Window.partitionBy("doc_id", "_digest").orderBy("doc_id")
    keyed = rows.drop("_text").withColumn("copy", F.row_number().over(repeats))
    return keyed.join(groups, "_digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("_digest.sha").alias("text_sha256"),
        "copy",
    )


def deduplicated(df: DataFrame, flags: DataFrame) -> DataFrame:
    """The rows of ``df`` that ``flags`` (of :func:`duplicates`, stored) keeps, with all their columns."""
    own = "_sha"
    while own in df.columns:
        own += "_"
    marked = df.withColumn(own, F.sha2(normalised(F.col("text")), 256))
    kept = flags.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_kept_sha"))
    same = marked["doc_id"].eqNullSafe(kept["_id"]) & (marked[own] == kept["_kept_sha"])
    rows = marked.join(kept, same, "left_semi")
    if not flags.where("copy > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", own])
    return rows.select(*df.columns)
