"""Collections as Parquet tables: scans, lookups, seeds, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complyframe.constants import LIST_LIMIT, SEED_MARKETS, SOURCE_CATALOGUE, WORKSPACE_ID
from complyframe.functions.ids import content_hash
from complyframe.operators.joins import salted_join
from complyframe.schemas import CATALOGUE, MARKETS


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def stream_of(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream; new files are new rows."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_of_table(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """One Parquet table of a folder as a stream, be it one file or a folder of files.

    The braces make its name a pattern, which may be either; as a plain path it may not be a file.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder.rstrip('/')}/{{{name}.parquet}}")


def get(df: DataFrame, key: str, value) -> DataFrame:
    """The row with this id; a miss is an empty frame."""
    return df.where(F.col(key) == F.lit(value))


def where_all(df: DataFrame, **wanted) -> DataFrame:
    """Equality on each column given; None leaves a column open."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def in_workspace(df: DataFrame, workspace_id: str = WORKSPACE_ID) -> DataFrame:
    return where_all(df, workspace_id=workspace_id)


def newest(df: DataFrame, at: str, key: str, k: int = LIST_LIMIT) -> DataFrame:
    """The k newest rows; undated rows last, ties by id."""
    return df.orderBy(F.desc_nulls_last(at), F.asc(key)).limit(k)


def seed_markets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_MARKETS, MARKETS)


def source_catalogue(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(SOURCE_CATALOGUE, CATALOGUE)
    return rows.withColumns({c: F.col(c).cast("date") for c in ("in_force_from", "in_force_to")})


def with_catalogue(documents: DataFrame, catalogue: DataFrame, on: Sequence[str], key: str) -> DataFrame:
    """One source may hold most documents, so its key is spread."""
    return salted_join(documents, catalogue, on, [key], "left")


def land_documents(texts: DataFrame) -> DataFrame:
    """Pasted text with its metadata becomes an uploaded document.

    Expects document_id, text, source_type, source_name, jurisdiction,
    declared_effective_date. Batch or stream.
    """
    return texts.select(
        "document_id",
        "text",
        content_hash(F.col("text")).alias("content_sha256"),
        "source_type",
        "source_name",
        "jurisdiction",
        "declared_effective_date",
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.lit("uploaded").alias("status"),
    )
