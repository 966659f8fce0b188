"""Where results are put: run folders, snapshots and the append-only log."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared one named by ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # Executors of a cluster would each write to a disk of their own.
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/complyframe/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write once, read back: cuts lineage through storage that outlives executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Overwrite each table of a baseline or snapshot version."""
    return {name: written(df, f"{folder}/{name}") for name, df in tables.items()}


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or an empty frame of the same columns before the first write."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append events not yet in the log; running a batch twice adds nothing.

    Only the days present in the batch are compared.
    """
    spark = events.sparkSession
    fresh = events.withColumn("event_date", F.to_date("occurred_at"))
    days = fresh.agg(F.min("event_date").alias("first"), F.max("event_date").alias("last")).first()
    logged = read_or_empty(spark, path, fresh).where(F.col("event_date").between(days["first"], days["last"]))
    logged = logged.select("event_date", "event_id")
    fresh.join(logged, ["event_date", "event_id"], "left_anti").write.mode("append").partitionBy(
        "event_date"
    ).parquet(path)


def merge_upsert(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Field-level merge: a null in the patch keeps the old value; new keys are added."""
    fields = [c for c in base.columns if c != key]
    b, p = base.alias("b"), patch.alias("p")
    return b.join(p, F.col(f"b.{key}") == F.col(f"p.{key}"), "full_outer").select(
        F.coalesce(f"b.{key}", f"p.{key}").alias(key),
        *[
            F.coalesce(f"p.{c}", f"b.{c}").alias(c) if c in patch.columns else F.col(f"b.{c}").alias(c)
            for c in fields
        ],
    )


def snapshot_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one snapshot only, with the side that has them; empty when equal."""
    columns = left.columns
    counted = (
        left.withColumn("_n", F.lit(1))
        .unionByName(right.select(*columns).withColumn("_n", F.lit(-1)))
        .groupBy(*columns)
        .agg(F.sum("_n").alias("_n"))
        .where("_n <> 0")
    )
    return counted.select(
        F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").alias("copies"), *columns
    )
