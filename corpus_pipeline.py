"""Documents to training sequences: rules, exact and near duplicates out, the rest packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complyframe.llm import exact, packing, rules, simhash
from complyframe.llm.shared import stored


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not use."""
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of id and whole text, in the order of ids, rows without one last; and its name."""
    name = _free(docs, "_row")
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.sha2(text, 256).alias("sha"))
    return docs.withColumn(name, key), name


def _only(docs: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is among ``keys``; only rows equal in id and text share their fate."""
    kept = keys.select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs[name] == kept["_kept"], "left_semi").drop(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    keyed, name = _keyed(docs)
    return _only(keyed, name, rules.judge(keyed, name).where("kept"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact.deduplicated(docs, stored(exact.duplicates(docs), "flags"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one document stays, the one with the smallest id, or the smallest digest where ids repeat."""
    keyed, name = _keyed(docs)
    return _only(keyed, name, simhash.near_duplicates(keyed, id_column=name).where("doc_id = component_id"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all tokens in sequences of 2,048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: Robust estimates and bin completion are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
