"""The extract stage: messages about uploaded documents to clauses, events and a stage log, all or nothing per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complyframe.constants import ANY_PRODUCT_TYPE, WORKSPACE_ID
from complyframe.functions import scoring, text
from complyframe.functions.ids import content_hash, prefixed_id, trace_or_minted
from complyframe.operators import extract, reconcile, validate
from complyframe.sources import messages
from complyframe.streaming.logs import BASELINE, Outputs

#: What a message says about its document.
PAYLOAD = (
    "document_id STRING, text STRING, page_count INT, size_bytes BIGINT, source_type STRING, source_name STRING, "
    "jurisdiction STRING, product_type STRING, effective_date DATE, document_date DATE, fallback_parser BOOLEAN"
)
OUTPUTS = {
    "inbox": ["message_id"],
    "quarantine": ["message_id"],
    "documents": ["document_id"],
    "stages": ["document_id", "stage"],
    "candidates": ["content_sha256", "ordinal"],
    "rejected": ["document_id", "ordinal"],
    "clauses": ["clause_id"],
    "messages": ["message_id"],
    "events": ["event_id"],
}


class DocumentIntake:
    """Admission, cache, two extraction passes, demotion, confidence, clauses; one writer, one batch at a time.

    Every output of a batch becomes visible with its marker. What a batch
    gives depends only on its messages and on finished earlier batches, so a
    batch that runs again gives the same; ``downstream`` gets its clauses after
    the marker and must itself bear repetition.
    """

    def __init__(self, spark: SparkSession, folder: str, downstream: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.outputs, self.downstream = spark, Outputs(spark, folder, OUTPUTS), downstream

    def on_messages(self, arrived: DataFrame, batch: int) -> None:
        put = lambda name, rows: self.outputs.write(name, rows, batch)
        inbox = put("inbox", messages.decode(arrived.select("message", F.lit(None).cast("string").alias("subscription"))
                                             .withColumn("published_at", F.to_timestamp("message.publishTime"))))
        usable, malformed = messages.split_malformed(inbox)
        opened = usable.select(
            "message_id",
            "published_at",
            trace_or_minted(F.col("trace_id"), F.col("message_id"), F.col("payload")).alias("trace_id"),
            F.from_json("payload", PAYLOAD).alias("d"),
            "payload",
        )
        nameless = opened.where("d.document_id IS NULL").select("message_id", F.lit("document_missing").alias("problem"))
        put("quarantine", malformed.select("message_id", "problem").unionByName(nameless))

        documents = put("documents", self._admitted(opened.where("d.document_id IS NOT NULL"), batch))
        admitted = documents.where("error IS NULL")
        candidates = self._candidates(admitted, batch)
        found = admitted.drop("text", "status", "error").join(candidates, "content_sha256")
        # No number to be read: kept with its reason, not dropped.
        unread = found.where("limit_value IS NULL")
        put("rejected", unread.select("document_id", "ordinal", "statement", F.lit("limit_unreadable").alias("reason")))
        clauses = put("clauses", self._clauses(found.where("limit_value IS NOT NULL")))
        put("messages", messages.fan_out(clauses, "clause.extracted"))
        counts = clauses.groupBy("document_id").agg(F.count(F.lit(1)).alias("clause_count"))
        handled = documents.drop("text").join(counts, "document_id", "left").na.fill(0, ["clause_count"])
        put("stages", self._stages(handled))
        put("events", self._events(handled))
        self.outputs.commit(batch)
        if self.downstream:
            self.downstream(self.outputs.rows("clauses").where(F.col("batch") == batch).drop("batch"), batch)

    def _admitted(self, opened: DataFrame, batch: int) -> DataFrame:
        """One row per document not handled before: the first message about it, by time, id and content."""
        first = opened.groupBy("d.document_id").agg(
            F.min_by(F.struct("d", "trace_id", "published_at"), F.struct(F.col("published_at").isNull(), "published_at", "message_id", "payload")).alias("m")
        )
        if batch > BASELINE + 1:
            first = first.join(self.outputs.rows("documents", batch).select("document_id"), "document_id", "left_anti")
        rows = first.select("m.d.*", "m.trace_id", F.col("m.published_at").alias("uploaded_at"))
        rows = rows.withColumn("content_sha256", content_hash(F.coalesce("text", F.lit(""))))
        checked = validate.admit_documents(rows).withColumnRenamed("reject_reason", "error")
        error = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "no_text").otherwise(F.col("error"))
        return checked.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "extracted").otherwise("failed"))

    def _candidates(self, admitted: DataFrame, batch: int) -> DataFrame:
        """Candidates of the batch's contents: from the cache where a finished batch has read them, else by two passes.

        The second pass reads only the paragraphs that look relevant; what both
        passes agree on is what a candidate is trusted for.
        """
        contents = admitted.groupBy("content_sha256").agg(
            F.first("text").alias("text"), F.max("page_count").alias("page_count"), F.bool_or(F.coalesce("fallback_parser", F.lit(False))).alias("fallback")
        )
        known = None
        if batch > BASELINE + 1:
            read = self.outputs.rows("documents", batch).where("error IS NULL").select("content_sha256").distinct()
            known = self.outputs.rows("candidates", batch).join(contents.select("content_sha256"), "content_sha256", "left_semi")
            contents = contents.join(read, "content_sha256", "left_anti")
        key = "content_sha256"
        any_of = "|".join(pattern for _, pattern in extract.CATEGORIES)
        relevant = F.array_join(F.filter(F.split("text", "\n"), lambda p: F.lower(p).rlike(any_of)), "\n")
        first = extract.candidates(contents, key)
        second = extract.candidates(contents.withColumn("text", relevant), key)
        agreed = extract.agreement(first, second, key, ["limit_value", "unit"]).select(key, "substance", "ordinal", "self_consistency")
        lost = F.regexp_count("text", F.lit("�"))
        quality = extract.parse_quality(F.length("text"), F.coalesce("page_count", F.lit(1)), lost, F.col("fallback"))
        read_well = contents.select(key, quality.cast(text.AMOUNT).alias("parse_quality"))
        rows = first.join(agreed, [key, "substance", "ordinal"]).join(read_well, key)
        rows = self.outputs.write("candidates", rows.withColumn("self_consistency", F.col("self_consistency").cast(text.AMOUNT)), batch)
        return rows if known is None else rows.unionByName(known.drop("batch"))

    @staticmethod
    def _clauses(found: DataFrame) -> DataFrame:
        """Clauses with deterministic ids; an unknown unit is kept as ``other`` for review, an unknown substance flagged."""
        tier = scoring.authority_tier(F.col("source_type"))
        rows = validate.demote_unknown_units(found).withColumns(
            {
                "clause_id": prefixed_id("clause", F.col("document_id"), F.col("ordinal"), width=32),
                "authority_tier": tier,
                "confidence": scoring.composite_confidence(F.col("parse_quality"), F.col("self_consistency"), tier),
                "product_type": F.coalesce("product_type", F.lit(ANY_PRODUCT_TYPE)),
                "effective_date": F.coalesce("effective_date", F.to_date("uploaded_at")),
                "document_date": F.coalesce("document_date", F.to_date("uploaded_at")),
                "created_at": F.col("uploaded_at"),
            }
        )
        rows = reconcile.comparable_form(rows)
        return rows.select(
            "clause_id", "document_id", "ordinal", F.col("statement").alias("text"), "clause_type", "substance", "unnormalized",
            "limit_value", "unit", "basis", "limit_base", "product_type", "jurisdiction", "effective_date", "document_date",
            "source_type", "authority_tier", "parse_quality", "self_consistency", "confidence", "status", "trace_id", "created_at",
        )

    @staticmethod
    def _stages(handled: DataFrame) -> DataFrame:
        """uploaded, extracting, then extracted or failed with the error; ``seq`` orders them."""
        ok = F.col("error").isNull()
        step = lambda seq, stage, good, count: F.struct(
            F.lit(seq).alias("seq"), F.lit(stage).alias("stage") if isinstance(stage, str) else stage.alias("stage"), good.alias("ok"), count.alias("clause_count")
        )
        none = F.lit(None).cast("bigint")
        steps = F.array(
            step(0, "uploaded", F.lit(True), none),
            step(1, "extracting", F.lit(True), none),
            step(2, F.col("status"), ok, F.col("clause_count")),
        )
        rows = handled.select("document_id", F.col("uploaded_at").alias("at"), "trace_id", "error", F.explode(steps).alias("s"))
        return rows.select("document_id", "s.*", "at", "trace_id", F.when(F.col("s.ok"), F.lit(None)).otherwise(F.col("error")).alias("error"))

    @staticmethod
    def _events(handled: DataFrame) -> DataFrame:
        return handled.select(
            prefixed_id("evt", F.lit("document_ingested"), F.col("document_id"), width=32).alias("event_id"),
            F.lit("document_ingested").alias("event_type"),
            F.lit("document").alias("entity_type"),
            F.col("document_id").alias("entity_id"),
            F.lit(None).cast("string").alias("before"),
            F.to_json(F.struct("status", "error", "content_sha256", "clause_count", "jurisdiction", "source_type")).alias("after"),
            F.to_json(F.struct("document_id")).alias("cause"),
            F.lit("extraction").alias("triggered_by"),
            "trace_id",
            F.lit(WORKSPACE_ID).alias("workspace_id"),
            F.col("uploaded_at").alias("occurred_at"),
        )
