"""Push envelopes: build, decode, tell good from malformed, fan out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complyframe.functions.ids import prefixed_id, trace_or_minted
from complyframe.operators.validate import reasons


def encode(payload_json: Column, attributes: Column, message_id: Column, published: Column) -> Column:
    """struct in the shape of a push delivery."""
    return F.struct(
        F.base64(F.encode(payload_json, "UTF-8")).alias("data"),
        attributes.alias("attributes"),
        message_id.alias("messageId"),
        published.alias("publishTime"),
    )


def decode(raw: DataFrame) -> DataFrame:
    """Open the envelope: payload (JSON text), trace_id, message_id and ``problem``.

    ``problem`` is null for a good message. No data at all is an empty payload.
    """
    data = F.col("message.data")
    opened = F.try_to_binary(data, F.lit("base64"))
    text = F.decode(opened, "UTF-8")
    empty = data.isNull() | (data == "")
    return (
        raw.withColumn("payload", F.when(empty, F.lit("{}")).otherwise(text))
        .withColumn("message_id", F.coalesce("message.messageId", F.lit("")))
        .withColumn("trace_id", F.col("message.attributes")["trace_id"])
        .withColumn(
            "problem",
            F.when(F.col("message").isNull(), "no_message")
            .when(~empty & opened.isNull(), "bad_base64")
            .when(~empty & F.try_parse_json(text).isNull(), "bad_json"),
        )
        .drop("message", "subscription")
    )


def split_malformed(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantine). A message that cannot be read is never retried."""
    return decoded.where("problem IS NULL").drop("problem"), decoded.where("problem IS NOT NULL")


def check_documents_message(decoded: DataFrame) -> DataFrame:
    """Payload contract of the upload topic: a document id must be there."""
    document = F.get_json_object("payload", "$.document_id")
    return decoded.withColumn("reasons", reasons(document_missing=document.isNull()))


def fan_out(clauses: DataFrame, topic: str) -> DataFrame:
    """One message per clause; the trace id travels with it."""
    return clauses.select(
        F.lit(topic).alias("topic"),
        prefixed_id("msg", F.lit(topic), F.col("clause_id"), width=32).alias("message_id"),
        F.to_json(F.struct("clause_id", "document_id")).alias("data"),
        F.create_map(F.lit("trace_id"), trace_or_minted(F.col("trace_id"), F.col("clause_id"))).alias("attributes"),
    )


def unprocessed(messages: DataFrame, processed: DataFrame, handler: str) -> DataFrame:
    """Drop what this handler has done. A blank message id is never a duplicate."""
    done = processed.where(F.col("handler") == handler).select("message_id").where("message_id <> ''").distinct()
    named = messages.where("message_id <> ''").join(done, "message_id", "left_anti")
    return named.unionByName(messages.where("message_id = ''"))
