"""Identifiers that come out the same when a task is run again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def marker_key(handler: Column | str, message_id: Column) -> Column:
    handler = F.lit(handler) if isinstance(handler, str) else handler
    return F.concat_ws(":", handler, message_id)


def prefixed_id(prefix: str, *natural_key: Column, width: int = 12) -> Column:
    """prefix_ + hex digits of the key's hash.

    Twelve digits is the short form shown to people. Pass ``width=64`` for keys
    of large tables: 48 bits collide from some millions of rows on.
    """
    digest = F.sha2(F.concat_ws("|", *[c.cast("string") for c in natural_key]), 256)
    return F.concat(F.lit(prefix + "_"), F.substring(digest, 1, width))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def trace_or_minted(trace_id: Column, *natural_key: Column) -> Column:
    """Keep a given trace id; derive one from the message where it is blank."""
    minted = F.substring(F.sha2(F.concat_ws("|", *[c.cast("string") for c in natural_key]), 256), 1, 32)
    return F.coalesce(F.nullif(trace_id, F.lit("")), minted)
