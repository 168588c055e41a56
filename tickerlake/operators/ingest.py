"""Upstream items -> lake events: normalise, filter, and reject reasons.

An item is a nullable struct (id, time in epoch seconds, by, title, text,
url, deleted, dead). Text is the first non-empty of title and text.
Deleted, dead and text-less items are rejected as "empty"; a missing item
as "null", an item with text but no id as "no_id".

The struct is flattened once (item.* plus a null flag) before any test, so
each field is extracted once per row rather than once per reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerlake.schemas import ITEM_SCHEMA

_NULL = "_item_is_null"


def _flatten(items: DataFrame, item_col: str) -> DataFrame:
    it = F.col(item_col)
    return items.select(it.isNull().alias(_NULL), *[it[f.name].alias(f.name) for f in ITEM_SCHEMA.fields])


def _body() -> Column:
    return F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("text"), F.lit("")), F.lit(""))


def _reason() -> Column:
    gone = F.coalesce(F.col("deleted"), F.lit(False)) | F.coalesce(F.col("dead"), F.lit(False))
    return (
        F.when(F.col(_NULL), F.lit("null"))
        .when(gone | (_body() == ""), F.lit("empty"))
        .when(F.col("id").isNull(), F.lit("no_id"))
        .otherwise(F.lit("accepted"))
    )


def normalise_items(
    items: DataFrame, source: str, ingested_ts: Column | int | None = None, item_col: str = "item"
) -> DataFrame:
    """Accepted items as events (lake contract columns).

    ``event_ts`` = time x 1000 (a missing time gives 0, i.e. 1970-01-01);
    ``ingested_ts`` defaults to the current time of the run.
    """
    if ingested_ts is None:
        ingested = F.unix_millis(F.current_timestamp())
    elif isinstance(ingested_ts, Column):
        ingested = ingested_ts
    else:
        ingested = F.lit(int(ingested_ts))
    flat = _flatten(items, item_col)
    return flat.filter(_reason() == "accepted").select(
        F.lit(source).alias("source"),
        F.col("id").cast("string").alias("event_id"),
        (F.coalesce(F.col("time"), F.lit(0)) * 1000).cast("long").alias("event_ts"),
        ingested.cast("long").alias("ingested_ts"),
        F.col("by").alias("author"),
        _body().alias("text"),
        F.col("url").alias("url"),
    )


def reject_counts(items: DataFrame, item_col: str = "item") -> DataFrame:
    """(reason, n) over a batch of items."""
    return _flatten(items, item_col).groupBy(_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))
