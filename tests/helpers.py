from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import SparkSession

from tickerlake.schemas import EVENT_SCHEMA


def ms(dt: datetime) -> int:
    return int(dt.replace(tzinfo=UTC).timestamp() * 1000)


def events_df(spark: SparkSession, rows: list[tuple]):
    """rows: (source, event_id, datetime, text[, author])"""
    out = []
    for r in rows:
        source, eid, ts, text = r[:4]
        author = r[4] if len(r) > 4 else "someone"
        out.append((source, eid, ms(ts), ms(ts), author, text, None))
    return spark.createDataFrame(out, EVENT_SCHEMA)
