"""Stream progress as a small metrics table (one row per finished micro-batch).

Uses the query's own progress reports (bounded by
``spark.sql.streaming.numRecentProgressUpdates``), so nothing from the data
passes through the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PROGRESS_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("num_input_rows", T.LongType()),
        T.StructField("input_rows_per_second", T.DoubleType()),
        T.StructField("processed_rows_per_second", T.DoubleType()),
        T.StructField("trigger_ms", T.LongType()),
    ]
)


def progress_table(spark: SparkSession, query) -> DataFrame:
    rows = []
    for p in query.recentProgress:
        d = p if isinstance(p, dict) else json.loads(p.json)
        dur = d.get("durationMs", {}) or {}
        rows.append(
            (
                int(d.get("batchId", -1)),
                int(d.get("numInputRows", 0) or 0),
                float(d.get("inputRowsPerSecond", 0.0) or 0.0),
                float(d.get("processedRowsPerSecond", 0.0) or 0.0),
                int(dur.get("triggerExecution", 0) or 0),
            )
        )
    return spark.createDataFrame(rows, PROGRESS_SCHEMA)
