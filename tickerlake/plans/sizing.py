"""Size checks for broadcast decisions.

A side is broadcast only when the optimizer's size estimate for it is under
a bound; otherwise the join is left to the planner (sort-merge or shuffled
hash join, with AQE re-planning at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default bound for explicit broadcast hints (dimension tables: lexicons,
# symbol universes, chunk summaries).
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of ``df`` in bytes."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    # a Scala BigInt; py4j may hand it over as an int or as an object
    return int(str(stats.sizeInBytes()))


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``broadcast(df)`` if its estimated size is at most ``limit``, else ``df``."""
    if estimated_bytes(df) <= limit:
        return F.broadcast(df)
    return df


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread ``df`` by a row hash when its input would give fewer splits than cores.

    For CPU-heavy per-row work (tokenising long texts) on inputs stored as
    few large files. The split count is estimated from the optimizer's size
    estimate and ``spark.sql.files.maxPartitionBytes`` (no job is run). On a
    large input the estimate is far above the core count and this is a
    no-op, so no shuffle is added where the scan already gives enough tasks.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if -(-estimated_bytes(df) // max(split, 1)) >= target:
        return df
    # Hash of the whole row: deterministic on retry without the local sort a
    # round-robin repartition needs.
    return df.repartition(target, F.xxhash64(*[F.col(c) for c in df.columns]))
