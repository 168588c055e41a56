"""Bounded row windows for long per-key histories.

``Window.partitionBy(key).orderBy(t).rowsBetween(-k, 0)`` puts each key's
whole history in one task: a hot key (a third of all rows) becomes one
straggler and parallelism is capped at the number of keys. ``blocked_rows``
gives the same frames with bounded partitions:

1. number each key's rows 0..n-1 in order, with a two-level prefix count
   (rows per key and day -> running offsets per key over days, a small
   table -> offset + row number within the day);
2. cut the numbering into blocks of ``block_rows`` and copy the last
   ``lookback`` rows of every block into the next block as context rows;
3. a window partitioned by (key, block), ordered by the row number, now
   sees every frame it needs; the caller drops the context rows.

All windows involved are bounded by a day, a block or the number of days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerlake.plans.sizing import bounded_broadcast

DEFAULT_BLOCK_ROWS = 4096
IDX, BLK, CTX = "_idx", "_blk", "_ctx"


def row_index(df: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``_idx``: 0-based position of each row within its key in ``order`` order.

    ``order`` must be a timestamp column (days are the first level).
    """
    d = df.withColumn("_day", F.to_date(order))
    per_day = d.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_day.select(key, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(key, "_day").orderBy(order)
    return (
        d.join(bounded_broadcast(offsets), [key, "_day"])
        .withColumn(IDX, F.col("_off") + F.row_number().over(within) - 1)
        .drop("_off", "_day")
    )


def blocked_rows(
    df: DataFrame, key: str, order: str, lookback: int, block_rows: int = DEFAULT_BLOCK_ROWS
) -> tuple[DataFrame, Window]:
    """(rows with _idx/_blk/_ctx, base window) for exact ``lookback``-row frames.

    Use ``base.rowsBetween(-j, 0)`` with ``j <= lookback`` (or ``lag`` up to
    ``lookback``) on the returned rows, then filter ``~_ctx`` and drop the
    helper columns. ``df`` feeds both the counts and the
    rows; Spark reuses its last exchange.
    """
    if block_rows <= lookback:
        raise ValueError("block_rows must exceed the lookback")
    idx = row_index(df, key, order)
    own = F.expr(f"{IDX} div {block_rows}")
    blocks = F.when(F.col(IDX) % block_rows >= block_rows - lookback, F.array(own, own + 1)).otherwise(F.array(own))
    spread = idx.select("*", F.explode(blocks).alias(BLK)).withColumn(CTX, F.col(BLK) != own)
    return spread, Window.partitionBy(key, BLK).orderBy(IDX)


def finish(rows: DataFrame) -> DataFrame:
    """Drop context copies and helper columns."""
    return rows.filter(~F.col(CTX)).drop(CTX, BLK, IDX)


def blocked_range(df: DataFrame, key: str, at: str, lookback: int, block: int = 1440) -> tuple[DataFrame, Window]:
    """(rows with _blk/_ctx, base window) for exact ranges of ``lookback`` units of the integer ``at``.

    Blocks are ``block`` units long; rows of the last ``lookback`` units of a
    block are copied into the next one as context.
    """
    if block <= lookback:
        raise ValueError("block must exceed the lookback")
    own = F.floor(F.col(at) / block)
    blocks = F.when(F.pmod(F.col(at), F.lit(block)) >= block - lookback, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.select("*", F.explode(blocks).alias(BLK)).withColumn(CTX, F.col(BLK) != own)
    return spread, Window.partitionBy(key, BLK).orderBy(at)
