"""One-minute OHLCV bars from trade prints, and the closes a signal joins to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerlake.functions.timecols import event_at, truncate
from tickerlake.plans.sizing import ensure_parallelism


def resample_prints(prints: DataFrame) -> DataFrame:
    """(ticker, ts, open, high, low, close, volume) per ticker and minute.

    ``prints`` has (ticker, trade_us, trade_id, price, qty). Open and close
    are the first and last price in (trade_us, trade_id) order, a total
    order, so ties are deterministic. One row per (ticker, minute) by
    construction; hash aggregation with map-side partials, so a hot ticker
    is combined before the shuffle.
    """
    order_key = print_order_key(F.col("trade_us"), F.col("trade_id"))
    minute = F.expr("trade_us div 60000000") * 60_000
    return ensure_parallelism(prints).groupBy("ticker", minute.alias("ts")).agg(
        F.min_by("price", order_key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order_key).alias("close"),
        F.sum("qty").cast("long").alias("volume"),
    )


def print_order_key(trade_us, trade_id):
    """(trade_us, trade_id) packed into one DECIMAL(38,0) that sorts the same way.

    A struct key would force sort-based aggregation (struct buffers are not
    fixed-width); a decimal key keeps ``min_by``/``max_by`` in the hash
    aggregate with map-side partials. trade_id is shifted by 2^63 so any
    bigint keeps its order.
    """
    shift = F.lit("9223372036854775808").cast("decimal(38,0)")
    scale = F.lit("100000000000000000000").cast("decimal(38,0)")
    return trade_us.cast("decimal(38,0)") * scale + (trade_id.cast("decimal(38,0)") + shift)


def bar_closes(bars: DataFrame, horizon_minutes: int = 5) -> DataFrame:
    """(ticker, bucket, close_now, close_fwd) with the close ``horizon`` minutes later.

    One pass over the bars instead of two joins: each bar contributes its
    close as ``close_now`` to its own minute and as ``close_fwd`` to the
    minute ``horizon`` earlier; one aggregation per (ticker, bucket) lines
    them up. Exact-minute matches only (not as-of), like an equi-join on
    ``bucket + horizon``. Bars must be unique per (ticker, minute), which
    ``resample_prints`` guarantees.
    """
    b = bars.select("ticker", truncate("minute", event_at(F.col("ts"))).alias("bucket"), "close")
    shift = F.expr(f"INTERVAL {int(horizon_minutes)} MINUTES")
    none = F.lit(None).cast("double")
    # Two rows per bar from one scan (no union of two scans of the bars).
    both = F.array(
        F.struct(F.col("bucket").alias("bucket"), F.col("close").alias("close_now"), none.alias("close_fwd")),
        F.struct((F.col("bucket") - shift).alias("bucket"), none.alias("close_now"), F.col("close").alias("close_fwd")),
    )
    return (
        b.select("ticker", F.inline(both))
        .groupBy("ticker", "bucket")
        .agg(F.max("close_now").alias("close_now"), F.max("close_fwd").alias("close_fwd"))
    )


def forward_returns(bars: DataFrame, horizon_minutes: int = 5) -> DataFrame:
    """(ticker, bucket, close_now, close_fwd_5m, fwd_ret_5m) for every bar minute.

    ``fwd_ret_5m`` is DECIMAL(8,5), NULL unless both closes exist.
    """
    c = bar_closes(bars, horizon_minutes).filter(F.col("close_now").isNotNull())
    return c.select(
        "ticker",
        "bucket",
        "close_now",
        F.col("close_fwd").alias("close_fwd_5m"),
        forward_return(F.col("close_now"), F.col("close_fwd")).alias("fwd_ret_5m"),
    )


def forward_return(now, fwd, on_overflow: str = "raise"):
    """fwd / now - 1 as DECIMAL(8,5) when both are present.

    Overflow (|return| >= 1000) raises by default like the reference; with
    ``on_overflow="null"`` it becomes NULL instead.
    """
    ret = (F.try_divide(fwd, now) if on_overflow == "null" else fwd / now) - F.lit(1.0)
    cast = ret.try_cast("decimal(8,5)") if on_overflow == "null" else ret.cast("decimal(8,5)")
    return F.when(now.isNotNull() & fwd.isNotNull(), cast)
