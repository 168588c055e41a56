"""Backtest of a signal table: trades, equity curve, drawdown, summary.

Position long -> +1, short -> -1, anything else -> 0; pnl = position x
fwd_ret_5m (as double). Rows without a forward return are dropped first.

The equity curve is a running sum in global (bucket, ticker) order, and the
drawdown is the running sum minus its running peak, where the peak starts
at the first trade (not at 0). A window without a partition would move all
trades into one task, so the scan runs in two levels: running sums inside
hourly chunks (bounded by 60 minutes x tickers), then running offsets and
peaks over the per-chunk summaries (one row per hour), broadcast back.

The summary needs no curve: ``pieces`` describes each hour by figures that
merge (counts, sum, mean and squared deviations, highest and lowest running
sum, worst fall), and ``merged`` folds them in order, hours to days, days to
years. Merging is associative, so the pieces of a day can
be stored and a new day adds its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerlake.plans.sizing import bounded_broadcast
from tickerlake.plans.windows import BLK, CTX, DEFAULT_BLOCK_ROWS, IDX, blocked_rows, finish

# 5-minute holdings over a 6.5 h x 252 day trading year.
PERIODS_PER_YEAR_5M = 252 * 6.5 * 12


def with_pnl(signal: DataFrame) -> DataFrame:
    """Signal rows that have a forward return, with ``pos`` and ``pnl``."""
    pos = F.when(F.col("position") == "long", 1).when(F.col("position") == "short", -1).otherwise(0)
    return (
        signal.filter(F.col("fwd_ret_5m").isNotNull())
        .withColumn("pos", pos)
        .withColumn("pnl", F.col("pos") * F.col("fwd_ret_5m").cast("double"))
    )


def trades(signal: DataFrame) -> DataFrame:
    """Non-flat rows with a forward return: (ticker, bucket, position, pos, fwd_ret_5m, pnl)."""
    return with_pnl(signal).filter(F.col("pos") != 0).select("ticker", "bucket", "position", "pos", "fwd_ret_5m", "pnl")


def equity_curve(signal: DataFrame, chunk_unit: str = "hour") -> DataFrame:
    """Every signal row with a forward return, plus the running equity.

    Columns: ticker, bucket, pos, pnl (NULL on flat rows), is_trade, cum_pnl,
    peak, drawdown (the last three NULL on flat rows). Order (bucket, ticker).
    """
    rows = with_pnl(signal).select("ticker", "bucket", "pos", "pnl", F.date_trunc(chunk_unit, F.col("bucket")).alias("_chunk"))
    rows = rows.filter(F.col("_chunk").isNotNull())  # said for both uses; the join below says it for one only
    is_trade = F.col("pos") != 0
    won = F.when(is_trade, F.col("pnl"))
    upto = Window.partitionBy("_chunk").orderBy("bucket", "ticker").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_p", F.sum(won).over(upto))
    # Both uses of ``local`` read the same columns, so the signal and its
    # shuffle by chunk are evaluated once (the second is a reused exchange).
    chunks = local.groupBy("_chunk").agg(
        F.coalesce(F.sum(won), F.lit(0.0)).alias("_s"),
        F.max(F.when(is_trade, F.col("_p"))).alias("_m"),
    )
    local = local.withColumn("_lmax", F.max(F.when(is_trade, F.col("_p"))).over(upto))
    # One row per chunk (hour); ordered scan over a small table.
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_off", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)))
    chunks = chunks.withColumn("_prev_peak", F.max(F.col("_off") + F.col("_m")).over(earlier))

    j = local.join(bounded_broadcast(chunks.select("_chunk", "_off", "_prev_peak")), "_chunk")
    cum = F.col("_off") + F.col("_p")
    peak = F.greatest(F.col("_prev_peak"), F.col("_off") + F.col("_lmax"))
    return j.select(
        "ticker",
        "bucket",
        "pos",
        won.alias("pnl"),
        is_trade.alias("is_trade"),
        F.when(is_trade, cum).alias("cum_pnl"),
        F.when(is_trade, peak).alias("peak"),
        F.when(is_trade, cum - peak).alias("drawdown"),
    )


PIECE = ("n_signals", "n_trades", "wins", "s", "mean", "m2", "high", "low", "fall")


def pieces(signal: DataFrame, unit: str = "hour") -> DataFrame:
    """(at, n_signals, n_trades, wins, s, mean, m2, high, low, fall) per ``unit`` of time.

    s is the sum of pnl, m2 the sum of squared deviations from the mean; high
    and low are the extremes of the running sum after a trade, fall the worst
    distance from its peak (NULL without trades).
    """
    rows = with_pnl(signal).select(F.date_trunc(unit, "bucket").cast("timestamp_ntz").alias("at"), "bucket", "ticker", "pos", "pnl")
    is_trade = F.col("pos") != 0
    won = F.when(is_trade, F.col("pnl"))
    upto = Window.partitionBy("at").orderBy("bucket", "ticker").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_p", F.when(is_trade, F.sum(won).over(upto)))
    run = run.withColumn("_peak", F.max("_p").over(upto))
    n = F.count(won)
    return run.groupBy("at").agg(
        F.count(F.lit(1)).alias("n_signals"),
        n.alias("n_trades"),
        F.count(F.when(won > 0, True)).alias("wins"),
        F.coalesce(F.sum(won), F.lit(0.0)).alias("s"),
        F.coalesce(F.avg(won), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(won) * n, F.lit(0.0)).alias("m2"),
        F.max("_p").alias("high"),
        F.min("_p").alias("low"),
        F.min(F.when(is_trade, F.col("_p") - F.col("_peak"))).alias("fall"),
    )


def _merge(a: Column, b: Column) -> Column:
    """The piece of ``a`` followed by ``b``."""
    n = a["n_trades"] + b["n_trades"]
    apart = b["mean"] - a["mean"]
    return F.struct(
        (a["n_signals"] + b["n_signals"]).alias("n_signals"),
        n.alias("n_trades"),
        (a["wins"] + b["wins"]).alias("wins"),
        (a["s"] + b["s"]).alias("s"),
        F.when(n > 0, (a["mean"] * a["n_trades"] + b["mean"] * b["n_trades"]) / n).otherwise(0.0).alias("mean"),
        F.when(n > 0, a["m2"] + b["m2"] + apart * apart * a["n_trades"] * b["n_trades"] / n).otherwise(0.0).alias("m2"),
        F.greatest(a["high"], a["s"] + b["high"]).alias("high"),
        F.least(a["low"], a["s"] + b["low"]).alias("low"),
        F.least(a["fall"], b["fall"], a["s"] - a["high"] + b["low"]).alias("fall"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """All pieces as one row, folded in time order level by level; no group holds more than a level's rows."""
    nothing = F.struct(
        *[F.lit(0).cast("long").alias(c) for c in PIECE[:3]], *[F.lit(0.0).alias(c) for c in PIECE[3:6]],
        *[F.lit(None).cast("double").alias(c) for c in PIECE[6:]],
    )
    for unit in ("day", "year", None):
        keys = [F.date_trunc(unit, "at").cast("timestamp_ntz").alias("at")] if unit else []
        ordered = F.array_sort(F.collect_list(F.struct("at", F.struct(*PIECE).alias("piece"))))
        folded = parts.groupBy(*keys).agg(F.aggregate(ordered, nothing, lambda acc, x: _merge(acc, x["piece"])).alias("piece"))
        parts = folded.select(*(["at"] if unit else []), "piece.*")
    return parts


def figures(total: DataFrame) -> DataFrame:
    """The summary row of one merged piece; zeros when there are no trades."""
    has = F.col("n_trades") > 0
    mean = F.when(has, F.col("mean")).otherwise(0.0)
    std = F.when(has, F.sqrt(F.col("m2") / F.col("n_trades"))).otherwise(0.0)
    return total.select(
        "n_signals",
        "n_trades",
        F.when(has, F.col("s")).otherwise(0.0).alias("total_pnl"),
        mean.alias("mean_pnl"),
        std.alias("std_pnl"),
        F.when(std > 0, mean / std * F.lit(math.sqrt(PERIODS_PER_YEAR_5M))).otherwise(0.0).alias("sharpe_annual"),
        F.when(has, F.col("fall")).otherwise(0.0).alias("max_drawdown"),
        F.when(has, F.col("wins") / F.col("n_trades")).otherwise(0.0).alias("hit_rate"),
    )


def summary(signal: DataFrame) -> DataFrame:
    """One row: n_signals, n_trades, total_pnl, mean_pnl, std_pnl, sharpe_annual,
    max_drawdown, hit_rate. Zeros when there are no trades."""
    return figures(merged(pieces(signal)))


def with_costs(
    signal: DataFrame, cost_bps: float = 1.0, slippage_bps: float = 0.0, block_rows: int = DEFAULT_BLOCK_ROWS
) -> DataFrame:
    """Per-row pnl net of fees and slippage (both in basis points) per unit of position change.

    Turnover is |pos - previous pos| within a ticker in bucket order (the
    first row trades from flat). The previous row comes from a blocked
    window (see ``plans.windows``), so no ticker's history sits in one task.
    """
    p = with_pnl(signal).select("ticker", "bucket", "pos", "pnl")
    spread, w = blocked_rows(p, "ticker", "bucket", lookback=1, block_rows=block_rows)
    turnover = F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0)))
    out = spread.select(
        "ticker",
        "bucket",
        "pos",
        "pnl",
        turnover.alias("turnover"),
        (F.col("pnl") - turnover * F.lit((cost_bps + slippage_bps) / 10_000.0)).alias("net_pnl"),
        CTX,
        BLK,
        IDX,
    )
    return finish(out)
