"""Backtest pieces: merging is associative and equals plain Python over the whole curve."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickerlake.operators import backtest

START = datetime(2022, 2, 27, 22, 0)


def signal(spark, n, seed=4):
    """Signals at odd times over some days, months apart at the end; some flat, some without a return."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        at = START + timedelta(minutes=11 * k) + (timedelta(days=400) if k > n * 0.9 else timedelta())
        position = rng.choice(["long", "short", "flat"])
        rows.append((rng.choice(["AMD", "ORCL"]) + str(k % 2), at, position, rng.choice([None, round(rng.uniform(-0.02, 0.02), 5)])))
    df = spark.createDataFrame(rows, "ticker string, bucket timestamp_ntz, position string, ret double")
    return rows, df.select("ticker", "bucket", "position", F.col("ret").cast("decimal(8,5)").alias("fwd_ret_5m"))


def brute(rows):
    done = [(b, t, {"long": 1, "short": -1}.get(p, 0), r) for t, b, p, r in rows if r is not None]
    pnl = [p * r for _, _, p, r in sorted(done) if p]
    cum, peak, fall = 0.0, -math.inf, 0.0
    for x in pnl:
        cum += x
        peak = max(peak, cum)
        fall = min(fall, cum - peak)
    mean = sum(pnl) / len(pnl) if pnl else 0.0
    std = math.sqrt(sum((x - mean) ** 2 for x in pnl) / len(pnl)) if pnl else 0.0
    sharpe = mean / std * math.sqrt(backtest.PERIODS_PER_YEAR_5M) if std > 0 else 0.0
    return [len(done), len(pnl), sum(pnl), mean, std, sharpe, fall, sum(x > 0 for x in pnl) / len(pnl) if pnl else 0.0]


def close(a, b):
    return all(abs(x - y) < 1e-9 * max(1.0, abs(y)) for x, y in zip(a, b, strict=True))


def test_summary_equals_the_whole_curve(spark):
    for n in (400, 1, 0):
        rows, df = signal(spark, n)
        assert close(list(backtest.summary(df).first()), brute(rows))


def test_any_split_merges_to_the_same(spark):
    rows, df = signal(spark, 300)
    want = brute(rows)
    for unit in ("minute", "hour", "day"):
        assert close(list(backtest.figures(backtest.merged(backtest.pieces(df, unit))).first()), want)
    cut = START + timedelta(hours=30)
    early, late = (backtest.merged(backtest.pieces(df.where(c))).withColumn("at", F.lit(at)) for c, at in ((F.col("bucket") < cut, START), (F.col("bucket") >= cut, cut)))
    assert close(list(backtest.figures(backtest.merged(early.unionByName(late))).first()), want)


def test_fees_and_slippage_by_hand(spark):
    rows = [("AMD", START + timedelta(minutes=5 * k), p, 0.01) for k, p in enumerate(["long", "long", "short", "flat"])]
    df = spark.createDataFrame(rows, "ticker string, bucket timestamp_ntz, position string, fwd_ret_5m double")
    got = {r.bucket: r for r in backtest.with_costs(df, cost_bps=2.0, slippage_bps=3.0).collect()}
    told = [(got[b].turnover, round(got[b].net_pnl, 12)) for _, b, _, _ in rows]
    assert told == [(1, round(0.01 - 0.0005, 12)), (0, 0.01), (2, round(-0.01 - 0.001, 12)), (1, -0.0005)]
