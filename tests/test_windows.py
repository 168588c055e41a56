"""Blocked row windows equal plain per-key windows."""

from pyspark.sql import functions as F

from tickerlake.operators import backtest, signal
from tickerlake.plans.queries import feed_bars, scored_feed

SF = "/root/testdata/sf0.01"


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rolling_blocks_match_unblocked(spark):
    pm = signal.per_minute(scored_feed(spark, SF))
    cols = ["ticker", "bucket", "m5", "s5", "m60_mean", "m60_sd", "s60"]
    plain = signal.rolling(pm, block_rows=10**9).select(*cols)
    rnd = [F.round(c, 9).alias(c) if c in ("s5", "m60_mean", "m60_sd", "s60") else F.col(c) for c in cols]
    blocked = signal.rolling(pm, block_rows=64).select(*rnd)
    assert _rows(blocked, cols) == _rows(plain.select(*rnd), cols)


def test_costs_blocks_match(spark):
    sig = signal.build_signal(scored_feed(spark, SF), feed_bars(spark, SF), limit=None)
    cols = ["ticker", "bucket", "pos", "turnover"]
    a = _rows(backtest.with_costs(sig, block_rows=8), cols)
    b = _rows(backtest.with_costs(sig, block_rows=100000), cols)
    assert a == b and len(a) > 0


def test_range_blocks_match_unblocked(spark):
    from pyspark.sql import Window

    pm = signal.per_minute(scored_feed(spark, SF)).withColumn("_m", F.expr("unix_seconds(CAST(bucket AS TIMESTAMP)) div 60"))
    w = Window.partitionBy("ticker").orderBy("_m").rangeBetween(-59, 0)
    plain = pm.select("ticker", "bucket", F.avg("mentions").over(w).alias("m60_mean"))
    got = signal.rolling(pm.drop("_m"), frame="range").select("ticker", "bucket", "m60_mean")
    cols = ["ticker", "bucket", "m60_mean"]
    assert _rows(got, cols) == _rows(plain, cols)
