"""End-to-end: land -> score -> views -> bars -> signal -> backtest."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from helpers import events_df, ms
from tickerlake.operators import backtest, bars
from tickerlake.plans import jobs
from tickerlake.sources import lake


def _prints(spark, tickers, start: datetime, minutes: int):
    """Two prints per minute per ticker with a gentle drift."""
    rows = []
    for k, t in enumerate(tickers):
        for i in range(minutes):
            base_us = ms(start + timedelta(minutes=i)) * 1000
            p = 100.0 + k + 0.01 * i
            rows.append((t, base_us + 1_000_000, i * 2, p, 1))
            rows.append((t, base_us + 30_000_000, i * 2 + 1, p + 0.005, 2))
    return spark.createDataFrame(rows, "ticker string, trade_us long, trade_id long, price double, qty long")


def test_score_and_ticker_view(spark, lake_root):
    ts = datetime(2025, 11, 3, 9, 0)
    texts = ["$ORCL posted a very strong quarter", "INTC was not good", "$ORCL is a scam, and INTC too", "no company here"]
    jobs.land(spark, events_df(spark, [("wire", str(i), ts, x) for i, x in enumerate(texts)]), lake_root)
    assert jobs.score_lake(spark, lake_root, scored_ts=0) == 4
    assert [(r.source, r.n) for r in jobs.summarize(spark, lake_root).collect()] == [("wire", 4)]
    by_id = {r.event_id: r.compound for r in lake.read_sentiment(spark, lake_root).collect()}
    assert by_id["0"] > 0 > by_id["1"] and by_id["2"] < 0 == by_id["3"]
    view = {r.ticker: r for r in jobs.ticker_view(spark, lake_root).collect()}
    assert view["ORCL"].mentions == view["INTC"].mentions == 2
    assert abs(float(view["ORCL"].avg_compound) - (by_id["0"] + by_id["2"]) / 2) < 1e-3


def test_redelivered_ids_and_null_ids(spark, lake_root):
    import pytest

    ts = datetime(2025, 11, 3, 9, 0)
    jobs.land(spark, events_df(spark, [("wire", "1", ts, "a")]), lake_root)
    # the same id five hours later is the same event
    assert jobs.land(spark, events_df(spark, [("wire", "1", ts + timedelta(hours=5), "a"), ("wire", "2", ts, "b")]), lake_root) == 1
    assert sorted(r.event_id for r in lake.read_events(spark, lake_root).collect()) == ["1", "2"]
    with pytest.raises(Exception, match="NULL in non-null column event_id"):
        jobs.land(spark, events_df(spark, [("wire", "3", ts, "x")]).withColumn("event_id", F.lit(None).cast("string")), lake_root)


def test_empty_lake_views(spark, tmp_path):
    root = str(tmp_path / "nothing")
    assert jobs.ticker_view(spark, root).count() == 0
    assert jobs.signal_view(spark, root).count() == 0
    r = jobs.backtest_report(spark, root).first()
    assert r.n_signals == 0 and r.n_trades == 0 and r.total_pnl == 0.0
    assert jobs.score_lake(spark, root) == 0


def test_signal_end_to_end(spark, lake_root):
    """One quiet ticker with a burst: z, shift, closes and return by hand."""
    t0 = datetime(2025, 11, 3, 9, 0)
    rows = [("wire", f"q{m}", t0 + timedelta(minutes=m), "$ORCL filed its numbers") for m in (0, 1)]
    rows += [("wire", f"b{k}", t0 + timedelta(minutes=2, seconds=k), "$ORCL filed its numbers") for k in range(4)]
    jobs.land(spark, events_df(spark, rows), lake_root)
    assert jobs.score_lake(spark, lake_root, scored_ts=0) == 6
    assert jobs.write_bars(spark, lake_root, _prints(spark, ["ORCL"], t0, 6)) == 6
    sig = {r.bucket: r for r in jobs.signal_view(spark, lake_root).collect()}
    assert sorted(sig) == [t0 + timedelta(minutes=m) for m in (0, 1, 2)]
    # mentions 1, 1, 4: m5 = 6, mean 2, population sd sqrt(2): z = 2.828
    last = sig[t0 + timedelta(minutes=2)]
    assert str(last.z_mentions) == "2.828" and str(last.sentiment_shift) == "0.000" and last.position == "flat"
    first = sig[t0]
    assert str(first.z_mentions) == "0.000"
    assert first.close_now == 100.005 and abs(first.close_fwd_5m - 100.055) < 1e-9
    assert str(first.fwd_ret_5m) == "0.00050"
    assert last.close_fwd_5m is None and last.fwd_ret_5m is None


def test_backtest_end_to_end(spark):
    """Four signals, two trades: profit, spread and hit rate by hand."""
    t0 = datetime(2025, 11, 3, 9, 0)
    rows = [("ORCL", t0, "long", 0.02), ("ORCL", t0 + timedelta(minutes=1), "flat", 0.5), ("AMD", t0, "short", 0.01), ("AMD", t0 + timedelta(minutes=1), "long", None)]
    sig = spark.createDataFrame(rows, "ticker string, bucket timestamp_ntz, position string, r double")
    sig = sig.select("ticker", "bucket", "position", F.col("r").cast("decimal(8,5)").alias("fwd_ret_5m"))
    r = backtest.summary(sig).first()
    assert r.n_signals == 3 and r.n_trades == 2  # one has no return yet
    assert abs(r.total_pnl - 0.01) < 1e-12 and abs(r.std_pnl - 0.015) < 1e-12 and r.hit_rate == 0.5


def test_bars_shape(spark):
    start = datetime(2026, 5, 2, 13, 30)
    b = bars.resample_prints(_prints(spark, ["AAPL", "MSFT"], start, 10))
    rows = b.collect()
    assert len(rows) == 20
    assert b.columns == ["ticker", "ts", "open", "high", "low", "close", "volume"]
    for r in rows:
        assert r.low <= min(r.open, r.close) <= max(r.open, r.close) <= r.high and r.volume == 3
    assert bars.resample_prints(_prints(spark, [], start, 10)).count() == 0


def test_market_rewrite_is_idempotent(spark, lake_root):
    start = datetime(2026, 5, 2, 13, 30)
    p = _prints(spark, ["AAPL"], start, 10)
    jobs.write_bars(spark, lake_root, p)
    jobs.write_bars(spark, lake_root, p)
    assert lake.read_market(spark, lake_root).count() == 10


def test_drawdown_matches_running_max(spark):
    """Two-level drawdown equals a plain cumulative max over random series."""
    import random

    rng = random.Random(7)
    rows = []
    base = datetime(2026, 1, 1)
    for i in range(500):
        rows.append(("AAA", base + timedelta(minutes=7 * i), rng.choice(["long", "short", "flat"]), rng.uniform(-0.02, 0.02)))
    df = spark.createDataFrame(rows, "ticker string, bucket timestamp_ntz, position string, r double").select(
        "ticker", "bucket", "position", F.col("r").cast("decimal(8,5)").alias("fwd_ret_5m")
    )
    got = {r.bucket: r.drawdown for r in backtest.equity_curve(df).filter("is_trade").collect()}
    cum, peak, expect = 0.0, None, {}
    for t, b, pos, ret in sorted(rows, key=lambda x: x[1]):
        s = {"long": 1, "short": -1}.get(pos, 0)
        if s == 0:
            continue
        cum += s * float(round(ret, 5))
        peak = cum if peak is None else max(peak, cum)
        expect[b] = cum - peak
    assert set(got) == set(expect)
    for b, v in expect.items():
        assert abs(got[b] - v) < 1e-9


def test_market_merge_keeps_other_tickers(spark, lake_root):
    start = datetime(2026, 5, 2, 13, 30)
    jobs.write_bars(spark, lake_root, _prints(spark, ["AAPL"], start, 10))
    # plain rewrite of the same hours drops AAPL (partition replaced)
    jobs.write_bars(spark, lake_root, _prints(spark, ["MSFT"], start, 10))
    assert {r.ticker for r in lake.read_market(spark, lake_root).collect()} == {"MSFT"}
    # merge keeps MSFT and adds AAPL; re-merging changes nothing
    jobs.write_bars(spark, lake_root, _prints(spark, ["AAPL"], start, 10), merge=True)
    jobs.write_bars(spark, lake_root, _prints(spark, ["AAPL"], start, 10), merge=True)
    m = lake.read_market(spark, lake_root)
    assert {r.ticker for r in m.collect()} == {"AAPL", "MSFT"} and m.count() == 20


def test_empty_ticker_selection_is_a_noop(spark, lake_root):
    from tickerlake.operators.features import universe

    start = datetime(2026, 5, 2, 13, 30)
    none = universe(spark.createDataFrame([(" , ",)], "symbols string"))
    assert jobs.write_bars(spark, lake_root, _prints(spark, ["AAPL"], start, 10), tickers=none) == 0
    assert lake.read_market(spark, lake_root).count() == 0
