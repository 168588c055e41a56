"""Semantics that decide correctness (rows frames, limits, overflow, grains)."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickerlake.functions.timecols import bucket
from tickerlake.operators import bars, signal


def _pm(spark, rows):
    return spark.createDataFrame(rows, "ticker string, bucket timestamp_ntz, mentions long, avg_sentiment double")


def test_rows_frame_counts_active_minutes(spark):
    """Frames are active-minute rows: a 10-minute gap does not empty the 5-row frame."""
    t0 = datetime(2026, 1, 1, 10, 0)
    rows = [("A", t0 + timedelta(minutes=m), 1, 0.1) for m in (0, 1, 2, 20, 21)]
    r = {x.bucket: x for x in signal.rolling(_pm(spark, rows)).collect()}
    assert r[t0 + timedelta(minutes=21)].m5 == 5  # rows frame
    rr = {x.bucket: x for x in signal.rolling(_pm(spark, rows), frame="range").collect()}
    assert rr[t0 + timedelta(minutes=21)].m5 == 2  # clock frame


def test_single_row_gives_zero_z(spark):
    t0 = datetime(2026, 1, 1, 10, 0)
    s = signal.score(signal.rolling(_pm(spark, [("A", t0, 3, 0.5)]))).first()
    assert float(s.z_mentions) == 0.0 and s.position == "flat"


def test_position_uses_unrounded_product(spark):
    rolled = spark.createDataFrame(
        [("A", datetime(2026, 1, 1), 6, 0.0, 1.0, 1.0, -1.0002)],
        "ticker string, bucket timestamp_ntz, m5 long, s5 double, m60_mean double, m60_sd double, s60 double",
    )
    # z = 5, shift = 1.0002 -> composite 5.001 -> long
    s = signal.score(rolled).first()
    assert s.position == "long"


def test_overflow_raises_or_nulls(spark):
    rolled = spark.createDataFrame(
        [("A", datetime(2026, 1, 1), 200001, 0.0, 1.0, 1.0, -1.0)],
        "ticker string, bucket timestamp_ntz, m5 long, s5 double, m60_mean double, m60_sd double, s60 double",
    )
    with pytest.raises(Exception):
        signal.score(rolled).collect()
    assert signal.score(rolled, on_overflow="null").first().z_mentions is None


def test_forward_return_needs_exact_minute(spark):
    t0 = datetime(2026, 1, 1, 10, 0)
    ms = int(t0.timestamp() * 1000) - int(datetime(1970, 1, 1).timestamp() * 1000)
    b = spark.createDataFrame(
        [("A", ms, 1.0, 1.0, 1.0, 100.0, 1), ("A", ms + 6 * 60000, 1.0, 1.0, 1.0, 110.0, 1)],
        "ticker string, ts long, open double, high double, low double, close double, volume long",
    )
    r = {x.bucket: x for x in bars.forward_returns(b).collect()}
    assert r[t0].fwd_ret_5m is None  # bar at +6 min is not +5 min


def test_limit_before_backtest(spark):
    from tickerlake.plans.queries import full_signal

    top = full_signal(spark, "/root/testdata/sf0.001", limit=100)
    assert top.count() == 100
    assert full_signal(spark, "/root/testdata/sf0.001", limit=None).count() > 100


def test_grain_validation(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1, 10, 7),)], "t timestamp_ntz")
    assert df.select(bucket("5 minutes", F.col("t")).alias("b")).first().b == datetime(2026, 1, 1, 10, 5)
    with pytest.raises(ValueError):
        bucket("5minute", F.col("t"))
