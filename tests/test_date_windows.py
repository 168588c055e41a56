"""Runs over a window of dates or hours give the rows of the full run."""

from datetime import datetime, timedelta

import pytest

from helpers import events_df, ms
from tickerlake.plans import jobs
from tickerlake.sources import lake

DAY0 = datetime(2024, 3, 9, 21, 0)
PHRASES = ["is AMAZING", "suffered a crash", "filed its numbers", "was not good", "had gains, but the outlook is poor"]


def _rows(n, first=0):
    """A post every seven minutes over some days; one company is named rarely."""
    for k in range(first, first + n):
        t = "ORCL" if k % 9 else "INTC"
        yield ("desk", f"p{k}", DAY0 + timedelta(minutes=7 * k), f"${t} {PHRASES[k * k % 5]}")


@pytest.fixture(scope="module")
def three_days(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("days") / "lake")
    lake.land_events(spark, events_df(spark, list(_rows(500))), root)
    jobs.score_lake(spark, root, scored_ts=0)
    prints = [(t, ms(DAY0 + timedelta(minutes=m)) * 1000, m, 80.0 + m % 13 + len(t), 1) for m in range(3600) for t in ("ORCL", "INTC")]
    jobs.write_bars(spark, root, spark.createDataFrame(prints, "ticker string, trade_us long, trade_id long, price double, qty long"))
    return root


def _sig(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("window", [
    {"since": "2024-03-11"}, {"until": "2024-03-10"}, {"since": "2024-03-10T05", "until": "2024-03-10T05"},
    {"since": datetime(2024, 3, 10).date(), "until": datetime(2024, 3, 10).date()}, {"since": "2024-03-10", "frame": "range"},
])
@pytest.mark.parametrize("frames", [None, "2024-03-10T02"])
def test_a_window_equals_the_full_run_there(spark, three_days, window, frames):
    if frames:
        jobs.save_frames(spark, three_days, frames)
    full = jobs.signal_view(spark, three_days, frame=window.get("frame", "rows"))
    low = " ".join(lake.hour_of(window["since"])) if "since" in window else "0000"
    high = " ".join(lake.hour_of(window["until"], last=True)) if "until" in window else "9999"
    want = [r for r in full.collect() if low <= r.bucket.strftime("%Y-%m-%d %H") <= high]
    assert 0 < len(want) < 500
    assert any(r.close_fwd_5m is not None for r in want)
    assert _sig(jobs.signal_view(spark, three_days, **window)) == sorted(map(tuple, want), key=str)


def test_stored_frames_keep_the_scan_to_the_window(spark, three_days):
    jobs.save_frames(spark, three_days, "2024-03-10T02")
    jobs.save_frames(spark, three_days, "2024-03-11")  # rests on the one before
    asof, minutes = lake.read_frames(spark, three_days, "2024-03-11T07")
    assert asof == "2024-03-11T00"
    assert {r.ticker: r["count"] for r in minutes.groupBy("ticker").count().collect()} == {"ORCL": 59, "INTC": 26}
    view = jobs.signal_view(spark, three_days, since="2024-03-11")
    filters = [line for line in view._jdf.queryExecution().executedPlan().toString().splitlines() if "derived/sentiment" in line]
    assert filters and all("(dt" in f[f.index("PartitionFilters") :] for f in filters)
    asof, _ = lake.read_frames(spark, three_days, "2024-03-10T01")
    assert asof is None


def test_scoring_again_drops_the_frames_that_rest_on_it(spark, tmp_path):
    root = str(tmp_path / "lake")
    lake.land_events(spark, events_df(spark, list(_rows(60))), root)
    jobs.score_lake(spark, root, scored_ts=0)
    for hour in ("2024-03-09T23", "2024-03-10T02"):
        jobs.save_frames(spark, root, hour)
    late = [("desk", "late", DAY0 + timedelta(hours=3, seconds=5), "$ORCL is AMAZING")]  # 00:00:05
    lake.land_events(spark, events_df(spark, late), root)
    jobs.score_lake(spark, root, scored_ts=0, since="2024-03-10T00", until="2024-03-10T00")
    assert lake.read_frames(spark, root, "2024-03-11")[0] == "2024-03-09T23"
    full = [r for r in jobs.signal_view(spark, root).collect() if r.bucket >= datetime(2024, 3, 10, 2)]
    assert _sig(jobs.signal_view(spark, root, since="2024-03-10T02")) == sorted(map(tuple, full), key=str)
