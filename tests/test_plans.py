"""Plan shape: pruning reaches the scan, broadcasts are size-checked, entry runs."""

from datetime import date, datetime

from pyspark.sql import functions as F

from helpers import events_df
from tickerlake.functions.lexicon import lexicon_df
from tickerlake.plans.sizing import BROADCAST_LIMIT_BYTES, bounded_broadcast, estimated_bytes
from tickerlake.sources import lake


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_window_prunes_partitions(spark, lake_root):
    rows = [("s", "1", datetime(2023, 8, 6, 7, 0), "a"), ("s", "2", datetime(2023, 8, 9, 20, 0), "b")]
    lake.land_events(spark, events_df(spark, rows), lake_root)
    df = lake.read_events(spark, lake_root, since=date(2023, 8, 7))
    plan = _plan(df)
    assert "PartitionFilters" in plan and "dt" in plan
    assert [r.event_id for r in df.collect()] == ["2"]


def test_column_pruning_reaches_scan(spark, lake_root):
    rows = [("s", "1", datetime(2023, 8, 6, 7, 0), "a")]
    lake.land_events(spark, events_df(spark, rows), lake_root)
    df = lake.read_events(spark, lake_root).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    plan = _plan(df)
    assert "ReadSchema: struct<>" in plan or "ReadSchema: struct<event_ts" not in plan
    assert "text" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_broadcast_is_size_checked(spark):
    lex = lexicon_df(spark)
    size = estimated_bytes(lex)
    assert size is not None and size < BROADCAST_LIMIT_BYTES
    assert "broadcast" in bounded_broadcast(lex)._jdf.queryExecution().logical().toString().lower()
    big = spark.range(10**12).toDF("x")  # estimate far above the bound: no hint
    assert bounded_broadcast(big) is big


def test_entry_runs(spark):
    import __spark_entry__ as entry_mod

    df = entry_mod.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 100
    assert df.columns == [
        "ticker", "bucket", "z_mentions", "sentiment_shift", "composite", "position",
        "close_now", "close_fwd_5m", "fwd_ret_5m",
    ]
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


def test_tune_for_input(spark):
    from tickerlake.session import tune_for_input

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert tune_for_input(spark, 100 * 1024**4) == 50_000
        assert tune_for_input(spark, 10 * 1024**3) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))


def test_landing_reads_no_events_of_the_lake(spark, lake_root, monkeypatch):
    """What a landing into a filled lake reads of it is the id index."""
    hours = [("s", str(h), datetime(2023, 8, 6, h, 10), "x") for h in range(24)]
    lake.land_events(spark, events_df(spark, hours), lake_root)
    plans, real = [], lake.write_partitioned

    def spy(df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args, **kw)

    monkeypatch.setattr(lake, "write_partitioned", spy)
    again = [("s", "5", datetime(2023, 8, 6, 5, 10), "x"), ("s", "new", datetime(2023, 8, 6, 5, 10), "y")]
    assert lake.land_events(spark, events_df(spark, again), lake_root) == 1
    scans = [line for line in plans[0].splitlines() if "FileScan" in line]
    assert scans and all("ReadSchema: struct<source:string,event_id:string>" in line for line in scans)  # in the lake, source is a path
    assert "SortAggregate" not in plans[0]
    assert lake.read_events(spark, lake_root).count() == 25
