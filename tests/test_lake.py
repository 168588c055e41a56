"""Lake contract: paths by event time, typed read-back, idempotent landing."""

import glob
import os
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest

from helpers import events_df
from tickerlake.operators import ops
from tickerlake.schemas import EVENT_SCHEMA
from tickerlake.sources import ids, lake, snapshot


WINTER = datetime(2023, 12, 31, 23, 59, 58)


def wire(spark, n, start=WINTER, gap_s=1, source="wire", first=0):
    """``n`` messages, ``gap_s`` apart, newest first, so that nothing arrives in time order."""
    rows = [(source, f"m{first + k}", start + timedelta(seconds=k * gap_s), f"message {k} of the wire", "desk") for k in reversed(range(n))]
    return events_df(spark, rows)


def parts(root):
    return sorted(os.path.relpath(f, root) for f in glob.glob(os.path.join(root, "source=*", "dt=*", "hr=*", "*.parquet")))


def test_messages_land_under_their_own_hour(spark, lake_root):
    """Four seconds around New Year are two days, two hours and a typed read-back."""
    assert lake.land_events(spark, wire(spark, 4), lake_root) == 4
    folders = {os.path.dirname(p) for p in parts(lake_root)}
    assert folders == {"source=wire/dt=2023-12-31/hr=23", "source=wire/dt=2024-01-01/hr=00"}
    back = lake.read_events(spark, lake_root)
    kinds = dict(back.dtypes)
    assert (kinds["dt"], kinds["hr"], kinds["event_at"]) == ("date", "string", "timestamp_ntz")
    got = {(r.event_id, str(r.dt), r.hr, r.author) for r in back.collect()}
    assert got == {("m0", "2023-12-31", "23", "desk"), ("m1", "2023-12-31", "23", "desk"), ("m2", "2024-01-01", "00", "desk"), ("m3", "2024-01-01", "00", "desk")}
    assert set(EVENT_SCHEMA.names) <= set(back.columns)


def test_files_are_zstd_and_in_time_order(spark, lake_root):
    lake.land_events(spark, wire(spark, 500, gap_s=7), lake_root)
    ops.compact(spark, lake_root)
    files = parts(lake_root)
    assert files
    for f in files:
        meta = pq.ParquetFile(os.path.join(lake_root, f))
        codecs = {meta.metadata.row_group(g).column(c).compression for g in range(meta.metadata.num_row_groups) for c in range(meta.metadata.num_columns)}
        assert codecs == {"ZSTD"}
        at = meta.read(["event_ts"])["event_ts"].to_pylist()
        assert at == sorted(at)


def test_a_second_delivery_adds_only_what_is_new(spark, lake_root):
    assert lake.land_events(spark, wire(spark, 30), lake_root) == 30
    before = parts(lake_root)
    assert lake.land_events(spark, wire(spark, 30), lake_root) == 0
    assert parts(lake_root) == before
    assert lake.land_events(spark, wire(spark, 45), lake_root) == 15
    assert lake.read_events(spark, lake_root).select("event_id").distinct().count() == 45


def test_duplicates_within_batch(spark, lake_root):
    ts = WINTER
    rows = [("test", "1", ts, "a"), ("test", "1", ts, "a"), ("test", "2", ts, "b")]
    assert lake.land_events(spark, events_df(spark, rows), lake_root) == 2


def test_new_batch_after_restart_keeps_old_rows(spark, lake_root):
    ts = WINTER
    lake.land_events(spark, events_df(spark, [("test", "1", ts, "a")]), lake_root)
    lake.land_events(spark, events_df(spark, [("test", "2", ts, "b")]), lake_root)
    assert lake.read_events(spark, lake_root).count() == 2


def test_path_source_wins(spark, lake_root):
    ts = WINTER
    lake.land_events(spark, events_df(spark, [("t", "1", ts, "a")]), lake_root)
    assert [r.source for r in lake.read_events(spark, lake_root).collect()] == ["t"]


def test_empty_lake_gives_typed_empty_tables(spark, tmp_path):
    root = str(tmp_path / "missing")
    ev = lake.read_events(spark, root)
    se = lake.read_sentiment(spark, root)
    mk = lake.read_market(spark, root)
    assert ev.count() == se.count() == mk.count() == 0
    assert "event_at" in ev.columns and "tickers" in se.columns and "close" in mk.columns


def test_schema_drift_fails_loudly(spark, lake_root):
    from tickerlake.schemas import SchemaDrift

    bad = spark.createDataFrame([("s", 1, 2)], "source string, event_id long, event_ts long")
    with pytest.raises(SchemaDrift):
        lake.land_events(spark, bad, lake_root)


def test_max_records_per_file(spark, lake_root):
    ts = WINTER
    df = events_df(spark, [("test", str(i), ts, f"e{i}") for i in range(10)])
    lake.land_events(spark, df, lake_root, max_records_per_file=3)
    files = glob.glob(os.path.join(lake_root, "source=test", "dt=2023-12-31", "hr=23", "*.parquet"))
    assert len(files) >= 4
    assert lake.read_events(spark, lake_root).count() == 10


def test_incremental_scoring_touches_only_its_window(spark, lake_root):
    from datetime import date

    from tickerlake.plans import jobs

    rows = [("s", "1", datetime(2023, 12, 30, 4, 0), "love $ORCL"), ("s", "2", datetime(2024, 1, 2, 9, 0), "bad $INTC")]
    lake.land_events(spark, events_df(spark, rows), lake_root)
    assert jobs.score_lake(spark, lake_root, scored_ts=1, since=date(2024, 1, 1)) == 1
    assert [r.event_id for r in lake.read_sentiment(spark, lake_root).collect()] == ["2"]
    assert jobs.score_lake(spark, lake_root, scored_ts=2, until=date(2023, 12, 31)) == 1
    got = {r.event_id: r.scored_ts for r in lake.read_sentiment(spark, lake_root).collect()}
    assert got == {"1": 2, "2": 1}


def test_failed_landing_leaves_no_partial_files(spark, lake_root):
    """A job that dies mid-write commits nothing; re-running it lands the batch once."""
    from pyspark.sql import functions as F

    ts = WINTER
    good = events_df(spark, [("test", str(i), ts, f"e{i}") for i in range(50)])
    lake.land_events(spark, good.limit(10), lake_root)
    # one row raises inside the tasks after others were already processed
    bad = good.withColumn(
        "text", F.when(F.col("event_id") == "42", F.raise_error(F.lit("boom"))).otherwise(F.col("text"))
    )
    with pytest.raises(Exception):
        lake.land_events(spark, bad, lake_root)
    assert lake.read_events(spark, lake_root).count() == 10
    assert lake.land_events(spark, good, lake_root) == 40
    assert lake.read_events(spark, lake_root).count() == 50


def test_storage_report(spark, lake_root):
    from pathlib import Path

    from tickerlake.operators.ops import file_counts, storage_report
    from tickerlake.sources import fixtures

    feed = fixtures.landing_feed(spark, "/root/testdata/sf0.001")
    lake.land_events(spark, feed, lake_root)
    ev = lake.read_events(spark, lake_root)
    assert storage_report(lake.event_files(spark, lake_root + "-none"), ev.limit(0)).first().bytes == 0
    files = lake.event_files(spark, lake_root)
    r = storage_report(files, ev).first()
    on_disk = [p for p in Path(lake_root).glob("source=*/**/*.parquet")]
    assert r.files == len(on_disk) and r.bytes == sum(p.stat().st_size for p in on_disk)
    parts = file_counts(ev).collect()
    assert r.rows == feed.count() == sum(p.rows for p in parts)
    assert r.files == sum(p.files for p in parts) >= len(parts) > 0
    assert r.bytes > 0 and r.bytes_per_row > 0 and r.usd_per_month > 0


# --- rewrites -----------------------------------------------------------------


def landed_ids(spark, root):
    got = [r.event_id for r in lake.read_events(spark, root).select("event_id").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_compaction_keeps_what_lands_meanwhile(spark, lake_root):
    for k in range(3):
        lake.land_events(spark, wire(spark, 20, first=20 * k), lake_root)
    many = len(parts(lake_root))
    late = lambda: lake.land_events(spark, wire(spark, 20, first=60), lake_root)
    assert ops.compact(spark, lake_root, before_commit=late) == 60
    assert landed_ids(spark, lake_root) == {f"m{k}" for k in range(80)}
    ops.compact(spark, lake_root)
    assert landed_ids(spark, lake_root) == {f"m{k}" for k in range(80)} and len(parts(lake_root)) == 2 < many


def test_a_compaction_that_fails_before_its_commit_changes_nothing(spark, lake_root):
    lake.land_events(spark, wire(spark, 20), lake_root)
    before = parts(lake_root)

    def fail():
        raise OSError("no space")

    with pytest.raises(OSError, match="no space"):
        ops.compact(spark, lake_root, before_commit=fail)
    assert parts(lake_root) == before and not glob.glob(os.path.join(lake_root, "_rewrites", "*"))
    assert len(landed_ids(spark, lake_root)) == 20


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_a_compaction_that_dies_after_its_commit_is_read_and_completed(spark, lake_root, moved):
    for k in range(2):
        lake.land_events(spark, wire(spark, 20, first=20 * k), lake_root)
    assert lake.compact_events(spark, lake_root, apply_now=False) == 40
    assert len(landed_ids(spark, lake_root)) == 40
    folder = snapshot.Folder(spark, lake_root)
    (m,) = snapshot._pending(folder, snapshot._log(folder))
    for name in m.outputs[:moved]:  # it had moved some files already
        folder.move(f"{m.staged}/{name}", name)
    assert len(landed_ids(spark, lake_root)) == 40
    lake.land_events(spark, wire(spark, 5, first=100), lake_root)
    assert snapshot.recover(spark, lake_root) == 1 and snapshot.recover(spark, lake_root) == 0
    assert len(landed_ids(spark, lake_root)) == 45
    assert set(m.outputs) <= set(parts(lake_root)) and not set(m.inputs) & set(parts(lake_root))


def test_two_compactions_of_the_same_files_cannot_both_commit(spark, lake_root):
    lake.land_events(spark, wire(spark, 20), lake_root)
    other = lambda: lake.compact_events(spark, lake_root)
    with pytest.raises(snapshot.RewriteConflict):
        lake.compact_events(spark, lake_root, before_commit=other)
    waiting = lambda: lake.compact_events(spark, lake_root, apply_now=False)
    with pytest.raises(snapshot.RewriteConflict):
        lake.compact_events(spark, lake_root, before_commit=waiting)
    assert len(landed_ids(spark, lake_root)) == 20


def test_only_the_dates_asked_for_are_rewritten(spark, lake_root):
    lake.land_events(spark, wire(spark, 4), lake_root)
    before = set(parts(lake_root))
    assert ops.compact(spark, lake_root, since="2024-01-01") == 2
    assert {p for p in before if "2023" in p} <= set(parts(lake_root))
    assert ops.compact(spark, lake_root, since="2031-01-01") == 0 and len(landed_ids(spark, lake_root)) == 4


def bars_df(spark, rows):
    schema = "ticker string, ts long, open double, high double, low double, close double, volume long"
    return spark.createDataFrame([(t, 60_000 * m, c, c, c, c, 1) for t, m, c in rows], schema)


def test_bar_merges_see_each_other(spark, lake_root, monkeypatch):
    lake.merge_market(spark, bars_df(spark, [("ORCL", 1, 1.0), ("ORCL", 70, 1.0)]), lake_root)
    real, raced = snapshot.rewrite, []

    def rewrite(*args, **kw):
        if not raced:  # another merge commits first
            raced.append(True)
            lake.merge_market(spark, bars_df(spark, [("INTC", 2, 5.0), ("ORCL", 2, 6.0)]), lake_root)
        return real(*args, **kw)

    monkeypatch.setattr(snapshot, "rewrite", rewrite)
    lake.merge_market(spark, bars_df(spark, [("ORCL", 1, 2.0), ("ORCL", 2, 3.0)]), lake_root)
    got = {(r.ticker, r.ts // 60_000): r.close for r in lake.read_market(spark, lake_root).collect()}
    assert got == {("ORCL", 1): 2.0, ("ORCL", 2): 3.0, ("INTC", 2): 5.0, ("ORCL", 70): 1.0}
    assert lake.read_market(spark, lake_root).count() == 4


# --- id index -----------------------------------------------------------------


def test_a_batch_of_one_id_reads_one_bucket_at_most(spark, lake_root):
    for k in range(3):
        lake.land_events(spark, wire(spark, 3000, first=3000 * k), lake_root)
    ids.rebuild(spark, lake_root, lake.read_events(spark, lake_root), buckets=64)
    assert len(glob.glob(os.path.join(lake_root, "_ids", "ids", "bucket=*"))) == 64 == ids.buckets_in(spark, lake_root)
    old, new = wire(spark, 1, first=4321), wire(spark, 1, first=99_999)
    for batch, most in ((old, 1), (new, 1)):
        buckets = ids.opened(spark, lake_root, batch)
        assert len(buckets) <= most
        if buckets:
            plan = ids.known(spark, lake_root, buckets)._jdf.queryExecution().executedPlan().toString()
            assert f"= {buckets[0]})" in plan[plan.index("PartitionFilters") :]
    assert ids.opened(spark, lake_root, old) and lake.land_events(spark, old, lake_root) == 0
    assert lake.land_events(spark, new, lake_root) == 1


def test_the_index_is_compacted_and_still_knows_all(spark, lake_root):
    for k in range(4):
        lake.land_events(spark, wire(spark, 200, first=200 * k), lake_root)
        if k < 3:
            assert ids.flush(spark, lake_root, always=True) and not ids.flush(spark, lake_root)
    files = lambda at: len(glob.glob(os.path.join(lake_root, "_ids", at, "*.parquet")))
    assert files("recent") == 1
    before = files("ids/bucket=*")
    ops.compact(spark, lake_root)
    assert files("ids/bucket=*") == len(glob.glob(os.path.join(lake_root, "_ids", "ids", "bucket=*"))) < before
    assert files("recent") == 0
    assert lake.land_events(spark, wire(spark, 800), lake_root) == 0


def test_a_landing_that_died_before_its_ids_were_added(spark, lake_root, monkeypatch):
    """Events are there, their ids are not: the next landing builds the index anew."""
    lake.land_events(spark, wire(spark, 50), lake_root)

    def die(*args):
        raise OSError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(ids, "add", die)
        with pytest.raises(OSError):
            lake.land_events(spark, wire(spark, 80), lake_root)
    assert len(landed_ids(spark, lake_root)) == 80 and not ids.is_sound(spark, lake_root)
    assert lake.land_events(spark, wire(spark, 90), lake_root) == 10
    assert ids.is_sound(spark, lake_root) and len(landed_ids(spark, lake_root)) == 90


def test_landing_sorts_no_texts_to_aggregate_them(spark):
    plan = lake.first_deliveries(wire(spark, 3))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Window" in plan


# --- contract versions, scope of bars -----------------------------------------


def test_a_later_contract_version_adds_nullable_columns(spark, lake_root):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from tickerlake.schemas import SchemaDrift, later_version

    second = later_version(EVENT_SCHEMA, T.StructField("lang", T.StringType(), True))
    lake.land_events(spark, wire(spark, 3), lake_root)
    lake.land_events(spark, wire(spark, 3, first=3).withColumn("lang", F.lit("de")), lake_root, contract=second)
    for _ in range(2):  # before and after the files were rewritten
        got = {r.event_id: r.lang for r in lake.read_events(spark, lake_root, contract=second).collect()}
        assert got == {**{f"m{k}": None for k in range(3)}, **{f"m{k}": "de" for k in range(3, 6)}}
        assert lake.read_events(spark, lake_root).count() == 6
        ops.compact(spark, lake_root)
    with pytest.raises(SchemaDrift, match="no later version"):
        lake.land_events(spark, wire(spark, 3, first=6), lake_root)
    other = later_version(EVENT_SCHEMA, T.StructField("lang", T.LongType(), True))
    with pytest.raises(SchemaDrift):
        lake.land_events(spark, wire(spark, 3, first=6).withColumn("lang", F.lit(1).cast("long")), lake_root, contract=other)
    for bad in (T.StructField("text", T.StringType(), True), T.StructField("must", T.StringType(), False), T.StructField("hr", T.StringType(), True)):
        with pytest.raises(SchemaDrift):
            later_version(EVENT_SCHEMA, bad)


def test_bars_of_an_empty_lake_are_the_baskets_around_now(spark, lake_root):
    from tickerlake.plans import jobs

    now = 1_700_000_000_000 // 60_000 * 60_000
    prints = [(t, (now + 60_000 * m) * 1000, m + 500, 9.0, 1) for m in range(-90, 90) for t in ("SPY", "AMD")]
    df = spark.createDataFrame(prints, "ticker string, trade_us long, trade_id long, price double, qty long")
    assert jobs.write_bars(spark, lake_root, df, mentioned_only=True, window_minutes=60, now_ms=now) == 60
    got = lake.read_market(spark, lake_root).collect()
    assert {r.ticker for r in got} == {"SPY"}
    assert min(r.ts for r in got) == now - 30 * 60_000 and max(r.ts for r in got) == now + 29 * 60_000
