"""Streaming: stream = batch, restart from checkpoint, watermark counts."""

import os

from pyspark.sql import functions as F

from tickerlake.operators.ingest import normalise_items
from tickerlake.plans import queries
from tickerlake.schemas import EVENT_SCHEMA
from tickerlake.sources import fixtures, lake
from tickerlake.streaming import land as sland
from tickerlake.streaming import minute as sminute

SF = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_stream_land_equals_batch(spark, tmp_path):
    base = str(tmp_path)
    fixtures.write_time_chunks(fixtures.item_json_lines(spark, SF), f"{base}/in", chunks=3)
    q = sland.start_landing(
        spark, f"{base}/in/*", f"{base}/lake", f"{base}/ckpt", metrics_path=f"{base}/m",
        ingested_ts=1, max_files_per_trigger=1,
    )
    q.awaitTermination()
    got = lake.read_events(spark, f"{base}/lake")
    want = normalise_items(sland.read_item_batch(spark, f"{base}/in/*").filter(~F.col("parse_error")), "forum", 1)
    cols = EVENT_SCHEMA.names
    assert _rows(got, cols) == _rows(want, cols)
    reasons = {r.reason: r.n for r in sland.read_metrics(spark, f"{base}/m").collect()}
    assert reasons["accepted"] == got.count() and reasons["null"] > 0 and reasons["empty"] > 0


def test_restart_resumes_without_loss_or_duplicates(spark, tmp_path):
    """Stop after the first files, add the rest, restart from the checkpoint."""
    base = str(tmp_path)
    lines = fixtures.item_json_lines(spark, SF)
    fixtures.write_time_chunks(lines, f"{base}/all", chunks=4)
    chunks = sorted(os.listdir(f"{base}/all"))
    os.makedirs(f"{base}/in")
    # first run sees two chunks
    for c in chunks[:2]:
        os.rename(f"{base}/all/{c}", f"{base}/in/{c}")
    kw = dict(ingested_ts=1, max_files_per_trigger=1)
    sland.start_landing(spark, f"{base}/in/*", f"{base}/lake", f"{base}/ckpt", **kw).awaitTermination()
    first = lake.read_events(spark, f"{base}/lake").count()
    for c in chunks[2:]:
        os.rename(f"{base}/all/{c}", f"{base}/in/{c}")
    # a restarted job (same checkpoint) picks up only the new files
    sland.start_landing(spark, f"{base}/in/*", f"{base}/lake", f"{base}/ckpt", **kw).awaitTermination()
    got = lake.read_events(spark, f"{base}/lake")
    want = normalise_items(sland.read_item_batch(spark, f"{base}/in/*").filter(~F.col("parse_error")), "forum", 1)
    assert 0 < first < got.count()
    assert got.count() == want.count() == got.select("event_id").distinct().count()


def test_replayed_batch_adds_nothing(spark, tmp_path):
    """A fresh checkpoint over the same files (a full replay) lands no duplicates."""
    base = str(tmp_path)
    fixtures.write_time_chunks(fixtures.item_json_lines(spark, SF), f"{base}/in", chunks=2)
    for ck in ("c1", "c2"):
        sland.start_landing(spark, f"{base}/in/*", f"{base}/lake", f"{base}/{ck}", ingested_ts=1).awaitTermination()
    got = lake.read_events(spark, f"{base}/lake")
    assert got.count() == got.select("event_id").distinct().count()


def test_stream_minute_counts_equal_batch(spark, tmp_path):
    base = str(tmp_path)
    fixtures.write_time_chunks(fixtures.event_json_lines(spark, SF), f"{base}/in", chunks=3)
    ev = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", "1").json(f"{base}/in/*")
    sminute.start_minute_counts(spark, ev, f"{base}/out", f"{base}/ckpt").awaitTermination()
    got = sminute.read_minute_counts(spark, f"{base}/out")
    from tickerlake.operators.features import minute_counts
    from tickerlake.plans.queries import lake_events

    want = minute_counts(lake_events(spark, SF))
    cols = ["source", "minute", "n"]
    assert _rows(got, cols) == _rows(want, cols)


def test_json_strings_source_matches_file_reader(spark):
    from tickerlake.streaming.land import items_from_json_strings

    lines = fixtures.item_json_lines(spark, SF)
    a = items_from_json_strings(lines.select("value"))
    got = sorted((r.parse_error, r.item is None) for r in a.collect())
    n_null = sum(1 for _, isnull in got if isnull)
    assert n_null > 0 and not any(pe for pe, _ in got)
    assert a.filter("item IS NOT NULL").count() == lines.filter("value <> 'null'").count()


def test_progress_table(spark, tmp_path):
    from tickerlake.streaming.progress import progress_table

    base = str(tmp_path)
    fixtures.write_time_chunks(fixtures.item_json_lines(spark, SF), f"{base}/in", chunks=2)
    q = sland.start_landing(spark, f"{base}/in/*", f"{base}/lake", f"{base}/ckpt", ingested_ts=1, max_files_per_trigger=1)
    q.awaitTermination()
    p = progress_table(spark, q)
    assert p.agg({"num_input_rows": "sum"}).first()[0] == fixtures.item_json_lines(spark, SF).count()


def test_items_delivered_twice_land_once(spark, tmp_path):
    base = str(tmp_path)
    lines = fixtures.item_json_lines(spark, SF)
    # the same items delivered twice in different files
    fixtures.write_time_chunks(lines, f"{base}/in/a", chunks=1)
    fixtures.write_time_chunks(lines, f"{base}/in/b", chunks=1)
    q = sland.start_landing(
        spark, f"{base}/in/*/*", f"{base}/lake", f"{base}/ckpt", ingested_ts=1
    )
    q.awaitTermination()
    got = lake.read_events(spark, f"{base}/lake")
    once = sland.read_item_batch(spark, f"{base}/in/a/*").filter("NOT parse_error")
    want = normalise_items(once, "forum", 1)
    # every accepted item is there, those without a time included
    assert got.count() == got.select("event_id").distinct().count() == want.select("event_id").distinct().count() > 0


def _split_events(spark, path, parts=6):
    spark.read.parquet(f"{SF}/events.parquet").repartition(parts).write.parquet(f"{path}/events.parquet")
    return path


def test_a_chunk_is_one_batch_however_the_table_is_split(spark, tmp_path, monkeypatch):
    """Batches are counted by chunks, not by the scan's splits; their steps run adaptively, the stream's setting stays."""
    sf, seen, land = _split_events(spark, str(tmp_path / "sf")), [], lake.land_events
    monkeypatch.setattr(fixtures, "FILE_ROWS", 60)

    def watched(session, *args, **kw):
        seen.append((session, session.conf.get("spark.sql.adaptive.enabled")))
        return land(session, *args, **kw)

    monkeypatch.setattr(lake, "land_events", watched)
    got = queries.q_malformed(spark, sf).collect()
    assert [on for _, on in seen] == ["true"] * 4
    monkeypatch.setattr(fixtures, "FILE_ROWS", 100_000)
    want = queries.q_malformed(spark, SF).collect()
    assert sorted(got) == sorted(want) and {r.reason for r in got} >= {"accepted", "quarantined"}
    assert len(seen) == 8
    assert queries.q_run_metrics(spark, sf).first().every_batch_wrote


def test_split_table_lands_by_chunks_and_loses_no_minute(spark, tmp_path, monkeypatch):
    """Rows of one chunk in several files are no late rows, and the landing stream has a batch a chunk."""
    sf, batches, land = _split_events(spark, str(tmp_path / "sf")), [], lake.land_events
    monkeypatch.setattr(lake, "land_events", lambda *a, **kw: batches.append(1) or land(*a, **kw))
    got = queries.q_stream_land(spark, sf)
    assert len(batches) == 4
    cols = got.drop("dt", "hr").columns
    assert sorted(_rows(got, ["event_id"])) == _rows(queries.q_normalise(spark, SF), ["event_id"])
    assert got.select(*cols).exceptAll(queries.q_normalise(spark, SF).select(*cols)).isEmpty()
    from tickerlake.operators.features import minute_counts

    cols = ["source", "minute", "n"]
    assert _rows(queries.q_stream_minute(spark, sf), cols) == _rows(minute_counts(queries.lake_events(spark, SF)), cols)


def test_split_table_delivered_twice_lands_once_in_four_batches(spark, tmp_path, monkeypatch):
    sf, batches, land = _split_events(spark, str(tmp_path / "sf")), [], lake.land_events
    monkeypatch.setattr(lake, "land_events", lambda *a, **kw: batches.append(1) or land(*a, **kw))
    got = _rows(queries.q_stream_land_dedup(spark, sf), ["event_id"])
    assert len(batches) == 4 and got == _rows(queries.q_normalise(spark, SF), ["event_id"])


def test_split_broken_feed_is_replayed_whole(spark, tmp_path, monkeypatch):
    sf, landings, land = _split_events(spark, str(tmp_path / "sf")), [], lake.land_events
    monkeypatch.setattr(lake, "land_events", lambda *a, **kw: landings.append(1) or land(*a, **kw))
    got = _rows(queries.q_replayed(spark, sf), ["event_id"])
    assert len(landings) == 6  # four batches, two replays
    assert got == _rows(queries.q_normalise(spark, SF), ["event_id"])
