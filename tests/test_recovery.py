"""Landing under failure: killed batches, malformed lines, cursors, limits."""

import glob
import json
import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickerlake.cli import main
from tickerlake.operators.ingest import normalise_items
from tickerlake.sources import fixtures, ids, lake
from tickerlake.sources.item_ids import IdRange, ItemIdReader, ItemIds
from tickerlake.streaming import land as sland

SF = "/root/testdata/sf0.001"


def _item(i, text="something happened"):
    return json.dumps({"id": i, "time": 1_650_000_000 + 60 * i, "by": "ann", "title": text})


def _write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def _ids(spark, root):
    got = [r.event_id for r in lake.read_events(spark, root).collect()]
    assert len(got) == len(set(got))
    return {int(i) for i in got}


@pytest.mark.parametrize("when", ["half of the events written", "events written, index not", "all written, batch not committed"])
def test_a_batch_killed_on_the_way_is_landed_once(spark, tmp_path, monkeypatch, when):
    for k in range(4):
        _write(tmp_path / "in" / f"{k}.json", [_item(i) for i in range(50 * k, 50 * k + 50)])
    root, calls = str(tmp_path / "lake"), []
    real_land, real_add = lake.land_events, ids.add

    def kill_second(*args, **kw):
        calls.append(1)
        if len(calls) != 2:
            return real_land(*args, **kw)
        if when.startswith("half"):
            real_land(args[0], args[1].where("CAST(event_id AS int) % 2 = 0"), args[2], **kw)
        elif when.startswith("all"):
            real_land(*args, **kw)
        else:
            with monkeypatch.context() as m:
                m.setattr(ids, "add", lambda *a: (_ for _ in ()).throw(OSError("killed")))
                real_land(*args, **kw)
        raise OSError("killed")

    def run():
        q = sland.start_landing(spark, str(tmp_path / "in"), root, str(tmp_path / "ck"), metrics_path=str(tmp_path / "m"), ingested_ts=1, max_files_per_trigger=1)
        q.awaitTermination()

    with monkeypatch.context() as m:
        m.setattr(lake, "land_events", kill_second)
        with pytest.raises(Exception, match="killed"):
            run()
    assert len(_ids(spark, root)) < 200
    run()
    assert _ids(spark, root) == set(range(200))
    assert ids.is_sound(spark, root) and ids.add is real_add
    told = {r.reason: r.n for r in sland.read_metrics(spark, str(tmp_path / "m")).collect()}
    assert told["accepted"] == 200


def test_malformed_lines_are_kept_repaired_and_replayed_once(spark, tmp_path, capsys):
    bad = _item(7)[:-1]
    _write(tmp_path / "in" / "a.json", [_item(1), bad, "null", "not json at all", bad])
    _write(tmp_path / "in" / "b.json", [bad, _item(2)])
    root = str(tmp_path / "lake")
    args = ["--lake", root, "--items", str(tmp_path / "in"), "--checkpoint", str(tmp_path / "ck"), "--metrics", str(tmp_path / "m"), "--max-files", "1"]
    assert main(["ingest", *args]) == 0
    assert _ids(spark, root) == {1, 2}
    waiting = {(os.path.basename(r.file), r.line): r.n for r in sland.read_quarantine(spark, root).collect()}
    assert waiting == {("a.json", bad): 2, ("a.json", "not json at all"): 1, ("b.json", bad): 1}
    assert {r.reason: r.n for r in sland.read_metrics(spark, str(tmp_path / "m")).collect()}["malformed"] == 4
    assert main(["replay", "--lake", root, "--repair", "concat(line, '}')", "--run", "one"]) == 0
    assert "landed 1 repaired" in capsys.readouterr().out
    assert _ids(spark, root) == {1, 2, 7}
    assert [r.line for r in sland.read_quarantine(spark, root).collect()] == ["not json at all"]
    assert sland.replay(spark, root, F.concat("line", F.lit("}")), "two") == 0
    assert sland.read_quarantine(spark, str(tmp_path / "no-lake")).count() == 0


def test_lines_quarantined_while_a_replay_lands_wait_for_the_next(spark, tmp_path, monkeypatch):
    root, write = str(tmp_path / "lake"), lake.write_partitioned

    def hold(batch, numbers):
        rows = [(True, _item(i)[:-1], f"{batch}.json") for i in numbers]
        sland.quarantine(spark.createDataFrame(rows, "parse_error boolean, line string, file string"), root, batch)

    def held_meanwhile(*args, **kw):
        monkeypatch.setattr(lake, "write_partitioned", write)
        hold(1, range(20, 30))
        return write(*args, **kw)

    hold(0, range(20))
    monkeypatch.setattr(lake, "write_partitioned", held_meanwhile)
    repair = F.concat("line", F.lit("}"))
    assert sland.replay(spark, root, repair, "one", ingested_ts=1) == 20
    assert sland.read_quarantine(spark, root).count() == 10
    assert sland.replay(spark, root, repair, "two", ingested_ts=1) == 10
    assert _ids(spark, root) == set(range(30)) and sland.read_quarantine(spark, root).isEmpty()


def test_a_small_landing_keeps_few_partitions(spark, tmp_path, monkeypatch):
    """A kept batch has partitions by its size; all 40 would each write 40 files in every step that follows."""
    kept, write, free = [], lake.write_partitioned, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    monkeypatch.setattr(lake, "write_partitioned", lambda df, *a, **kw: kept.append(df.rdd.getNumPartitions()) or write(df, *a, **kw))
    parts, was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(free)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        lines = spark.createDataFrame([(_item(i),) for i in range(200)], "value string")
        events = normalise_items(sland.items_from_json_strings(lines), "forum", 1)
        assert lake.land_events(spark, events, str(tmp_path / "lake")) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len(kept) == 1 and kept[0] <= 4 and spark.conf.get(free) == was
    assert _ids(spark, str(tmp_path / "lake")) == set(range(200))


def test_a_cursor_goes_on_after_the_last_id(spark, tmp_path):
    """Started at the newest id: earlier items stay out, later ones come once, across restarts."""
    spark.dataSource.register(ItemIds)
    store, root = str(tmp_path / "store"), str(tmp_path / "lake")

    def grow(first, n):
        spark.createDataFrame([(i, _item(i)) for i in range(first, first + n)], "id bigint, value string").coalesce(1).write.mode("append").parquet(store)

    def run():
        items = spark.readStream.format("item_ids").option("path", store).option("idsPerPartition", "7").load()
        sland.start_landing(spark, sland.items_from_json_strings(items), root, str(tmp_path / "ck"), ingested_ts=1).awaitTermination()

    grow(0, 40)
    run()
    assert _ids(spark, root) == set()
    for first in (40, 65):
        grow(first, 20)  # 60 .. 64 never existed
        run()
        run()
    assert _ids(spark, root) == {*range(40, 60), *range(65, 85)}


def test_cursor_offsets(tmp_path):
    empty = ItemIdReader({"path": str(tmp_path / "none")})
    assert empty.initialOffset() == empty.latestOffset() == {"next": 0} and empty.partitions({"next": 0}, {"next": 0}) == []
    r = ItemIdReader({"path": str(tmp_path), "start": "12", "idsPerPartition": "5"})
    assert r.initialOffset() == {"next": 12}
    assert [(p.first, p.stop) for p in r.partitions({"next": 12}, {"next": 23})] == [(12, 17), (17, 22), (22, 23)]
    with pytest.raises(ValueError, match="path"):
        ItemIdReader({})


def test_a_task_reads_its_ids_in_small_batches_whatever_the_row_groups(tmp_path):
    """One wide row group in no order, a file without statistics and one out of range: the ids of the range, 8192 rows at most at a time."""
    def write(name, numbers, **kw):
        pq.write_table(pa.table({"id": pa.array(numbers, pa.int64()), "value": [str(i) * 20 for i in numbers]}), tmp_path / name, **kw)

    write("wide.parquet", [i * 7919 % 200_000 for i in range(200_000)], row_group_size=200_000)
    write("plain.parquet", range(200_000, 200_050), write_statistics=False)
    write("later.parquet", range(900_000, 900_050))
    reader, got, before = ItemIdReader({"path": str(tmp_path)}), [], pa.total_allocated_bytes()
    for batch in reader.read(IdRange(50_000, 200_010)):
        assert batch.num_rows <= 8192 and pa.total_allocated_bytes() - before < 12 << 20
        assert batch.column("value").to_pylist() == [str(i) * 20 for i in batch.column("id").to_pylist()]
        got += batch.column("id").to_pylist()
    assert sorted(got) == list(range(50_000, 200_010))
    assert list(reader.read(IdRange(300_000, 400_000))) == []


def test_duration_stops_a_running_stream(spark, tmp_path):
    fixtures.write_time_chunks(fixtures.item_json_lines(spark, SF), str(tmp_path / "in"), chunks=1)
    start = time.time()
    args = ["--items", str(tmp_path / "in" / "*"), "--checkpoint", str(tmp_path / "ck"), "--every", "1 second", "--duration", "20"]
    assert main(["ingest", "--lake", str(tmp_path / "lake"), *args]) == 0
    assert 20 <= time.time() - start < 90
    assert not spark.streams.active
    want = normalise_items(sland.read_item_batch(spark, str(tmp_path / "in" / "*")).filter(~F.col("parse_error")), "forum", 1)
    assert lake.read_events(spark, str(tmp_path / "lake")).count() == want.count() > 0


def test_batches_by_bytes_and_files_by_size(spark, tmp_path):
    for k in range(6):
        _write(tmp_path / "in" / f"{k}.json", [_item(100 * k + i, "x" * 200) for i in range(20)])
    q = sland.start_landing(
        spark, str(tmp_path / "in"), str(tmp_path / "lake"), str(tmp_path / "ck"), metrics_path=str(tmp_path / "m"), ingested_ts=1,
        max_bytes_per_trigger=str(os.path.getsize(tmp_path / "in" / "3.json") * 2 + 10), target_file_bytes=1500,
    )
    q.awaitTermination()
    assert len(glob.glob(str(tmp_path / "m" / "batch_id=*"))) >= 3
    rows = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(str(tmp_path / "lake" / "source=*" / "**" / "*.parquet"), recursive=True)]
    assert sum(rows) == 120 and max(rows) == 6  # rows of some 235 bytes
