"""The partitioned Parquet lake: typed reads, idempotent landing, rewrites.

Layout under a root (any Hadoop file system URI):

    {root}/source=/dt=/hr=/part-*.parquet                  raw events
    {root}/derived/sentiment/source=/dt=/hr=/part-*.parquet  scored events
    {root}/derived/market/dt=/hr=/part-*.parquet             one-minute bars

Reads give typed empty tables when nothing has been written yet. Writes go
through Spark's commit protocol, so a lost executor only re-runs tasks and a
failed job leaves no partial files visible. Rewrites (compaction, bar merges)
go through ``sources.snapshot``, which events and bars are read by; landing
knows redelivered ids from ``sources.ids``.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake.functions.tables import empty_table
from tickerlake.functions.timecols import dt_of, event_at, hr_of
from tickerlake.schemas import BAR_SCHEMA, EVENT_SCHEMA, FRAME_SCHEMA, PIECE_SCHEMA, SENTIMENT_SCHEMA, SchemaDrift, conform, is_later_version, read_schema
from tickerlake.session import keep
from tickerlake.sources import ids, snapshot
from tickerlake.sources.files import Folder, glob_matches

EVENT_PARTITIONS = ["source", "dt", "hr"]
MARKET_PARTITIONS = ["dt", "hr"]
COMPRESSION = "zstd"
BAR_READ = read_schema(BAR_SCHEMA, MARKET_PARTITIONS)


def sentiment_root(root: str) -> str:
    return f"{root.rstrip('/')}/derived/sentiment"


def market_root(root: str) -> str:
    return f"{root.rstrip('/')}/derived/market"


def hour_of(at, last: bool = False) -> tuple[str, str]:
    """(date, hour) of a date (its first hour, or its last) or of a time such as ``2024-01-01T06``."""
    day, _, hour = str(at).replace(" ", "T").partition("T")
    return day, hour[:2] if hour else ("23" if last else "00")


def _date_window(df: DataFrame, since, until) -> DataFrame:
    """Filter on the partition columns ``dt`` and ``hr`` (pruned at planning time); both ends belong to it."""
    day, hour = F.col("dt"), F.col("hr")
    if since is not None:
        d, h = hour_of(since)
        d = F.lit(d).cast("date")
        df = df.filter((day >= d) if h == "00" else ((day > d) | ((day == d) & (hour >= h))))
    if until is not None:
        d, h = hour_of(until, last=True)
        d = F.lit(d).cast("date")
        df = df.filter((day <= d) if h == "23" else ((day < d) | ((day == d) & (hour <= h))))
    return df


def contract_of(spark: SparkSession, base: str, default: T.StructType) -> T.StructType:
    """The newest contract version that was written to a table (``default`` if none is noted)."""
    folder = Folder(spark, f"{base.rstrip('/')}/_contract")
    noted = folder.names()
    return T.StructType.fromJson(json.loads(folder.read_text(noted[-1]))) if noted else default


def note_contract(spark: SparkSession, base: str, contract: T.StructType, first: T.StructType) -> None:
    """Note the version that is about to be written; an older or foreign one raises ``SchemaDrift``.

    Versions are numbered by their columns (``_contract/v007.json``).
    """
    newest = contract_of(spark, base, first)
    if not is_later_version(contract, newest):
        raise SchemaDrift(f"the table holds columns {newest.names}; {contract.names} is no later version of that")
    folder, name = Folder(spark, f"{base.rstrip('/')}/_contract"), f"v{len(contract.fields):03d}.json"
    if not folder.exists(name):
        folder.write_text(name, json.dumps(contract.jsonValue()))


def read_events(spark: SparkSession, root: str, since=None, until=None, contract: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Raw events with ``dt``, ``hr`` from the paths and ``event_at``.

    The glob ``source=*`` keeps ``derived/`` out. The ``source`` value comes
    from the path, which is the value every writer here partitions by.
    ``since``/``until`` (dates or hours such as ``2024-01-01T06``, inclusive)
    prune whole partitions. ``contract`` may be any version; files of earlier
    ones give NULL in columns that came later.
    """
    base = root.rstrip("/")
    df = _date_window(snapshot.read(spark, base, "source=*", read_schema(contract, EVENT_PARTITIONS)), since, until)
    return df.withColumn("event_at", event_at(F.col("event_ts")))


def event_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the raw lake's Parquet files; no file content is read."""
    glob = f"{root.rstrip('/')}/source=*"
    snapshot.recover(spark, root)
    if not glob_matches(spark, glob):
        return empty_table(spark, T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType())]))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return found.load(glob).select("path", "length")


def event_size(spark: SparkSession, root: str) -> tuple[int, int]:
    """(files, bytes) of the raw lake, as the file system counts them (one call per source)."""
    folder = Folder(spark, root)
    sources = [n for n in folder.names() if n.startswith("source=")]
    return sum(folder.files(n) for n in sources), sum(folder.size(n) for n in sources)


def read_sentiment(spark: SparkSession, root: str, since=None, until=None) -> DataFrame:
    schema = read_schema(SENTIMENT_SCHEMA, EVENT_PARTITIONS)
    df = _date_window(snapshot.read(spark, sentiment_root(root), "source=*", schema), since, until)
    return df.withColumn("event_at", event_at(F.col("event_ts")))


def read_market(spark: SparkSession, root: str, since=None, until=None) -> DataFrame:
    return _date_window(snapshot.read(spark, market_root(root), "dt=*", BAR_READ), since, until)


def with_hour_partitions(df: DataFrame, ts_col: str) -> DataFrame:
    """Add ``dt`` (UTC date) and ``hr`` ('00'..'23') from an epoch-ms column."""
    return df.withColumn("dt", dt_of(F.col(ts_col))).withColumn("hr", hr_of(F.col(ts_col)))


def write_partitioned(
    df: DataFrame,
    path: str,
    partitions: list[str],
    order_by: str,
    mode: str,
    max_records_per_file: int | None = None,
    seen: dict | None = None,
) -> int:
    """Write ``df`` partitioned by ``partitions``; rows ordered by ``order_by`` in each file.

    The rebalance hint hash-partitions by the partition columns and lets AQE
    split hot partitions (one source/hour holding a third of the data) into
    several tasks and merge tiny ones, so files stay near the advisory size
    instead of one file per task per partition. With mode "overwrite" and
    dynamic partition overwrite only the partitions present are replaced.

    ``max_records_per_file`` caps file size in rows (the size-based flush of
    a micro-batch sink). Returns the number of rows written (observed during
    the write, no second pass); ``seen`` gets the least ``order_by`` value too.
    """
    obs = Observation()
    writer = (
        df.observe(obs, F.count(F.lit(1)).alias("rows"), F.min(order_by).alias("least"))
        .hint("rebalance", *partitions)
        .sortWithinPartitions(*partitions, order_by)
        .write.mode(mode)
        .option("compression", COMPRESSION)
        .option("partitionOverwriteMode", "dynamic")
    )
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", str(int(max_records_per_file)))
    writer.partitionBy(*partitions).parquet(path)
    told = _observed(obs)
    if seen is not None:
        seen["least"] = told.get("least")
    return int(told.get("rows", 0))


def _observed(obs: Observation) -> dict:
    # AQE drops the observation node when it proves the input empty; the
    # metrics row is then missing, which means nothing was written.
    try:
        return dict(obs.get)
    except Py4JJavaError as e:
        if "AssertionError" in str(e.java_exception):
            return {}
        raise


def first_deliveries(df: DataFrame) -> DataFrame:
    """One row per (source, event_id): the earliest by event_ts, ingested_ts, then text and the other columns."""
    order = ["event_ts", "ingested_ts", "text", *[c for c in df.columns if c not in ("source", "event_id", "event_ts", "ingested_ts", "text")]]
    by = Window.partitionBy("event_id", "source").orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")


def land_events(
    spark: SparkSession,
    df: DataFrame,
    root: str,
    max_records_per_file: int | None = None,
    cache: bool = True,
    contract: T.StructType = EVENT_SCHEMA,
) -> int:
    """Append events to the raw lake so that re-landing adds nothing.

    An event is known by (source, event_id), whatever its time: of several
    incoming rows the earliest (event_ts, then ingested_ts, then text) is
    taken, and ids that the lake holds in any hour are left out. The id index
    (``sources.ids``) tells them; of the lake only the index buckets whose
    filter answers yes are read. Rows with a null source or id raise.

    ``cache`` keeps the batch for the three steps that read it (filters,
    events, index); without it the batch is computed again for each.
    ``contract`` is the version that ``df`` is written in; once a later one
    was written, an earlier one raises. Returns the number of rows appended.
    """
    base = root.rstrip("/")
    note_contract(spark, base, contract, EVENT_SCHEMA)
    incoming = first_deliveries(conform(df, contract))
    filled = glob_matches(spark, f"{base}/source=*")
    if filled and not ids.is_sound(spark, base):
        ids.rebuild(spark, base, read_events(spark, base))
    if cache:
        incoming = keep(incoming)
    try:
        fresh = incoming
        if filled:
            ids.flush(spark, base)
            seen = ids.known(spark, base, ids.opened(spark, base, incoming))
            fresh = incoming.join(seen, ["event_id", "source"], "left_anti").select(*incoming.columns)
        mark = ids.begin(spark, base)
        n = write_partitioned(with_hour_partitions(fresh, "event_ts"), base, EVENT_PARTITIONS, "event_ts", "append", max_records_per_file)
        if n:
            ids.add(spark, base, fresh.select("source", "event_id"))
        ids.end(spark, base, mark)
        return n
    finally:
        if cache:
            incoming.unpersist()


def write_sentiment(spark: SparkSession, df: DataFrame, root: str) -> int:
    """Dynamic overwrite of the sentiment partitions present in ``df``.

    Stored frames of later hours rest on rows that may have changed, so they go.
    """
    out = with_hour_partitions(conform(df, SENTIMENT_SCHEMA), "event_ts")
    seen: dict = {}
    n = write_partitioned(out, sentiment_root(root), EVENT_PARTITIONS, "event_ts", "overwrite", seen=seen)
    if n:
        first = datetime.fromtimestamp(seen["least"] / 1000, UTC).strftime("%Y-%m-%dT%H")
        folder = Folder(spark, frames_root(root))
        for name in folder.names():
            if name.removeprefix("asof=") > first:
                folder.delete(name)
    return n


def frames_root(root: str) -> str:
    return f"{root.rstrip('/')}/derived/frames"


def write_frames(spark: SparkSession, minutes: DataFrame, root: str, asof) -> None:
    """Store ``minutes`` (per ticker its last active minutes before the hour ``asof``)."""
    minutes.select(*FRAME_SCHEMA.names).write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{frames_root(root)}/asof={'T'.join(hour_of(asof))}")


def read_frames(spark: SparkSession, root: str, upto) -> tuple[str | None, DataFrame]:
    """The newest stored frames as of ``upto`` or before: (their hour, minutes); (None, empty) without any."""
    folder, last = Folder(spark, frames_root(root)), "T".join(hour_of(upto))
    hours = [n.removeprefix("asof=") for n in folder.names() if n.startswith("asof=") and folder.exists(f"{n}/_SUCCESS")]
    best = max((h for h in hours if h <= last), default=None)
    if best is None:
        return None, empty_table(spark, FRAME_SCHEMA)
    return best, spark.read.schema(FRAME_SCHEMA).parquet(f"{folder.path}/asof={best}")


def pieces_root(root: str) -> str:
    return f"{root.rstrip('/')}/derived/backtest"


def write_pieces(parts: DataFrame, root: str) -> int:
    """Dynamic overwrite of the hours present in ``parts`` (``backtest.pieces``)."""
    out = conform(parts, PIECE_SCHEMA).withColumns({"dt": F.to_date("at"), "hr": F.date_format("at", "HH")})
    return write_partitioned(out, pieces_root(root), MARKET_PARTITIONS, "at", "overwrite")


def read_pieces(spark: SparkSession, root: str, since=None, until=None) -> DataFrame:
    schema = read_schema(PIECE_SCHEMA, MARKET_PARTITIONS)
    return _date_window(snapshot.read(spark, pieces_root(root), "dt=*", schema), since, until)


def write_market(df: DataFrame, root: str) -> int:
    """Dynamic overwrite of the bar partitions (dt, hr) present in ``df``."""
    out = with_hour_partitions(conform(df, BAR_SCHEMA), "ts")
    return write_partitioned(out, market_root(root), MARKET_PARTITIONS, "ts", "overwrite")


def merge_market(spark: SparkSession, df: DataFrame, root: str, attempts: int = 5) -> int:
    """Upsert bars by (ticker, ts): touched (dt, hr) partitions keep bars of
    tickers not in ``df`` instead of being replaced wholesale.

    The files of the touched partitions are listed and rewritten together
    with the new bars in one commit (``sources.snapshot``). If any of these
    partitions changed meanwhile, the merge is done again on what is there
    then. Returns the rows written.
    """
    new = with_hour_partitions(conform(df, BAR_SCHEMA), "ts")
    base = market_root(root)
    hours = {(str(r["dt"]), r["hr"]) for r in new.select("dt", "hr").distinct().collect()}  # 24 a day at most
    if not hours:
        return 0

    def listed() -> list[str]:
        return snapshot.files_of(spark, base, "dt=*", BAR_READ, lambda part: (part["dt"], part["hr"]) in hours)

    for attempt in range(attempts):
        snapshot.recover(spark, base)
        inputs = listed()
        kept = snapshot.read_files(spark, base, BAR_READ, inputs).join(new.select("ticker", "ts"), ["ticker", "ts"], "left_anti")
        merged = new.unionByName(kept.select(*new.columns))
        try:
            return snapshot.rewrite(
                spark, base, inputs, lambda to, rows=merged: write_partitioned(rows, to, MARKET_PARTITIONS, "ts", "append"),
                unchanged=lambda was=inputs: listed() == was,
            )
        except snapshot.RewriteConflict:
            if attempt + 1 == attempts:
                raise
    raise AssertionError("unreachable")


def compact_events(spark: SparkSession, root: str, since=None, until=None, before_commit=None, apply_now: bool = True) -> int:
    """Rewrite raw-lake partitions (dates ``since``..``until``) into few files each; see ``ops.compact``."""
    base = root.rstrip("/")
    snapshot.recover(spark, base)
    low, high = since and hour_of(since), until and hour_of(until, last=True)
    wanted = lambda part: (not low or (part["dt"], part["hr"]) >= low) and (not high or (part["dt"], part["hr"]) <= high)
    schema = read_schema(contract_of(spark, base, EVENT_SCHEMA), EVENT_PARTITIONS)
    inputs = snapshot.files_of(spark, base, "source=*", schema, wanted)
    if not inputs:
        return 0
    rows = snapshot.read_files(spark, base, schema, inputs)
    return snapshot.rewrite(
        spark, base, inputs, lambda to: write_partitioned(rows, to, EVENT_PARTITIONS, "event_ts", "append"),
        expect=lambda n: n == rows.count(), before_commit=before_commit, apply_now=apply_now,
    )
