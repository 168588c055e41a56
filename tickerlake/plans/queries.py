"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator.

Inputs are the supplied test tables, turned into the pipeline's shapes by
``tickerlake.sources.fixtures``. Queries that exercise the lake write to a
fresh folder under the session's shared scratch root and read it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake.functions.lexicon import lexicon_df
from tickerlake.functions.timecols import event_at
from tickerlake.operators import backtest, bars, features, ingest, ops, sentiment, signal
from tickerlake.plans import params as QP
from tickerlake.session import prepare_session, scratch_path
from tickerlake.sources import fixtures, ids, lake

Query = Callable[[SparkSession, str], DataFrame]


# --- shared inputs ------------------------------------------------------------


def lake_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as the events view of the lake (no write): event_at, dt, hr."""
    f = fixtures.landing_feed(spark, sf_dir)
    return lake.with_hour_partitions(f, "event_ts").withColumn("event_at", event_at(F.col("event_ts")))


def scored_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed scored in memory, as the sentiment view (with event_at)."""
    s = sentiment.score_events(fixtures.feed(spark, sf_dir), lexicon_df(spark), scored_ts=QP.SCORED_TS)
    return s.withColumn("event_at", event_at(F.col("event_ts")))


def feed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.resample_prints(fixtures.prints(spark, sf_dir))


def full_signal(spark: SparkSession, sf_dir: str, frame: str = "rows", limit: int | None = None) -> DataFrame:
    return signal.build_signal(scored_feed(spark, sf_dir), feed_bars(spark, sf_dir), limit=limit, frame=frame)


def _landed_lake(spark: SparkSession, sf_dir: str, times: int = 1) -> str:
    root = scratch_path(spark, "lake")
    for _ in range(times):
        lake.land_events(spark, fixtures.landing_feed(spark, sf_dir), root)
    return root


def _round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round for cross-engine comparison; ``+ 0.0`` turns -0.0 into 0.0."""
    return df.select(
        *[(F.round(F.col(c), digits[c]) + F.lit(0.0)).alias(c) if c in digits else F.col(c) for c in df.columns]
    )


# --- ingest -------------------------------------------------------------------


def q_normalise(spark, sf_dir):
    return ingest.normalise_items(fixtures.items(spark, sf_dir), QP.ITEM_SOURCE, QP.INGEST_CLOCK_MS)


def q_reject_reasons(spark, sf_dir):
    return ingest.reject_counts(fixtures.items(spark, sf_dir))


# --- lake ---------------------------------------------------------------------

LAKE_COLS = ["source", "event_id", "event_ts", "ingested_ts", "author", "text", "url", "dt", "hr"]


def q_land_roundtrip(spark, sf_dir):
    root = _landed_lake(spark, sf_dir)
    return lake.read_events(spark, root).select(*LAKE_COLS)


def q_idempotent(spark, sf_dir):
    root = _landed_lake(spark, sf_dir, times=2)
    return ops.partition_counts(lake.read_events(spark, root))


def q_partition_counts(spark, sf_dir):
    return ops.partition_counts(lake_events(spark, sf_dir))


def q_minute_counts(spark, sf_dir):
    return features.latest_minute_counts(lake_events(spark, sf_dir), limit=50)


def q_minute_counts_all(spark, sf_dir):
    return features.minute_counts(lake_events(spark, sf_dir))


# --- text features ------------------------------------------------------------


def q_tickers_extract(spark, sf_dir):
    t = features.ticker_lists(fixtures.feed(spark, sf_dir))
    return t.select("source", "event_id", F.array_join("tickers", ",").alias("tickers"))


def q_unknown_symbols(spark, sf_dir):
    return features.unknown_symbol_counts(fixtures.feed(spark, sf_dir))


def q_docs_tickers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    from tickerlake.functions.tickers import extract_tickers

    return docs.select("doc_id", F.array_join(extract_tickers(F.col("text")), ",").alias("tickers"))


def q_docs_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sentiment.score_texts(docs, lexicon_df(spark), keep=["doc_id"])


def q_docs_score_rules(spark, sf_dir):
    """Documents scored with a lexicon of their own frequent words, so that every rule is met often."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sentiment.score_texts(docs, lexicon_df(spark, QP.RULE_LEXICON), keep=["doc_id"], params=QP.RULE_PARAMS)


def q_score(spark, sf_dir):
    s = scored_feed(spark, sf_dir)
    return s.select(
        "source", "event_id", "event_ts", "compound", "pos", "neu", "neg", F.array_join("tickers", ",").alias("tickers")
    )


def q_ticker_minute(spark, sf_dir):
    return features.latest_per_ticker(scored_feed(spark, sf_dir), "minute", limit=50)


def q_ticker_hour(spark, sf_dir):
    return features.latest_per_ticker(scored_feed(spark, sf_dir), "hour", limit=50)


def q_ticker_5min(spark, sf_dir):
    return features.latest_per_ticker(scored_feed(spark, sf_dir), "5 minutes", limit=50)


def q_ticker_minute_all(spark, sf_dir):
    return features.per_ticker(scored_feed(spark, sf_dir), "minute")


def q_distinct_tickers(spark, sf_dir):
    return features.distinct_tickers(scored_feed(spark, sf_dir))


def q_event_bounds(spark, sf_dir):
    return features.event_bounds(fixtures.feed(spark, sf_dir), minutes=QP.BAR_MINUTES)


def q_universe_filter(spark, sf_dir):
    symbols = spark.range(1).select(F.lit(QP.UNIVERSE_TEXT).alias("symbols"))
    uni = features.universe(symbols)
    return features.restrict_to_universe(features.per_ticker(scored_feed(spark, sf_dir), "minute"), uni)


# --- bars ---------------------------------------------------------------------


def q_bars_ohlcv(spark, sf_dir):
    return feed_bars(spark, sf_dir)


def q_fwd_return(spark, sf_dir):
    return bars.forward_returns(feed_bars(spark, sf_dir))


# --- signal -------------------------------------------------------------------


def q_rolling(spark, sf_dir):
    return signal.rolling(signal.per_minute(scored_feed(spark, sf_dir)))


def q_signal(spark, sf_dir):
    return full_signal(spark, sf_dir)


def q_signal_top(spark, sf_dir):
    return full_signal(spark, sf_dir, limit=100)


def q_signal_range(spark, sf_dir):
    return full_signal(spark, sf_dir, frame="range")


def q_position_mix(spark, sf_dir):
    return signal.position_mix(full_signal(spark, sf_dir))


def q_trades(spark, sf_dir):
    return backtest.trades(full_signal(spark, sf_dir))


_SUMMARY_DIGITS = {
    "total_pnl": 9, "mean_pnl": 9, "std_pnl": 9, "sharpe_annual": 6, "max_drawdown": 9, "hit_rate": 9,
}


def q_backtest(spark, sf_dir):
    return _round(backtest.summary(full_signal(spark, sf_dir, limit=100)), _SUMMARY_DIGITS)


def q_backtest_full(spark, sf_dir):
    return _round(backtest.summary(full_signal(spark, sf_dir)), _SUMMARY_DIGITS)


def q_equity_curve(spark, sf_dir):
    c = backtest.equity_curve(full_signal(spark, sf_dir)).filter(F.col("is_trade"))
    c = c.select("ticker", "bucket", "pnl", "cum_pnl", "peak", "drawdown")
    return _round(c, {"pnl": 9, "cum_pnl": 9, "peak": 9, "drawdown": 9})


def q_max_drawdown(spark, sf_dir):
    c = backtest.equity_curve(full_signal(spark, sf_dir))
    out = c.agg(
        F.count(F.when(F.col("is_trade"), True)).cast("long").alias("n_trades"),
        F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
    )
    return _round(out, {"max_drawdown": 9})


def q_backtest_costs(spark, sf_dir):
    c = backtest.with_costs(full_signal(spark, sf_dir), QP.COST_BPS)
    return _round(c.select("ticker", "bucket", "pos", "pnl", "turnover", "net_pnl"), {"pnl": 9, "net_pnl": 9})


# --- operations ---------------------------------------------------------------


def q_freshness(spark, sf_dir):
    return ops.freshness(lake_events(spark, sf_dir), "minute")


def q_rate_guard(spark, sf_dir):
    return ops.rate_guard(lake_events(spark, sf_dir), QP.RATE_BUDGET_PER_HOUR)


def q_pipeline_metrics(spark, sf_dir):
    return ops.pipeline_metrics(
        lake_events(spark, sf_dir), scored_feed(spark, sf_dir), fixtures.items(spark, sf_dir), QP.ITEM_SOURCE
    )


def q_storage_cost(spark, sf_dir):
    """Land the feed, then report compressed bytes, bytes/row and cost."""
    root = _landed_lake(spark, sf_dir)
    return ops.storage_report(lake.event_files(spark, root), lake.read_events(spark, root))


def q_storage_check(spark, sf_dir):
    """The storage report's rows, and whether its other figures agree with each other."""
    r = q_storage_cost(spark, sf_dir)
    day = F.col("bytes") / F.col("rows") * 86400 * 100 / F.lit(1024.0**3)
    return r.select(
        "rows",
        (F.col("files") >= 24).alias("file_per_partition"),
        F.col("bytes").between(F.col("rows"), F.col("rows") * 200).alias("bytes_in_range"),
        (F.abs(F.col("usd_per_month") - day * 30 * ops.PRICE_PER_GB_MONTH) < 1e-9).alias("cost_agrees"),
    )


def q_compact(spark, sf_dir):
    """Land the feed in several batches (small files), compact, read back."""
    root = scratch_path(spark, "lake-compact")
    feed = fixtures.landing_feed(spark, sf_dir)
    k = QP.COMPACT_BATCHES
    for i in range(k):
        part = feed.filter(F.pmod(F.xxhash64("event_id"), F.lit(k)) == i)
        lake.land_events(spark, part, root)
    ops.compact(spark, root)
    return lake.read_events(spark, root).select(*LAKE_COLS)


def q_score_lake(spark, sf_dir):
    """Land the feed, run the scoring job, read the sentiment table back."""
    from tickerlake.plans import jobs

    root = _landed_lake(spark, sf_dir)
    jobs.score_lake(spark, root, scored_ts=QP.SCORED_TS)
    s = lake.read_sentiment(spark, root)
    return s.select(
        "source", "event_id", "event_ts", "compound", "pos", "neu", "neg",
        F.array_join("tickers", ",").alias("tickers"), "scored_ts", "dt", "hr",
    )


def q_market_lake(spark, sf_dir):
    """Write bars from the prints to the market table and read them back."""
    from tickerlake.plans import jobs

    root = scratch_path(spark, "lake-market")
    jobs.write_bars(spark, root, fixtures.prints(spark, sf_dir))
    return lake.read_market(spark, root).select("ticker", "ts", "open", "high", "low", "close", "volume", "dt", "hr")


def _scored_lake(spark: SparkSession, sf_dir: str, with_bars: bool = True) -> str:
    """The feed landed and scored, and the bars written unless told otherwise."""
    from tickerlake.plans import jobs

    root = _landed_lake(spark, sf_dir)
    jobs.score_lake(spark, root, scored_ts=QP.SCORED_TS)
    if with_bars:
        jobs.write_bars(spark, root, fixtures.prints(spark, sf_dir))
    return root


def q_signal_lake(spark, sf_dir):
    """The signal read from lake tables, through the job."""
    from tickerlake.plans import jobs

    return jobs.signal_view(spark, _scored_lake(spark, sf_dir))


def _windowed_lake(spark: SparkSession, sf_dir: str) -> str:
    """The scored lake with frames stored two hours before the window starts."""
    from tickerlake.plans import jobs

    root = _scored_lake(spark, sf_dir)
    jobs.save_frames(spark, root, QP.FRAMES_HOUR)
    return root


def q_signal_since(spark, sf_dir):
    """A run from an hour on gives the rows that the full signal has there."""
    from tickerlake.plans import jobs

    return jobs.signal_view(spark, _windowed_lake(spark, sf_dir), since=QP.SINCE_HOUR)


def q_signal_until(spark, sf_dir):
    """A run up to an hour gives the rows that the full signal has there, forward closes included."""
    from tickerlake.plans import jobs

    return jobs.signal_view(spark, _scored_lake(spark, sf_dir), until=QP.UNTIL_HOUR)


def q_backtest_window(spark, sf_dir):
    from tickerlake.plans import jobs

    return _round(jobs.backtest_report(spark, _windowed_lake(spark, sf_dir), since=QP.SINCE_HOUR, until=QP.UNTIL_HOUR), _SUMMARY_DIGITS)


def q_backtest_daily(spark, sf_dir):
    """The backtest from stored pieces of three windows, each of which added its own hours."""
    from tickerlake.plans import jobs

    root = _scored_lake(spark, sf_dir)
    for window in ({"until": "2024-01-01T03"}, {"since": "2024-01-01T04", "until": "2024-01-01T07"}, {"since": "2024-01-01T08"}):
        if "since" in window:
            jobs.save_frames(spark, root, window["since"])
        jobs.store_backtest(spark, root, **window)
    return _round(jobs.stored_backtest(spark, root), _SUMMARY_DIGITS)


def q_signal_no_market(spark, sf_dir):
    """The signal of a lake that has no bars yet: closes and returns are NULL."""
    from tickerlake.plans import jobs

    return jobs.signal_view(spark, _scored_lake(spark, sf_dir, with_bars=False))


def q_backtest_lake(spark, sf_dir):
    from tickerlake.plans import jobs

    return _round(jobs.backtest_report(spark, _scored_lake(spark, sf_dir)), _SUMMARY_DIGITS)


def q_redelivered(spark, sf_dir):
    """The feed landed, then delivered again five hours later: nothing is added."""
    root = _landed_lake(spark, sf_dir)
    later = F.col("event_ts") + 5 * 3_600_000
    lake.land_events(spark, fixtures.landing_feed(spark, sf_dir).withColumn("event_ts", later), root)
    return lake.read_events(spark, root).select(*LAKE_COLS)


def q_redelivered_bucketed(spark, sf_dir):
    """The feed landed in three batches that fill the buckets of the id index, then delivered again as a whole."""
    root = scratch_path(spark, "lake-buckets")
    feed = fixtures.landing_feed(spark, sf_dir)
    for k in range(3):
        lake.land_events(spark, feed.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k), root)
        ids.flush(spark, root, always=True)
    lake.land_events(spark, feed.withColumn("event_ts", F.col("event_ts") + F.expr("IF(pmod(xxhash64(event_id), 4) < 3, 18000000, 0)")), root)
    return lake.read_events(spark, root).select(*LAKE_COLS)


def q_compact_concurrent(spark, sf_dir):
    """Half of the feed lands while the other half is compacted, after its files were written and before the commit."""
    root = scratch_path(spark, "lake-compact-while")
    feed = fixtures.landing_feed(spark, sf_dir)
    even = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    lake.land_events(spark, feed.filter(even), root)
    ops.compact(spark, root, before_commit=lambda: lake.land_events(spark, feed.filter(~even), root))
    return lake.read_events(spark, root).select(*LAKE_COLS)


def q_mixed_versions(spark, sf_dir):
    """One source landed before a column was added to the contract, the other after; compacted and read together."""
    from pyspark.sql import types as T

    from tickerlake.schemas import EVENT_SCHEMA, later_version

    root = scratch_path(spark, "lake-versions")
    feed = fixtures.landing_feed(spark, sf_dir)
    second = later_version(EVENT_SCHEMA, T.StructField("lang", T.StringType(), True))
    lake.land_events(spark, feed.filter("source = 'synth'"), root)
    lake.land_events(spark, feed.filter("source = 'forum'").withColumn("lang", F.lit("en")), root, contract=second)
    ops.compact(spark, root)
    return lake.read_events(spark, root, contract=second).select(*LAKE_COLS, "lang")


def q_market_merge(spark, sf_dir):
    """Bars merged ticker by ticker into the same hours; the last merge replaces one ticker's bars by themselves."""
    from tickerlake.plans import jobs

    root = scratch_path(spark, "lake-merge")
    prints = fixtures.prints(spark, sf_dir)
    for tickers in (["INTC", "CSCO"], ["ORCL", "AMD"], ["INTC"]):
        jobs.write_bars(spark, root, prints.filter(F.col("ticker").isin(tickers)), merge=True)
    return lake.read_market(spark, root).select("ticker", "ts", "open", "high", "low", "close", "volume", "dt", "hr")


def q_market_window(spark, sf_dir):
    """Bars for the mentioned tickers only, in a window centred on the events."""
    from tickerlake.plans import jobs

    root = _landed_lake(spark, sf_dir)
    jobs.score_lake(spark, root, scored_ts=QP.SCORED_TS)
    jobs.write_bars(spark, root, fixtures.prints(spark, sf_dir), mentioned_only=True, window_minutes=QP.BAR_MINUTES)
    return lake.read_market(spark, root).select("ticker", "ts", "open", "high", "low", "close", "volume")


# --- streaming ----------------------------------------------------------------

STREAM_COLS = ["source", "event_id", "event_ts", "ingested_ts", "author", "text", "url", "dt", "hr"]


def q_stream_land(spark, sf_dir):
    """Items as JSON files -> availableNow landing stream -> lake read-back."""
    root = f"{_landed_stream(spark, sf_dir, fixtures.item_json_lines(spark, sf_dir))}/lake"
    return lake.read_events(spark, root).select(*STREAM_COLS)


def q_stream_land_dedup(spark, sf_dir):
    """Every item delivered twice, in two rounds of files; items without a time are kept."""
    from tickerlake.streaming import land as sland

    base = scratch_path(spark, "stream-dedup")
    lines = fixtures.item_json_lines(spark, sf_dir)
    files = fixtures.files_per_chunk(lines, chunks=2)
    for delivery in ("first", "again"):
        fixtures.write_time_chunks(lines, f"{base}/in/{delivery}", chunks=2, files=files)
    root = f"{base}/lake"
    q = sland.start_landing(
        spark, f"{base}/in/*/*", root, f"{base}/ckpt", source=QP.ITEM_SOURCE, ingested_ts=QP.INGEST_CLOCK_MS,
        max_files_per_trigger=files,
    )
    q.awaitTermination()
    return lake.read_events(spark, root).select(*STREAM_COLS)


def _landed_stream(spark: SparkSession, sf_dir: str, lines: DataFrame, **kw) -> str:
    """JSON lines landed chunk by chunk; returns the folder of lake and metrics."""
    from tickerlake.streaming import land as sland

    base = scratch_path(spark, "stream-lines")
    files = fixtures.files_per_chunk(lines)
    fixtures.write_time_chunks(lines, f"{base}/in", chunks=4, files=files)
    q = sland.start_landing(
        spark, f"{base}/in/*", f"{base}/lake", f"{base}/ckpt", metrics_path=f"{base}/metrics",
        source=QP.ITEM_SOURCE, ingested_ts=QP.INGEST_CLOCK_MS, max_files_per_trigger=files, **kw,
    )
    q.awaitTermination()
    return base


def q_malformed(spark, sf_dir):
    """Reasons of a feed in which every tenth item is broken, and the lines kept of them."""
    from tickerlake.streaming import land as sland

    base = _landed_stream(spark, sf_dir, fixtures.broken_json_lines(spark, sf_dir))
    told = sland.read_metrics(spark, f"{base}/metrics").where(F.col("reason").isin("accepted", "empty", "null", "malformed"))
    kept = sland.read_quarantine(spark, f"{base}/lake").agg(F.sum("n").cast("long").alias("n"))
    return told.select("reason", "n").unionByName(kept.select(F.lit("quarantined").alias("reason"), "n"))


def q_replayed(spark, sf_dir):
    """The broken feed after its lines were repaired and replayed (twice, which adds nothing)."""
    from tickerlake.streaming import land as sland

    root = f"{_landed_stream(spark, sf_dir, fixtures.broken_json_lines(spark, sf_dir))}/lake"
    for run in ("first", "again"):
        sland.replay(spark, root, F.concat("line", F.lit("}")), run, QP.ITEM_SOURCE, QP.INGEST_CLOCK_MS)
    return lake.read_events(spark, root).select(*STREAM_COLS)


def q_run_metrics(spark, sf_dir):
    """What the landing runs counted themselves: events, batches that wrote, and whether files and bytes were seen."""
    from tickerlake.streaming import land as sland

    base = _landed_stream(spark, sf_dir, fixtures.item_json_lines(spark, sf_dir), max_records_per_file=1000)
    told = sland.read_metrics(spark, f"{base}/metrics")
    value = lambda *names: F.sum(F.when(F.col("reason").isin(*names), F.col("n"))).cast("long")
    return told.agg(
        value("accepted", "empty", "null", "no_id", "malformed").alias("events_in"),
        value("landed").alias("events_out"),
        (value("flushes") == 4).alias("every_batch_wrote"),
        (value("files") >= value("flushes")).alias("files_counted"),
        value("bytes").between(value("landed"), value("landed") * 400).alias("bytes_in_range"),
    )


def q_stream_ids(spark, sf_dir):
    """Items read by id from a store that grows between three runs of one checkpoint."""
    from tickerlake.sources.item_ids import ItemIds
    from tickerlake.streaming import land as sland

    spark.dataSource.register(ItemIds)
    base = scratch_path(spark, "stream-ids")
    for part in range(3):
        fixtures.append_item_store(spark, sf_dir, f"{base}/store", part, 3)
        stored = spark.readStream.format("item_ids").option("path", f"{base}/store").option("start", "earliest").load()
        q = sland.start_landing(
            spark, sland.items_from_json_strings(stored), f"{base}/lake", f"{base}/ckpt",
            source=QP.ITEM_SOURCE, ingested_ts=QP.INGEST_CLOCK_MS,
        )
        q.awaitTermination()
    return lake.read_events(spark, f"{base}/lake").select(*STREAM_COLS)


def q_stream_minute(spark, sf_dir):
    """Feed as JSON files -> watermarked 1-minute counts in update mode -> latest per window."""
    from tickerlake.schemas import EVENT_SCHEMA
    from tickerlake.streaming import minute as sminute

    base = scratch_path(spark, "stream-minute")
    lines = fixtures.event_json_lines(spark, sf_dir)
    files = fixtures.files_per_chunk(lines)
    fixtures.write_time_chunks(lines, f"{base}/in", chunks=4, files=files)
    events = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", str(files)).json(f"{base}/in/*")
    q = sminute.start_minute_counts(spark, events, f"{base}/out", f"{base}/ckpt", watermark="10 minutes")
    q.awaitTermination()
    return sminute.read_minute_counts(spark, f"{base}/out")


def registry() -> dict[str, Query]:
    names = [n for n in globals() if n.startswith("q_")]

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return fn(spark, sf_dir.rstrip("/"))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run

    return {n: wrap(globals()[n]) for n in sorted(names)}
