"""Command line over the jobs: ``python -m tickerlake <command> --lake ROOT ...``.

Each command runs one job on the session from ``spark-submit`` (or a local
one) and shows or writes its result. Reports print at most ``--show`` rows;
the underlying DataFrames are complete.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    """The launcher's session as it is; a program of its own gets Spark's defaults."""
    from tickerlake.session import prepare_session

    return prepare_session(SparkSession.builder.appName("tickerlake").getOrCreate())


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tickerlake")
    sub = p.add_subparsers(dest="cmd", required=True)

    def cmd(name: str, help_: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help_)
        c.add_argument("--lake", required=True, help="lake root (any Hadoop file system URI)")
        c.add_argument("--show", type=int, default=50, help="rows to print")
        c.add_argument("--since", default=None, help="first date, or hour such as 2024-01-01T06")
        c.add_argument("--until", default=None, help="last date or hour")
        return c

    c = cmd("ingest", "land JSON item files with a streaming job")
    c.add_argument("--items", required=True)
    c.add_argument("--checkpoint", required=True)
    c.add_argument("--source", default="forum")
    c.add_argument("--duration", type=float, default=None, help="stop after so many seconds")
    c.add_argument("--metrics", default=None, help="folder for reject reasons per batch")
    c.add_argument("--every", default=None, help="processing-time trigger, e.g. '30 seconds'; default: drain and stop")
    c.add_argument("--max-files", type=int, default=None, help="files read per batch")
    c.add_argument("--max-bytes", default=None, help="bytes read per batch, e.g. 128m")
    c.add_argument("--max-rows-per-file", type=int, default=None, help="rows per file written")
    c.add_argument("--file-bytes", type=int, default=None, help="file size to aim at, before compression")
    c = cmd("replay", "repair quarantined lines and land them, each once")
    c.add_argument("--repair", required=True, help="SQL expression over line, e.g. \"concat(line, '}')\"")
    c.add_argument("--run", required=True, help="name of this replay")
    c.add_argument("--source", default="forum")
    c = cmd("frames", "store the minutes that signals from an hour on reach back to")
    c.add_argument("--asof", required=True, help="date or hour, e.g. 2024-01-01T06")
    c = cmd("compact", "rewrite raw partitions into few files; landing may go on")
    cmd("query", "events per source and minute, newest first")
    cmd("score", "score raw events into the sentiment table")
    c = cmd("tickers", "mentions and mean sentiment per ticker and grain")
    c.add_argument("--grain", default="minute")
    c = cmd("market", "resample trade prints (Parquet) into one-minute bars")
    c.add_argument("--prints", required=True, help="Parquet with ticker, trade_us, trade_id, price, qty")
    c.add_argument("--tickers", default="", help="comma-separated symbols; default: tickers mentioned in the lake")
    c.add_argument("--minutes", type=int, default=None, help="window length centred on the events")
    c.add_argument("--merge", action="store_true", help="upsert by (ticker, ts) instead of replacing hours")
    c = cmd("signal", "composite signal joined to bar closes")
    c.add_argument("--limit", type=int, default=0, help="newest rows to keep; 0 = all")
    c.add_argument("--out", default=None, help="write the signal as Parquet here instead of printing")
    c = cmd("report", "backtest summary and storage report")
    c.add_argument("--limit", type=int, default=0, help="newest signal rows to test; 0 = all")
    c.add_argument("--store", action="store_true", help="store the window's hours and report over all stored hours")
    cmd("metrics", "pipeline counters computed from the lake")

    a = p.parse_args(argv)
    spark = _session()
    from tickerlake.operators import features, ops
    from tickerlake.plans import jobs
    from tickerlake.sources import lake

    if a.cmd == "ingest":
        from tickerlake.streaming.land import start_landing

        trig = {"processingTime": a.every} if a.every else None
        q = start_landing(
            spark, a.items, a.lake, a.checkpoint, source=a.source, trigger=trig, metrics_path=a.metrics,
            max_files_per_trigger=a.max_files, max_bytes_per_trigger=a.max_bytes,
            max_records_per_file=a.max_rows_per_file, target_file_bytes=a.file_bytes,
        )
        if a.duration is None:
            q.awaitTermination()
        elif not q.awaitTermination(a.duration):
            q.stop()
    elif a.cmd == "replay":
        from pyspark.sql import functions as F

        from tickerlake.streaming.land import replay

        print(f"landed {replay(spark, a.lake, F.expr(a.repair), a.run, source=a.source)} repaired events")
    elif a.cmd == "frames":
        jobs.save_frames(spark, a.lake, a.asof)
    elif a.cmd == "compact":
        print(f"rewrote {ops.compact(spark, a.lake, a.since, a.until)} events")
    elif a.cmd == "query":
        jobs.summarize(spark, a.lake, since=a.since, until=a.until).show(a.show, truncate=False)
    elif a.cmd == "score":
        print(f"scored {jobs.score_lake(spark, a.lake, since=a.since, until=a.until)} events")
    elif a.cmd == "tickers":
        jobs.ticker_view(spark, a.lake, a.grain, since=a.since, until=a.until).show(a.show, truncate=False)
    elif a.cmd == "market":
        prints = spark.read.parquet(a.prints)
        tickers = None
        if a.tickers.strip():
            from pyspark.sql import functions as F

            tickers = features.universe(spark.range(1).select(F.lit(a.tickers).alias("symbols")))
        n = jobs.write_bars(
            spark, a.lake, prints, tickers=tickers, mentioned_only=tickers is None,
            window_minutes=a.minutes, merge=a.merge,
        )
        print(f"wrote {n} bars")
    elif a.cmd == "signal":
        sig = jobs.signal_view(spark, a.lake, limit=a.limit or None, since=a.since, until=a.until)
        if a.out:
            sig.write.mode("overwrite").parquet(a.out)
        else:
            sig.show(a.show, truncate=False)
    elif a.cmd == "report":
        if a.store:
            print(f"stored {jobs.store_backtest(spark, a.lake, a.since, a.until)} hours")
            jobs.stored_backtest(spark, a.lake).show(truncate=False)
        else:
            jobs.backtest_report(spark, a.lake, limit=a.limit or None, since=a.since, until=a.until).show(truncate=False)
        ops.storage_report(lake.event_files(spark, a.lake), lake.read_events(spark, a.lake)).show(truncate=False)
    elif a.cmd == "metrics":
        ops.pipeline_metrics(lake.read_events(spark, a.lake), lake.read_sentiment(spark, a.lake)).show(
            a.show, truncate=False
        )
    return 0


if __name__ == "__main__":
    sys.exit(main())
