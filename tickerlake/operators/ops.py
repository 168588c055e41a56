"""Operational reports over the lake: counts, storage, freshness, volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Object-store price per GB-month used by the storage report.
PRICE_PER_GB_MONTH = 0.023


def partition_counts(events: DataFrame) -> DataFrame:
    """(source, dt, hr, n): rows per lake partition."""
    return events.groupBy("source", "dt", "hr").agg(F.count(F.lit(1)).alias("n"))


def storage_report(files: DataFrame, table: DataFrame, events_per_sec: float = 100.0) -> DataFrame:
    """Compressed bytes on disk, rows, bytes/row, GB/day and $/month at a rate.

    ``files`` (path, length) is a file listing such as ``lake.event_files``;
    the rows of ``table`` are counted without reading a column. One output
    row.
    """
    listed = files.agg(F.count(F.lit(1)).alias("files"), F.lit(0).cast("long").alias("rows"), F.sum("length").alias("bytes"))
    counted = table.agg(F.lit(0).cast("long").alias("files"), F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("bytes"))
    tot = listed.unionByName(counted).agg(
        F.sum("files").alias("files"),
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
    )
    per_row = F.when(F.col("rows") > 0, F.col("bytes") / F.col("rows")).otherwise(0.0)
    gb_day = per_row * F.lit(86400.0 * events_per_sec) / F.lit(1024.0**3)
    return tot.select(
        "files",
        "rows",
        "bytes",
        per_row.alias("bytes_per_row"),
        gb_day.alias("gb_per_day"),
        (gb_day * 30 * F.lit(PRICE_PER_GB_MONTH)).alias("usd_per_month"),
    )


def freshness(events: DataFrame, grain: str = "minute") -> DataFrame:
    """Ingest lag (ingested_ts - event_ts, seconds) per source and grain.

    (source, bucket, n, lag_p50, lag_p95, lag_max); percentiles are
    approximate (mergeable sketches, no sort of the group).
    """
    lag = (F.col("ingested_ts") - F.col("event_ts")) / 1000.0
    b = F.date_trunc(grain, F.col("event_at")).cast("timestamp_ntz")
    return events.groupBy("source", b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(lag, 0.5).alias("lag_p50"),
        F.percentile_approx(lag, 0.95).alias("lag_p95"),
        F.max(lag).alias("lag_max"),
    )


def rate_guard(events: DataFrame, budget_per_hour: int, drop_ratio: float = 0.5) -> DataFrame:
    """Hourly volume per source with alerts.

    (source, hour, n, prev_n, over_budget, dropped): ``dropped`` when the
    hour has at most ``drop_ratio`` of the previous active hour. The lag
    window is partitioned by source over hourly rows (24 per day), bounded
    by time, not by data volume.
    """
    hourly = events.groupBy("source", F.date_trunc("hour", F.col("event_at")).cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy("source").orderBy("hour")
    prev = F.lag("n").over(w)
    return hourly.select(
        "source",
        "hour",
        "n",
        prev.alias("prev_n"),
        (F.col("n") > F.lit(budget_per_hour)).alias("over_budget"),
        F.coalesce(F.col("n") <= prev * F.lit(drop_ratio), F.lit(False)).alias("dropped"),
    )


def pipeline_metrics(
    events: DataFrame,
    scored: DataFrame | None = None,
    items: DataFrame | None = None,
    item_source: str = "forum",
) -> DataFrame:
    """(name, source, reason, value) counters of a run, computed from the data.

    Names follow the pipeline stages: ``ingest.events_in`` and
    ``ingest.events_skipped`` (by reason) for raw items, ``sink.events_out``
    and ``sink.partitions`` per source for the landed events, and (with a
    scored table) ``score.events_out`` and ``score.with_tickers``.
    """
    from tickerlake.operators.ingest import reject_counts

    def counters(df: DataFrame, named: dict[str, str]) -> DataFrame:
        """One row per counter from one aggregate, so each table is read once."""
        each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("long").alias("value")) for n, c in named.items()])
        return df.select("source", F.explode(each).alias("c")).select("c.name", "source", F.lit(None).cast("string").alias("reason"), "c.value")

    ev = events.groupBy("source").agg(
        F.count(F.lit(1)).alias("events_out"),
        F.countDistinct("dt", "hr").alias("partitions"),
    )
    parts = [counters(ev, {"sink.events_out": "events_out", "sink.partitions": "partitions"})]
    if scored is not None:
        sc = scored.groupBy("source").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("tickers") > 0, True)).alias("t")
        )
        parts.append(counters(sc, {"score.events_out": "n", "score.with_tickers": "t"}))
    if items is not None:
        rc = reject_counts(items).rollup("reason").agg(F.sum("n").alias("n"), F.grouping("reason").alias("all"))
        everything = F.col("all") == 1
        parts.append(
            rc.filter(everything | (F.col("reason") != "accepted")).select(
                F.when(everything, "ingest.events_in").otherwise("ingest.events_skipped").alias("name"),
                F.lit(item_source).alias("source"),
                "reason",
                F.col("n").cast("long").alias("value"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compact(spark, root: str, since=None, until=None, before_commit=None) -> int:
    """Rewrite raw-lake partitions (dates ``since``..``until``) into few files each.

    Many micro-batches leave many small files per hour. The files that are
    there at the start are rewritten and replaced in one commit
    (``sources.snapshot``); what lands meanwhile stays as it is, a failure
    before the commit changes nothing, and one after it is completed by the
    next rewrite while readers already see the new files. Files of the id
    index are merged too. ``before_commit`` is called when the new files are
    written and nothing is committed yet. Returns the number of rows rewritten.
    """
    from tickerlake.sources import ids, lake

    n = lake.compact_events(spark, root, since, until, before_commit)
    if ids.is_sound(spark, root):
        ids.compact(spark, root)
    return n


def file_counts(table: DataFrame) -> DataFrame:
    """(source, dt, hr, files, rows) per partition, from row metadata."""
    return table.groupBy("source", "dt", "hr").agg(
        F.countDistinct(F.col("_metadata.file_path")).alias("files"), F.count(F.lit(1)).alias("rows")
    )
