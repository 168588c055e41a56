"""Feature views over the lake: counts per minute, mentions per ticker.

Each function takes the lake tables as DataFrames (``read_events`` /
``read_sentiment`` output, or anything with the same columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerlake.functions.tickers import DEFAULT_BASKET, extract_tickers, normalise_symbols, unknown_symbols
from tickerlake.functions.timecols import bucket, truncate
from tickerlake.plans.sizing import bounded_broadcast


def minute_counts(events: DataFrame) -> DataFrame:
    """(source, minute, n): events per source and UTC minute."""
    return events.groupBy("source", truncate("minute", F.col("event_at")).alias("minute")).agg(
        F.count(F.lit(1)).alias("n")
    )


def latest_minute_counts(events: DataFrame, limit: int | None = 50) -> DataFrame:
    """Newest minutes first, then source; the reference report keeps 50 rows."""
    out = minute_counts(events).orderBy(F.col("minute").desc(), F.col("source").asc_nulls_last())
    return out.limit(limit) if limit else out


def mentions(sentiment: DataFrame) -> DataFrame:
    """One row per (scored event, ticker); events without tickers vanish."""
    return sentiment.select(
        F.explode("tickers").alias("ticker"), "event_at", "compound", "source", "event_id", "event_ts"
    )


def per_ticker(sentiment: DataFrame, grain: str = "minute") -> DataFrame:
    """(ticker, bucket, mentions, avg_compound DECIMAL(6,3)) per ticker and grain.

    ``grain`` is a date_trunc unit ('minute', 'hour', 'day', ...) or
    'N minutes'. Map-side partial aggregation keeps hot tickers from skewing.
    """
    m = mentions(sentiment)
    return m.groupBy("ticker", bucket(grain, F.col("event_at")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("mentions"),
        F.avg("compound").cast("decimal(6,3)").alias("avg_compound"),
    )


def latest_per_ticker(sentiment: DataFrame, grain: str = "minute", limit: int | None = 50) -> DataFrame:
    out = per_ticker(sentiment, grain).orderBy(
        F.col("bucket").desc(), F.col("mentions").desc(), F.col("ticker").asc_nulls_last()
    )
    return out.limit(limit) if limit else out


def distinct_tickers(sentiment: DataFrame) -> DataFrame:
    """Tickers mentioned anywhere in the scored table."""
    return sentiment.select(F.explode("tickers").alias("ticker")).distinct()


def mentioned_or_basket(sentiment: DataFrame) -> DataFrame:
    """Tickers mentioned in the scored table; the default basket while there are none."""
    mentioned = distinct_tickers(sentiment)
    basket = sentiment.sparkSession.createDataFrame([(t,) for t in DEFAULT_BASKET], "ticker string")
    any_ = mentioned.limit(1).select(F.lit(True).alias("_any"))
    return mentioned.unionByName(basket.join(any_, F.lit(True), "left_anti"))


def event_bounds(events: DataFrame, minutes: int = 120) -> DataFrame:
    """(min_ts, max_ts, anchor_ts): data bounds and a bar-window start.

    The anchor centres a ``minutes``-long window on the data. One row; NULLs
    on an empty table.
    """
    b = events.agg(F.min("event_ts").alias("min_ts"), F.max("event_ts").alias("max_ts"))
    centre = F.expr("(min_ts + max_ts) div 2")
    return b.select("min_ts", "max_ts", (centre - F.lit((minutes // 2) * 60_000)).alias("anchor_ts"))


def universe(symbols_df: DataFrame, column: str = "symbols") -> DataFrame:
    """Normalise user symbol lists (comma-separated strings) into a ticker table."""
    return symbols_df.select(F.explode(normalise_symbols(F.col(column))).alias("ticker")).distinct()


def restrict_to_universe(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """Keep rows of ``df`` whose ``ticker`` is in ``tickers`` (semi join).

    The symbol table is broadcast when its size estimate is small, otherwise
    the planner shuffles both sides.
    """
    return df.join(bounded_broadcast(tickers.select("ticker")), "ticker", "left_semi")


def ticker_lists(events: DataFrame) -> DataFrame:
    """(source, event_id, tickers) for every event; the extractor as a table."""
    return events.select("source", "event_id", extract_tickers(F.col("text")).alias("tickers"))


def unknown_symbol_counts(events: DataFrame) -> DataFrame:
    """(symbol, n): cashtag-shaped symbols outside the known list, per event once."""
    return (
        events.select(F.explode(unknown_symbols(F.col("text"))).alias("symbol"))
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("n"))
    )
