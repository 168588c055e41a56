"""User-level jobs over a lake root: what the command line of a pipeline runs.

Each job reads lake tables, applies operators and either returns a lazy
DataFrame (views, reports) or writes a table and returns the row count.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake.functions.lexicon import lexicon_df
from tickerlake.operators import backtest, bars, features, signal
from tickerlake.operators.sentiment import score_events
from tickerlake.session import prepare_session
from tickerlake.sources import lake

HORIZON_MINUTES = 5  # of forward closes


def land(spark: SparkSession, events: DataFrame, root: str) -> int:
    """Idempotent batch landing of events (lake contract columns)."""
    prepare_session(spark)
    return lake.land_events(spark, events, root)


def score_lake(
    spark: SparkSession,
    root: str,
    lexicon: DataFrame | None = None,
    scored_ts: int | None = None,
    since=None,
    until=None,
) -> int:
    """Score raw events and rewrite the sentiment partitions they touch.

    ``since``/``until`` (dates, inclusive) limit the run to those raw
    partitions (pruned at the scan) for incremental scoring; only the
    matching sentiment partitions are replaced. Returns the number of
    events scored (0 on an empty lake or window).
    """
    prepare_session(spark)
    events = lake.read_events(spark, root, since=since, until=until)
    scored = score_events(events, lexicon if lexicon is not None else lexicon_df(spark), scored_ts)
    return lake.write_sentiment(spark, scored, root)


def select_prints(
    spark: SparkSession,
    root: str,
    prints: DataFrame,
    tickers: DataFrame | None = None,
    mentioned_only: bool = False,
    window_minutes: int | None = None,
    now_ms: int | None = None,
) -> DataFrame:
    """Prints restricted the way a bar build is scoped.

    ``tickers`` (a one-column ``ticker`` table, e.g. from
    ``features.universe``) or, with ``mentioned_only``, the tickers mentioned
    in the scored table (a default basket while there are none);
    ``window_minutes`` keeps a window of that length centred on the raw
    events' time range, or on ``now_ms`` (default: the clock) while there are
    no events (one scalar row is read back to build the filter, which then
    reaches the prints scan).
    """
    prepare_session(spark)
    if tickers is None and mentioned_only:
        tickers = features.mentioned_or_basket(lake.read_sentiment(spark, root))
    if tickers is not None:
        prints = features.restrict_to_universe(prints, tickers)
    if window_minutes is not None:
        b = features.event_bounds(lake.read_events(spark, root), window_minutes).first()
        now = int(datetime.now(UTC).timestamp() * 1000) if now_ms is None else now_ms
        anchor = b["anchor_ts"] if b["anchor_ts"] is not None else now - int(window_minutes) // 2 * 60_000
        start_us = int(anchor) * 1000
        end_us = start_us + int(window_minutes) * 60_000_000
        prints = prints.filter((prints["trade_us"] >= start_us) & (prints["trade_us"] < end_us))
    return prints


def write_bars(
    spark: SparkSession,
    root: str,
    prints: DataFrame,
    tickers: DataFrame | None = None,
    mentioned_only: bool = False,
    window_minutes: int | None = None,
    merge: bool = False,
    now_ms: int | None = None,
) -> int:
    """Resample trade prints to one-minute bars and write them.

    By default the touched (dt, hr) partitions are replaced (tickers not in
    this run disappear from them); ``merge=True`` upserts by (ticker, ts)
    instead. Returns the number of rows written.
    """
    selected = select_prints(spark, root, prints, tickers, mentioned_only, window_minutes, now_ms)
    new_bars = bars.resample_prints(selected)
    if merge:
        return lake.merge_market(spark, new_bars, root)
    return lake.write_market(new_bars, root)


def summarize(spark: SparkSession, root: str, limit: int | None = None, since=None, until=None) -> DataFrame:
    """Per-source, per-minute event counts, newest first."""
    prepare_session(spark)
    return features.latest_minute_counts(lake.read_events(spark, root, since, until), limit)


def ticker_view(spark: SparkSession, root: str, grain: str = "minute", limit: int | None = None, since=None, until=None) -> DataFrame:
    """Mentions and mean compound per ticker and grain, newest first."""
    prepare_session(spark)
    return features.latest_per_ticker(lake.read_sentiment(spark, root, since, until), grain, limit)


def _minutes_before(spark: SparkSession, root: str, hour, stored_upto=None) -> DataFrame:
    """Per ticker its last 59 active minutes before ``hour``.

    Read from the newest stored frames and the hours since; without stored
    frames from the whole table before ``hour``.
    """
    asof, stored = lake.read_frames(spark, root, stored_upto or hour)
    scored = lake.read_sentiment(spark, root, since=asof, until=_hour_before(hour))
    return signal.last_minutes(stored.unionByName(signal.per_minute(scored)))


def _hour_before(hour) -> str:
    return (datetime.strptime("T".join(lake.hour_of(hour)), "%Y-%m-%dT%H") - timedelta(hours=1)).strftime("%Y-%m-%dT%H")


def save_frames(spark: SparkSession, root: str, asof) -> None:
    """Store what signals from the hour (or date) ``asof`` on need of the time before it.

    Rests on the frames stored before, so a daily run reads a day. Scoring
    again what lies before ``asof`` removes the frames; they are then saved anew.
    """
    prepare_session(spark)
    lake.write_frames(spark, _minutes_before(spark, root, asof, _hour_before(asof)), root, asof)


def signal_view(spark: SparkSession, root: str, limit: int | None = None, frame: str = "rows", since=None, until=None) -> DataFrame:
    """Signal over the scored table and the bars (closes are NULL without bars).

    ``since``/``until`` (dates, or hours such as ``2024-01-01T06``, inclusive)
    prune both tables at the scan and leave the values as they are: frames
    reach back into the minutes before ``since`` (``save_frames`` keeps that
    cheap), and bars are read five minutes past ``until``.
    """
    prepare_session(spark)
    scored = lake.read_sentiment(spark, root, since, until)
    context = None if since is None else _minutes_before(spark, root, since)
    if until is None:
        closes = lake.read_market(spark, root, since)
    else:
        day, hour = lake.hour_of(until, last=True)
        end = datetime.strptime(f"{day}T{hour}", "%Y-%m-%dT%H") + timedelta(hours=1)
        closes = lake.read_market(spark, root, since, end.strftime("%Y-%m-%dT%H"))
        closes = closes.where(F.col("ts") < int(end.replace(tzinfo=UTC).timestamp() * 1000) + HORIZON_MINUTES * 60_000)
    return signal.build_signal(scored, closes, limit=limit, frame=frame, context=context)


def backtest_report(spark: SparkSession, root: str, limit: int | None = None, since=None, until=None) -> DataFrame:
    """One-row backtest summary over the signal (all rows, or the newest ``limit``)."""
    return backtest.summary(signal_view(spark, root, limit=limit, since=since, until=until))


def store_backtest(spark: SparkSession, root: str, since=None, until=None) -> int:
    """Store the backtest pieces of the window's hours, replacing those hours; returns the hours stored.

    A daily run over its own day adds that day's pieces. Bars must reach five
    minutes past ``until``.
    """
    parts = backtest.pieces(signal_view(spark, root, since=since, until=until))
    return lake.write_pieces(parts, root)


def stored_backtest(spark: SparkSession, root: str, since=None, until=None) -> DataFrame:
    """The one-row summary of the stored pieces; no signal is computed."""
    prepare_session(spark)
    return backtest.figures(backtest.merged(lake.read_pieces(spark, root, since, until)))


def market_anchor(spark: SparkSession, root: str, minutes: int = 120) -> DataFrame:
    """Data bounds of the raw lake and a window start centred on them."""
    prepare_session(spark)
    return features.event_bounds(lake.read_events(spark, root), minutes)


def mentioned_tickers(spark: SparkSession, root: str) -> DataFrame:
    prepare_session(spark)
    return features.distinct_tickers(lake.read_sentiment(spark, root))
