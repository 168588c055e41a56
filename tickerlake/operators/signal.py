"""Composite signal: mention z-score x sentiment shift, joined to bar closes.

Per ticker and active minute (minutes with at least one mention):

* m5  = sum of mentions over the last 5 active minutes (rows frame)
* s5  = mean of the minute sentiment means over the last 5 active minutes
* m60_mean / m60_sd = mean / population sd of mentions over the last 60
  active minutes; s60 the sentiment mean over them
* z = 0 when m60_sd is NULL or 0, else (m5 - m60_mean) / m60_sd
* sentiment_shift = coalesce(s5 - s60, 0); composite = z x shift
* position long if composite > 1, short if < -1, else flat (unrounded)

Frames count active-minute rows, not clock minutes; ``frame="range"`` gives
true 5- and 60-minute clock windows instead.

Scale: the window is not partitioned by ticker alone (that would put a
ticker's whole history in one task and cap parallelism at the number of
tickers). Each ticker's rows are numbered, cut into blocks of
``block_rows``, and every block gets a copy of the 59 rows before it, so
each window partition is bounded and the frames stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerlake.functions.timecols import truncate
from tickerlake.operators.bars import bar_closes, forward_return
from tickerlake.plans.windows import BLK, CTX, DEFAULT_BLOCK_ROWS, IDX, blocked_range, blocked_rows, finish

SHORT_ROWS = 5
LONG_ROWS = 60


def per_minute(sentiment: DataFrame) -> DataFrame:
    """(ticker, bucket, mentions, avg_sentiment) from scored events."""
    return (
        sentiment.select(
            F.explode("tickers").alias("ticker"),
            truncate("minute", F.col("event_at")).alias("bucket"),
            "compound",
        )
        .groupBy("ticker", "bucket")
        .agg(F.count(F.lit(1)).alias("mentions"), F.avg("compound").alias("avg_sentiment"))
    )


def last_minutes(pm: DataFrame, n: int = LONG_ROWS - 1) -> DataFrame:
    """Per ticker its last ``n`` active minutes: all that later frames can reach back to.

    The limit is applied before the shuffle too, so a task gets at most ``n``
    rows of a ticker from each task before it.
    """
    newest = Window.partitionBy("ticker").orderBy(F.col("bucket").desc())
    return pm.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def _rolled_columns(w_short: Window, w_long: Window) -> list[Column]:
    return [
        F.sum("mentions").over(w_short).alias("m5"),
        F.avg("avg_sentiment").over(w_short).alias("s5"),
        F.avg("mentions").over(w_long).alias("m60_mean"),
        F.stddev_pop("mentions").over(w_long).alias("m60_sd"),
        F.avg("avg_sentiment").over(w_long).alias("s60"),
    ]


def rolling(
    pm: DataFrame,
    frame: str = "rows",
    block_rows: int = DEFAULT_BLOCK_ROWS,
    short_rows: int = SHORT_ROWS,
    long_rows: int = LONG_ROWS,
) -> DataFrame:
    """Per-minute table + m5, s5, m60_mean, m60_sd, s60.

    ``frame="rows"`` (default, reference semantics) counts active minutes;
    ``frame="range"`` uses clock minutes. Windows are cut into
    blocks, of ``block_rows`` rows or of a day.
    """
    if frame == "range":
        minute_no = F.expr("unix_seconds(CAST(bucket AS TIMESTAMP)) div 60")
        x = pm.withColumn("_min", minute_no)
        spread, base = blocked_range(x, "ticker", "_min", long_rows - 1)
        w_s = base.rangeBetween(-(short_rows - 1), 0)
        w_l = base.rangeBetween(-(long_rows - 1), 0)
        return spread.select(*pm.columns, CTX, *_rolled_columns(w_s, w_l)).where(~F.col(CTX)).drop(CTX)
    if frame != "rows":
        raise ValueError("frame must be 'rows' or 'range'")

    spread, base = blocked_rows(pm, "ticker", "bucket", long_rows - 1, block_rows)
    rolled = spread.select(
        *pm.columns,
        CTX,
        BLK,
        IDX,
        *_rolled_columns(base.rowsBetween(-(short_rows - 1), 0), base.rowsBetween(-(long_rows - 1), 0)),
    )
    return finish(rolled)


def score(rolled: DataFrame, on_overflow: str = "raise") -> DataFrame:
    """(ticker, bucket, z_mentions, sentiment_shift, composite, position).

    Decimals are DECIMAL(8,3); the position uses the unrounded product.
    """
    z = F.when(F.coalesce(F.col("m60_sd"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(
        (F.col("m5") - F.col("m60_mean")) / F.col("m60_sd")
    )
    shift = F.coalesce(F.col("s5") - F.col("s60"), F.lit(0.0))
    product = z * shift

    def dec(c: Column) -> Column:
        return c.try_cast("decimal(8,3)") if on_overflow == "null" else c.cast("decimal(8,3)")

    return rolled.select(
        "ticker",
        "bucket",
        dec(z).alias("z_mentions"),
        dec(shift).alias("sentiment_shift"),
        dec(product).alias("composite"),
        F.when(product > 1, "long").when(product < -1, "short").otherwise("flat").alias("position"),
    )


def build_signal(
    sentiment: DataFrame,
    bars: DataFrame,
    limit: int | None = None,
    frame: str = "rows",
    block_rows: int = DEFAULT_BLOCK_ROWS,
    on_overflow: str = "raise",
    context: DataFrame | None = None,
) -> DataFrame:
    """The 9-column signal table.

    ``limit`` keeps the newest rows (bucket desc, |composite| desc, ticker);
    by default every row is returned. ``context`` holds minutes before those
    of ``sentiment`` (``last_minutes``); frames reach into them, but they give
    no rows of their own.
    """
    pm = per_minute(sentiment)
    if context is not None:
        pm = pm.withColumn("_own", F.lit(True)).unionByName(context.select("ticker", "bucket", "mentions", "avg_sentiment").withColumn("_own", F.lit(False)))
    rolled = rolling(pm, frame=frame, block_rows=block_rows)
    scored = score(rolled if context is None else rolled.where("_own"), on_overflow)
    closes = bar_closes(bars)
    joined = scored.join(closes, ["ticker", "bucket"], "left").select(
        "ticker",
        "bucket",
        "z_mentions",
        "sentiment_shift",
        "composite",
        "position",
        "close_now",
        F.col("close_fwd").alias("close_fwd_5m"),
        forward_return(F.col("close_now"), F.col("close_fwd"), on_overflow).alias("fwd_ret_5m"),
    )
    if limit is None:
        return joined
    return top_signals(joined, limit)


def top_signals(signal: DataFrame, limit: int = 100) -> DataFrame:
    """Newest first, strongest first within a minute, then ticker (top-N)."""
    return signal.orderBy(
        F.col("bucket").desc(), F.abs(F.col("composite")).desc(), F.col("ticker").asc_nulls_last()
    ).limit(limit)


def position_mix(signal: DataFrame) -> DataFrame:
    """(position, n) counts over a signal table."""
    return signal.groupBy("position").agg(F.count(F.lit(1)).alias("n"))
