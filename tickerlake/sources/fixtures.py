"""Input views derived from the supplied test tables.

Every view is a projection of ``events``, one row to a row, so its size grows
with the data; the texts of posts and items are templated phrases. Time is compressed 60-fold (30 days -> 12
hours) so that one-minute buckets are dense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# 2024-01-01T00:00:00Z, the start of the supplied events table.
EPOCH_MS = 1704067200000
EPOCH_US = EPOCH_MS * 1000


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# Post texts: a few fixed cases for the extractor, the rest templated phrases.
_TEXT_SQL = """
CASE event_id % 100
  WHEN 0 THEN NULL WHEN 1 THEN ''
  WHEN 2 THEN 'quiet session, nobody named a company'
  WHEN 3 THEN 'IT IS ON NOW OR SO THEY ALL SAY'
  WHEN 4 THEN '$QQZZ is not a listing'
  WHEN 5 THEN '$ORCL opened first, then AMD, and ORCL closed last'
  WHEN 6 THEN 'INTC before $CSCO'
  WHEN 7 THEN '$F rose with the F-150; $CSCOX INTC_Y AMD3'
  ELSE concat('$', CASE user_id % 4 WHEN 0 THEN 'INTC' WHEN 1 THEN 'CSCO' WHEN 2 THEN 'ORCL' ELSE 'AMD' END, ' ',
       CASE event_id % 9 WHEN 0 THEN 'posted a very strong quarter!' WHEN 1 THEN 'was not good at all'
            WHEN 2 THEN 'had gains, but the outlook is poor' WHEN 3 THEN 'is AMAZING and may rally'
            WHEN 4 THEN 'looks slightly weak' WHEN 5 THEN 'suffered a crash!!' WHEN 6 THEN 'filed its numbers'
            WHEN 7 THEN 'is hardly a scam' ELSE 'gave a disappointing but confident call' END, ' (thread)')
END
"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social posts in the events-lake shape; ``text`` may be NULL here."""
    ev = events_table(spark, sf_dir).select("event_id", "ts", "user_id")
    event_ts = F.expr(f"{EPOCH_MS} + ((unix_micros(CAST(ts AS TIMESTAMP)) - {EPOCH_US}) div 60) div 1000")
    return ev.select(
        F.expr("CASE WHEN event_id % 5 = 0 THEN 'forum' ELSE 'synth' END").alias("source"),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("event_id"),
        event_ts.alias("event_ts"),
        (event_ts + (F.col("event_id") % 30) * 1000).alias("ingested_ts"),
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("author"),
        F.expr(_TEXT_SQL).alias("text"),
        F.lit(None).cast("string").alias("url"),
    )


def landing_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feed`` with NULL text made "" so it satisfies the lake contract."""
    return feed(spark, sf_dir).withColumn("text", F.coalesce(F.col("text"), F.lit("")))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade prints: (ticker, trade_us, trade_id, price, qty).

    ``price = 100 + value / 50`` keeps returns inside DECIMAL(8,5).
    """
    ev = events_table(spark, sf_dir).select("event_id", "ts", "user_id", "value")
    return ev.select(
        F.expr("CASE user_id % 4 WHEN 0 THEN 'INTC' WHEN 1 THEN 'CSCO' WHEN 2 THEN 'ORCL' ELSE 'AMD' END").alias(
            "ticker"
        ),
        F.expr(f"{EPOCH_US} + ((unix_micros(CAST(ts AS TIMESTAMP)) - {EPOCH_US}) div 60)").alias("trade_us"),
        F.col("event_id").alias("trade_id"),
        (F.lit(100.0) + F.col("value") / 50).alias("price"),
        (F.lit(1) + F.col("event_id") % 10).alias("qty"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw upstream items, one nullable ``item`` struct per row.

    Covers: title only, text only, empty title with text, both, neither,
    deleted, dead, whole item null, missing time, missing author.
    """
    ev = events_table(spark, sf_dir).select("event_id", "ts", "user_id")
    event_ts = F.expr(f"{EPOCH_MS} + ((unix_micros(CAST(ts AS TIMESTAMP)) - {EPOCH_US}) div 60) div 1000")
    f = ev.select(
        F.col("event_id").alias("id"),
        event_ts.alias("event_ts"),
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("author"),
        F.expr(_TEXT_SQL).alias("text"),
    )
    k = F.col("id")
    title = (
        F.when(k % 4 == 0, F.col("text"))
        .when(k % 4 == 1, F.lit(""))
        .when(k % 4 == 2, F.lit(None).cast("string"))
        .otherwise(F.col("text"))
    )
    body = (
        F.when(k % 4 == 0, F.lit(None).cast("string"))
        .when(k % 4 == 3, F.lit("see thread"))
        .otherwise(F.col("text"))
    )
    item = F.struct(
        k.alias("id"),
        F.when(k % 19 == 0, F.lit(None).cast("long")).otherwise(F.expr("event_ts div 1000")).alias("time"),
        F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("author")).alias("by"),
        title.alias("title"),
        body.alias("text"),
        F.when(k % 3 == 0, F.concat(F.lit("https://example.org/item/"), k.cast("string"))).alias("url"),
        (k % 11 == 0).alias("deleted"),
        (k % 13 == 0).alias("dead"),
    )
    return f.select(
        k.alias("item_key"), "event_ts", F.when(k % 17 == 0, F.lit(None)).otherwise(item).alias("item")
    )


def item_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_ts, value): the items as JSON lines; a missing item is the line ``null``."""
    it = items(spark, sf_dir)
    line = F.when(F.col("item").isNull(), F.lit("null")).otherwise(F.to_json(F.col("item")))
    return it.select("event_ts", line.alias("value"))


def broken_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_json_lines`` in which every tenth item has lost its last character."""
    it = items(spark, sf_dir)
    whole = F.to_json(F.col("item"))
    cut = F.col("item_key") % 10 == 0
    line = F.when(F.col("item").isNull(), F.lit("null")).when(cut, F.expr("substring(to_json(item), 1, length(to_json(item)) - 1)")).otherwise(whole)
    return it.select("event_ts", line.alias("value"))


STORE_GROUP_BYTES = 8 << 20


def append_item_store(spark: SparkSession, sf_dir: str, path: str, part: int, parts: int) -> None:
    """The items (id, value) whose number lies in one of ``parts`` equal ranges, as Parquet in their order."""
    it = items(spark, sf_dir)
    value = F.when(F.col("item").isNull(), F.lit("null")).otherwise(F.to_json(F.col("item")))
    top = it.agg(F.max("item_key")).first()[0] + 1
    own = F.col("item_key").between(top * part // parts, top * (part + 1) // parts - 1)
    rows = it.filter(own).select(F.col("item_key").alias("id"), value.alias("value"))
    # in order, as upstream numbers them, and in small row groups: a range of ids lies in few of them
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    rows.write.mode("append").option("parquet.block.size", str(STORE_GROUP_BYTES)).parquet(path)


def event_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_ts, value): the landing feed as JSON lines (lake contract fields)."""
    f = landing_feed(spark, sf_dir)
    return f.select("event_ts", F.to_json(F.struct(*f.columns)).alias("value"))


FILE_ROWS = 100_000  # lines of a file, about


def files_per_chunk(lines: DataFrame, chunks: int = 4) -> int:
    """Files that a chunk of ``lines`` is written as: what a file stream takes at a time to read chunk by chunk."""
    return max(1, -(-lines.count() // (chunks * FILE_ROWS)))


def write_time_chunks(lines: DataFrame, path: str, chunks: int = 4, files: int = 1) -> list[str]:
    """Write JSON lines as ``chunks`` folders of ``files`` files in event-time order, one job each.

    Files written later have later modification times, so a file stream
    with ``maxFilesPerTrigger=files`` reads a chunk at a time, in time order,
    like a feed arriving over time, however many splits the lines come in.
    Returns the written folders.
    """
    b = lines.agg(F.min("event_ts").alias("lo"), F.max("event_ts").alias("hi")).first()
    if b is None or b["lo"] is None:
        return []
    lo, hi = int(b["lo"]), int(b["hi"]) + 1
    step = max(1, -(-(hi - lo) // chunks))
    out = []
    for k in range(chunks):
        a, z = lo + k * step, min(hi, lo + (k + 1) * step)
        part = f"{path}/chunk={k:04d}"
        own = lines.filter((F.col("event_ts") >= a) & (F.col("event_ts") < z))
        # the time is in the hash so that equal lines (null) do not fill one file
        own.repartition(files, "event_ts", "value").select("value").write.mode("overwrite").text(part)
        out.append(part)
    return out
