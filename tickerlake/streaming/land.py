"""Structured Streaming landing: JSON item files -> normalised events -> lake.

The upstream poller of the original design is replaced by a file source
(anything that drops JSON lines into a folder, or Kafka with the same
parsing); the cursor is the streaming checkpoint, so a restart resumes
where it stopped instead of skipping ahead.

Every micro-batch is landed with ``lake.land_events`` (dedup on
(source, event_id) + anti-join with the lake's ids), so a batch
that is replayed after a failure adds nothing, also when the failure came
after some or all of its events were written. Reject reasons and what the
batch wrote are counted by the run itself and kept in a small metrics table
(one folder per batch id, overwritten on replay).

Lines that are no JSON object go to a quarantine table under
``{root}/derived/quarantine``, known by (file, hash of the line). ``replay``
repairs and lands them, each line once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake.functions.tables import empty_table
from tickerlake.operators.ingest import normalise_items, reject_counts
from tickerlake.schemas import ITEM_SCHEMA
from tickerlake.session import scratch_path
from tickerlake.sources import lake
from tickerlake.sources.files import Folder

CORRUPT = "_corrupt_record"
_ADAPTIVE = "spark.sql.adaptive.enabled"
RAW_ITEM_SCHEMA = T.StructType(ITEM_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType(), True)])


def items_from_json(raw: DataFrame, file: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows of the JSON reader -> (item struct or NULL, parse_error flag, line, file).

    A JSON ``null`` line means "no item"; any other unparsable line is
    flagged as a parse error (reason "malformed") and kept in ``line``.
    """
    fields = [F.col(f.name) for f in ITEM_SCHEMA.fields]
    bad = F.col(CORRUPT)
    malformed = bad.isNotNull() & (F.trim(bad) != "null")
    return raw.select(
        F.when(bad.isNull(), F.struct(*fields)).alias("item"),
        malformed.alias("parse_error"),
        F.when(malformed, bad).alias("line"),
        (F.lit("stream") if file is None else file).alias("file"),
        *(keep or []),
    )


def read_item_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, max_bytes_per_trigger: str | None = None
) -> DataFrame:
    reader = spark.readStream.schema(RAW_ITEM_SCHEMA).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    return items_from_json(reader.json(path).select("*", "_metadata.file_path"), F.col("file_path"))


def items_from_json_strings(df: DataFrame, col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Items from a column of JSON strings (e.g. a Kafka ``value`` cast to string).

    Same result shape as ``read_item_stream``; works on streaming and batch
    frames, so any message source can feed ``start_landing``. Columns named in
    ``keep`` come along (none of them may be named like a field of an item).
    """
    keep = keep or []
    parsed = F.from_json(
        F.col(col), RAW_ITEM_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    raw = df.select(*keep, parsed.alias("_p")).select(*keep, "_p.*")
    # from_json gives a NULL struct for the literal line "null"
    fixed = raw.withColumn(
        CORRUPT, F.when(F.col("id").isNull() & F.col(CORRUPT).isNull(), F.lit("null")).otherwise(F.col(CORRUPT))
    )
    return items_from_json(fixed, F.col("file") if "file" in keep else None, [c for c in keep if c != "file"])


def read_item_batch(spark: SparkSession, path: str) -> DataFrame:
    """Batch twin of ``read_item_stream``."""
    raw = spark.read.schema(RAW_ITEM_SCHEMA).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT
    ).json(path)
    return items_from_json(raw)


def batch_reasons(items: DataFrame) -> DataFrame:
    """(reason, n) for one batch: malformed lines plus the item reject reasons."""
    malformed = items.filter(F.col("parse_error")).groupBy(F.lit("malformed").alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return reject_counts(items.filter(~F.col("parse_error"))).unionByName(malformed)


QUARANTINE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line_hash", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
_LINE_KEY = ["file", "line_hash"]


def quarantine_root(root: str) -> str:
    return f"{root.rstrip('/')}/derived/quarantine"


def _batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    folder = Folder(spark, path)
    if not any("=" in n for n in folder.names()):
        return empty_table(spark, schema)
    return spark.read.schema(schema).parquet(path)


def quarantine(items: DataFrame, root: str, batch_id: int) -> None:
    """Keep a batch's malformed lines; a replayed batch writes the same folder again."""
    lines = items.filter(F.col("parse_error")).select("file", F.sha2("line", 256).alias("line_hash"), "line")
    counted = lines.groupBy("file", "line_hash", "line").agg(F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").parquet(f"{quarantine_root(root)}/batch_id={batch_id}")


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """Malformed lines that wait: (file, line_hash, line, n), without those replayed."""
    held = _batches(spark, quarantine_root(root), QUARANTINE)
    once = held.groupBy(*_LINE_KEY, "line").agg(F.sum("n").alias("n"))
    done = _batches(spark, f"{root.rstrip('/')}/derived/replayed", T.StructType([*QUARANTINE.fields[:2], T.StructField("run", T.StringType())]))
    return once.join(done.select(*_LINE_KEY), _LINE_KEY, "left_anti")


def replay(spark: SparkSession, root: str, repair: Column, run: str, source: str = "forum", ingested_ts: int | None = None) -> int:
    """Land the waiting lines that ``repair`` (an expression over ``line``) turns into items.

    Lines that are still malformed, or are no item, keep waiting. Landing comes
    first and the note that a line was replayed second: a run that dies in
    between lands nothing twice, since landing knows the ids. ``run`` names
    the note. Returns the events landed.

    What waits is read once and stored outside the lake (``scratch_path``): a
    write to the lake makes Spark compute again what it has cached from files
    below that path, and lines quarantined meanwhile would be noted unlanded.
    """
    held = read_quarantine(spark, root).withColumn("_repaired", repair)
    taken = scratch_path(spark, "replay")
    held.write.parquet(taken)
    try:
        waiting = spark.read.schema(held.schema).parquet(taken)
        parsed = items_from_json_strings(waiting, "_repaired", keep=_LINE_KEY).filter(~F.col("parse_error"))
        n = lake.land_events(spark, normalise_items(parsed, source, ingested_ts), root)
        parsed.select(*_LINE_KEY).distinct().write.mode("overwrite").parquet(f"{root.rstrip('/')}/derived/replayed/run={run}")
        return n
    finally:
        Folder(spark, taken).delete()


def _rows_per_file(items: DataFrame, target_file_bytes: int) -> int:
    """Rows that make up a file of so many bytes (before compression), from the batch's own width."""
    parts = [F.coalesce(F.octet_length(F.col("item")[c]), F.lit(0)) for c in ("title", "text", "url", "by")]
    width = items.agg(F.avg(sum(parts[1:], parts[0]) + F.lit(32))).first()[0]
    return max(1, int(target_file_bytes / (width or 32)))


def start_landing(
    spark: SparkSession,
    items_path: str | DataFrame,
    root: str,
    checkpoint: str,
    metrics_path: str | None = None,
    source: str = "forum",
    ingested_ts: int | None = None,
    trigger: dict | None = None,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | None = None,
    max_records_per_file: int | None = None,
    target_file_bytes: int | None = None,
):
    """Start the landing stream; returns the StreamingQuery.

    Items delivered more than once, in one batch or in several, are landed
    once by ``land_events``; nothing is dropped for being late or without a
    time. Malformed lines are kept (``quarantine``).

    ``items_path`` is a folder of JSON-lines files, or an already parsed
    streaming DataFrame (``items_from_json_strings`` over any source).
    ``trigger`` defaults to ``{"availableNow": True}`` (drain and stop);
    pass ``{"processingTime": "30 seconds"}`` for a long-running job. The
    size of a batch is bounded by files or bytes read, the size of a file by
    ``max_records_per_file`` or, from the width of the batch's rows, by
    ``target_file_bytes``.
    """
    if isinstance(items_path, DataFrame):
        items = items_path
    else:
        items = read_item_stream(spark, items_path, max_files_per_trigger, max_bytes_per_trigger)

    def land_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        adaptive = session.conf.get(_ADAPTIVE)
        session.conf.set(_ADAPTIVE, "true")  # off in a stream's session; the writes rest on it (``write_partitioned``)
        batch = batch.persist()  # used for reasons, quarantine and landing
        try:
            reasons = {r["reason"]: int(r["n"]) for r in batch_reasons(batch).collect()}  # five reasons at most
            if reasons.get("malformed"):
                quarantine(batch, root, batch_id)
            events = normalise_items(batch.filter(~F.col("parse_error")), source, ingested_ts)
            before = lake.event_size(session, root)
            most = max_records_per_file or (_rows_per_file(batch, target_file_bytes) if target_file_bytes else None)
            landed = lake.land_events(session, events, root, max_records_per_file=most)
            if metrics_path is not None:
                grown = [a - b for a, b in zip(lake.event_size(session, root), before, strict=True)]
                told = sorted(reasons.items()) + [("landed", landed), ("flushes", int(landed > 0)), ("files", grown[0]), ("bytes", grown[1])]
                session.createDataFrame(told, "reason string, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{metrics_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()
            session.conf.set(_ADAPTIVE, adaptive)

    writer = items.writeStream.foreachBatch(land_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def read_metrics(spark: SparkSession, metrics_path: str) -> DataFrame:
    """(reason, n) summed over all landed batches: items per reason, and what was written.

    ``landed`` events, ``flushes`` (batches that wrote), ``files`` and
    ``bytes`` by which the raw lake grew.
    """
    schema = T.StructType(
        [T.StructField("reason", T.StringType()), T.StructField("n", T.LongType()), T.StructField("batch_id", T.LongType())]
    )
    m = spark.read.schema(schema).parquet(metrics_path)
    return m.groupBy("reason").agg(F.sum("n").cast("long").alias("n"))
