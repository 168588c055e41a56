"""Which ids a lake holds: hash buckets with a Bloom filter each.

Under ``{root}/_ids`` lie two append-only tables, partitioned by bucket, and
a short tail of the newest landings:

    ids/bucket=/     (source, event_id) of landed events
    bloom/bucket=/   (word, bits): the set bits of the bucket's filter, 64 to a word
    recent/          (source, event_id) not dealt to buckets yet

A landing appends its ids to the tail in one small file; once the tail has
more than ``TAIL_FILES`` files or ``TAIL_BYTES`` bytes, the next landing deals
it to the buckets (``flush``), so that small batches do not leave a file in
every bucket. Dealing the same ids twice is harmless.

The number of buckets is chosen when the index is made (``rebuild`` changes
it) and kept in ``_ids/buckets``: a bucket should hold some million ids.

A landing asks the filters of the buckets that its own ids fall into, and
reads the ids of only those buckets whose filter answers yes for some id, and
the tail. What it reads is bounded by the buckets it touches, not by the lake. A filter
has 2**18 words (16 bits an id at a million ids in a bucket) and four bits per
id in one word, so asking is an equi-join on (bucket, word); a filter that has
become full answers yes more often, and results stay exact.

Order of a landing: mark, write the events, add their ids, unmark. A landing
that dies in between leaves its mark, and the next one builds the index anew
from the lake's two id columns, so no id is ever known without its event nor
an event without its id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake.functions.tables import empty_table
from tickerlake.sources import snapshot
from tickerlake.sources.files import Folder

BUCKETS = 64  # of a new index
TAIL_FILES = 64
TAIL_BYTES = 32 << 20
WORDS = 1 << 18
_IDS = T.StructType([T.StructField("source", T.StringType()), T.StructField("event_id", T.StringType()), T.StructField("bucket", T.IntegerType())])
_BLOOM = T.StructType([T.StructField("word", T.IntegerType()), T.StructField("bits", T.LongType()), T.StructField("bucket", T.IntegerType())])


def _folder(root: str) -> str:
    return f"{root.rstrip('/')}/_ids"


def _hash() -> Column:
    return F.xxhash64("event_id", "source")


def bucket_of(buckets: int) -> Column:
    return F.pmod(_hash(), F.lit(buckets)).cast("int")


def buckets_in(spark: SparkSession, root: str) -> int:
    folder = Folder(spark, _folder(root))
    return int(folder.read_text("buckets")) if folder.exists("buckets") else BUCKETS


def _word() -> Column:
    return F.shiftrightunsigned(_hash(), 46).cast("int")  # the highest 18 bits; the bucket takes the lowest


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    for k in range(4):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(_hash(), 8 + 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return bits


def _ids(spark: SparkSession, root: str) -> DataFrame:
    return snapshot.read(spark, f"{_folder(root)}/ids", "bucket=*", _IDS)


def _blooms(spark: SparkSession, root: str) -> DataFrame:
    return snapshot.read(spark, f"{_folder(root)}/bloom", "bucket=*", _BLOOM)


def opened(spark: SparkSession, root: str, keys: DataFrame) -> list[int]:
    """Buckets whose filter answers yes for some of ``keys`` (source, event_id)."""
    if not Folder(spark, f"{_folder(root)}/bloom").exists():
        return []  # all ids are in the tail
    bucket = bucket_of(buckets_in(spark, root))
    touched = [r[0] for r in keys.select(bucket.alias("b")).distinct().collect()]
    if not touched:
        return []
    asked = keys.select(bucket.alias("bucket"), _word().alias("word"), _bits().alias("mask"))
    filters = _blooms(spark, root).where(F.col("bucket").isin(touched)).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    found = asked.join(filters, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return sorted(r[0] for r in found.select("bucket").distinct().collect())


def known(spark: SparkSession, root: str, buckets: list[int]) -> DataFrame:
    """(source, event_id) of the lake in these buckets and in the tail; no other files are read."""
    dealt = _ids(spark, root).where(F.col("bucket").isin(buckets)).select("source", "event_id")
    return dealt.unionByName(_recent(spark, root))


def _recent(spark: SparkSession, root: str) -> DataFrame:
    schema = T.StructType(_IDS.fields[:2])
    path = f"{_folder(root)}/recent"
    return spark.read.schema(schema).parquet(path) if Folder(spark, path).exists() else empty_table(spark, schema)


def add(spark: SparkSession, root: str, keys: DataFrame) -> None:
    """Append ``keys`` to the tail."""
    keys.select("source", "event_id").hint("rebalance").write.mode("append").option("compression", "zstd").parquet(f"{_folder(root)}/recent")


def _deal(spark: SparkSession, root: str, keys: DataFrame) -> None:
    """Append ``keys`` to their buckets and to the filters."""
    bucket = bucket_of(buckets_in(spark, root)).alias("bucket")
    words = keys.groupBy(bucket, _word().alias("word")).agg(F.bit_or(_bits()).alias("bits"))
    for rows, name in ((words, "bloom"), (keys.select("source", "event_id", bucket), "ids")):
        rows.hint("rebalance", "bucket").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{_folder(root)}/{name}")


def flush(spark: SparkSession, root: str, always: bool = False) -> bool:
    """Deal the tail to the buckets if it has grown long; whether it did."""
    folder = Folder(spark, _folder(root))
    files = [n for n in folder.names("recent") if n.endswith(".parquet")]
    if not files or not (always or len(files) > TAIL_FILES or folder.size("recent") > TAIL_BYTES):
        return False
    _deal(spark, root, spark.read.schema(T.StructType(_IDS.fields[:2])).parquet(*[f"{folder.path}/recent/{n}" for n in files]))
    for n in files:
        folder.delete(f"recent/{n}")
    return True


def compact(spark: SparkSession, root: str) -> None:
    """Each bucket into one file, each filter's words into one row each; readers and landings may go on."""
    flush(spark, root, always=True)
    for name, schema in (("ids", _IDS), ("bloom", _BLOOM)):
        base = f"{_folder(root)}/{name}"
        snapshot.recover(spark, base)
        names = snapshot.files_of(spark, base, "bucket=*", schema, lambda part: True)
        rows = snapshot.read_files(spark, base, schema, names)
        if name == "bloom":
            rows = rows.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))

        def write(to: str, rows: DataFrame = rows) -> int:
            rows.hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(to)
            return 0

        if names:
            snapshot.rewrite(spark, base, names, write)


def begin(spark: SparkSession, root: str) -> str:
    """Mark a landing as begun."""
    mark = f"_landing/{uuid.uuid4().hex}"
    folder = Folder(spark, _folder(root))
    if not folder.exists("buckets"):
        folder.write_text("buckets", str(BUCKETS))
    folder.write_text(mark, "")
    return mark


def end(spark: SparkSession, root: str, mark: str) -> None:
    Folder(spark, _folder(root)).delete(mark)


def is_sound(spark: SparkSession, root: str) -> bool:
    """Whether the index is there and no landing was left half done."""
    folder = Folder(spark, _folder(root))
    return folder.exists("buckets") and folder.exists("ids") == folder.exists("bloom") and not folder.names("_landing")


def rebuild(spark: SparkSession, root: str, events: DataFrame, buckets: int | None = None) -> None:
    """The index anew from the lake's events, with another number of buckets if one is given."""
    folder = Folder(spark, _folder(root))
    marks = folder.names("_landing")
    kept = buckets or buckets_in(spark, root)
    folder.delete("buckets")  # until it is back, the index is not sound
    for name in ("ids", "bloom", "recent"):
        folder.delete(name)
    folder.write_text("_landing/rebuild", "")
    folder.write_text("buckets", str(kept))
    _deal(spark, root, events.select("source", "event_id"))
    folder.delete("_landing/rebuild")
    for m in marks:
        folder.delete(f"_landing/{m}")
