"""Reading the supplied tables, and cutting lineage through the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake.session import scratch_path, scratch_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back.

    What follows reads the table, so it survives lost executors without
    repeating the work above it, and consumers see one and the same result.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_remainder(key: str, mod: int) -> Column:
    """crc32 of a key as text, modulo ``mod``; a null key counts as remainder 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(mod)), F.lit(1))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` also changes other scripts)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_small(big: DataFrame, small: DataFrame, keys: list[str], times: Column | None = None, how: str = "inner", share: int = 1000) -> DataFrame:
    """``big`` joined with ``small`` (one row per key) without gathering a hot key in one task.

    A key is hot with over 1/``share`` of the rows of ``big`` (10,000 at least,
    so there are at most ``share`` of them). Their rows of ``small`` are
    broadcast, the others meet in a plain join. ``times`` is the number of
    rows of ``big`` per key where ``small`` knows it; without it the rows are
    counted, folded before they are shuffled.
    """
    bound = max(10_000, big.count() // share)
    if times is not None:
        hot = small.where(times > bound).select(*keys)
    else:
        hot = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound).select(*keys)
    hot = F.broadcast(stored(hot, "hot-keys"))
    few = F.broadcast(small.join(hot, keys, "left_semi"))
    usual = big.join(hot, keys, "left_anti").join(small, keys, how)
    return usual.unionByName(big.join(hot, keys, "left_semi").join(few, keys, how))


__all__ = ["ascii_lower", "crc_remainder", "scratch_path", "scratch_root", "stored", "table", "with_small"]
