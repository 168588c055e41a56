"""Table contracts: fixed schemas, declared up front, checked before writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw events lake: {root}/source=/dt=/hr=/part-*.parquet
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("event_id", T.StringType(), False),
        T.StructField("event_ts", T.LongType(), False),  # epoch ms UTC, event time
        T.StructField("ingested_ts", T.LongType(), False),  # epoch ms UTC, wall clock
        T.StructField("author", T.StringType(), True),
        T.StructField("text", T.StringType(), False),
        T.StructField("url", T.StringType(), True),
    ]
)

# Scored events: {root}/derived/sentiment/source=/dt=/hr=/
SENTIMENT_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("event_id", T.StringType(), False),
        T.StructField("event_ts", T.LongType(), False),
        T.StructField("compound", T.FloatType(), False),
        T.StructField("pos", T.FloatType(), False),
        T.StructField("neu", T.FloatType(), False),
        T.StructField("neg", T.FloatType(), False),
        T.StructField("tickers", T.ArrayType(T.StringType(), False), False),
        T.StructField("scored_ts", T.LongType(), False),
    ]
)

# One-minute OHLCV bars: {root}/derived/market/dt=/hr=/
BAR_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType(), False),
        T.StructField("ts", T.LongType(), False),  # epoch ms of the bar's minute
        T.StructField("open", T.DoubleType(), False),
        T.StructField("high", T.DoubleType(), False),
        T.StructField("low", T.DoubleType(), False),
        T.StructField("close", T.DoubleType(), False),
        T.StructField("volume", T.LongType(), False),
    ]
)

# Per ticker the last active minutes before an hour: {root}/derived/frames/asof=/
FRAME_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType(), True),
        T.StructField("bucket", T.TimestampNTZType(), True),
        T.StructField("mentions", T.LongType(), True),
        T.StructField("avg_sentiment", T.DoubleType(), True),
    ]
)

# Mergeable backtest figures of an hour: {root}/derived/backtest/dt=/hr=/
PIECE_SCHEMA = T.StructType(
    [T.StructField("at", T.TimestampNTZType(), True)]
    + [T.StructField(c, T.LongType(), True) for c in ("n_signals", "n_trades", "wins")]
    + [T.StructField(c, T.DoubleType(), True) for c in ("s", "mean", "m2", "high", "low", "fall")]
)

# Hive partition columns as they are read back. Inference would turn hr=09
# into the integer 9, so the types are always given.
HOUR_PARTITIONS = T.StructType(
    [
        T.StructField("dt", T.DateType(), True),
        T.StructField("hr", T.StringType(), True),
    ]
)

# A raw upstream item (forum post / comment) before normalisation.
ITEM_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), True),
        T.StructField("time", T.LongType(), True),  # epoch SECONDS, may be missing
        T.StructField("by", T.StringType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("text", T.StringType(), True),
        T.StructField("url", T.StringType(), True),
        T.StructField("deleted", T.BooleanType(), True),
        T.StructField("dead", T.BooleanType(), True),
    ]
)


class SchemaDrift(ValueError):
    """Raised when a DataFrame does not match a table contract."""


def later_version(old: T.StructType, *added: T.StructField) -> T.StructType:
    """The next version of a contract: the old fields, then new nullable ones.

    Files of the old version read as NULL in the new columns.
    """
    for f in added:
        if not f.nullable or f.name in old.names or f.name in HOUR_PARTITIONS.names:
            raise SchemaDrift(f"a later version may only add nullable columns with new names, not {f.name}")
    return T.StructType([*old.fields, *added])


def is_later_version(new: T.StructType, old: T.StructType) -> bool:
    """Whether ``new`` is ``old`` or adds nullable columns to it."""
    n = len(old.fields)
    same = [(a.name, a.dataType) == (b.name, b.dataType) for a, b in zip(new.fields, old.fields, strict=False)]
    return len(new.fields) >= n and all(same) and all(f.nullable for f in new.fields[n:])


def read_schema(contract: T.StructType, partitions: list[str]) -> T.StructType:
    """Schema to read a partitioned table back with.

    Partition columns are not stored in the files; their types come from the
    contract (``source``) or from ``HOUR_PARTITIONS`` (``dt``, ``hr``).
    """
    fields = [f for f in contract.fields if f.name not in partitions]
    by_name = {f.name: f for f in contract.fields}
    by_name.update({f.name: f for f in HOUR_PARTITIONS.fields})
    for p in partitions:
        f = by_name[p]
        fields.append(T.StructField(f.name, f.dataType, True))
    return T.StructType(fields)


def conform(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Select the contract's columns in order, failing loudly on drift.

    Missing columns or a type that differs from the contract raise
    ``SchemaDrift``. Extra columns are dropped. A NULL in a column that the
    contract declares non-null raises when the rows are computed.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for f in contract.fields:
        if f.name not in have:
            problems.append(f"missing column {f.name}")
        elif have[f.name] != f.dataType and not _same_array(have[f.name], f.dataType):
            problems.append(f"{f.name}: {have[f.name].simpleString()} != {f.dataType.simpleString()}")
    if problems:
        raise SchemaDrift("; ".join(problems))
    return df.select(*[F.col(f.name) if f.nullable else _not_null(f.name) for f in contract.fields])


def _not_null(name: str):
    found = F.when(F.col(name).isNull(), F.raise_error(F.lit(f"NULL in non-null column {name}"))).otherwise(F.col(name))
    return found.alias(name)


def _same_array(a: T.DataType, b: T.DataType) -> bool:
    return isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType) and a.elementType == b.elementType
