"""Small inline tables the optimizer can see (exact sizes, foldable empties)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return repr(value) if not isinstance(value, Decimal) else str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def values_df(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Small parameter table as an inline VALUES relation (exact size statistics).

    ``createDataFrame`` from Python objects goes through an RDD whose size
    the optimizer cannot see, which would defeat size-checked broadcasts.
    """
    names = [f.name for f in schema.fields]
    casts = ", ".join(f"CAST({n} AS {f.dataType.simpleString()}) AS {n}" for n, f in zip(names, schema.fields))
    if not rows:
        nulls = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields)
        return spark.sql(f"SELECT {nulls} WHERE FALSE")
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({', '.join(names)})")


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A typed empty table that Catalyst knows is empty.

    ``createDataFrame([], schema)`` hides emptiness behind an RDD; this
    folds to an empty local relation, so joins and aggregates over it are
    removed at planning time.
    """
    return values_df(spark, [], schema)
