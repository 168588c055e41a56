"""Ticker extraction (cases from the reference's own unit tests, plus quirks)."""

import pytest
from pyspark.sql import functions as F

from tickerlake.functions.tickers import KNOWN_TICKERS, extract_tickers, normalise_symbols


def _extract(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(extract_tickers(F.col("text")).alias("t")).first()["t"]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Bullish on $AAPL today", ["AAPL"]),
        ("AAPL hit a new high", ["AAPL"]),
        ("$YOLO to the moon", []),
        ("FOR ALL THE THINGS", []),
        ("$NVDA up. AAPL flat. NVDA again.", ["NVDA", "AAPL"]),
        ("", []),
        (None, []),
        ("just some prose with no symbols", []),
        # cashtags come first, then bare words (not first-seen order)
        ("MSFT then $AAPL", ["AAPL", "MSFT"]),
        # single letters only as cashtags; no boundary inside words
        ("$F up, F-150 too; $GOOGLX AAPL_X AAPL2", ["F"]),
        # Unicode word boundaries
        ("éAAPL $TSLAé MSFT", ["MSFT"]),
    ],
)
def test_extract(spark, text, expected):
    assert _extract(spark, text) == expected


def test_long_and_short(spark):
    got = _extract(spark, "Long $AAPL, short MSFT")
    assert "AAPL" in got and "MSFT" in got


def test_known_list_size():
    assert len(KNOWN_TICKERS) == 124
    assert len(set(KNOWN_TICKERS)) == 124


def test_normalise_symbols(spark):
    df = spark.createDataFrame([(" aapl, Msft ,, nvda ",)], "s string")
    assert df.select(normalise_symbols(F.col("s")).alias("x")).first()["x"] == ["AAPL", "MSFT", "NVDA"]
