"""Ticker extraction against a plain Python regex restatement, on random text.

The restatement uses Python's Unicode-aware ``re`` (the semantics the
expression must reproduce): cashtags first, then bare capitals, known
symbols only, each once in first-seen order.
"""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickerlake.functions.tickers import BARE_PATTERN, CASHTAG_PATTERN, KNOWN_TICKERS, extract_tickers

_KNOWN = set(KNOWN_TICKERS)
_CASH = re.compile(CASHTAG_PATTERN)
_BARE = re.compile(BARE_PATTERN)


def expected(text):
    if not text:
        return []
    out = []
    for s in _CASH.findall(text) + _BARE.findall(text):
        if s in _KNOWN and s not in out:
            out.append(s)
    return out


pieces = st.sampled_from(
    ["AAPL", "MSFT", "F", "C", "ON", "GE", "ZZZZ", "GOOGLX", "$", " ", ".", ",", "_", "-", "é", "É", "2",
     "a", "x", "NVDA", "TSLA", "SPY", "'", "ü", "́", "\n", "QQQ", "V"]
)
texts = st.lists(pieces, min_size=0, max_size=14).map("".join)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(batch=st.lists(texts, min_size=200, max_size=200))
def test_matches_python_regex(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i long, text string")
    got = {r.i: r.t for r in df.select("i", extract_tickers(F.col("text")).alias("t")).collect()}
    for i, t in enumerate(batch):
        assert got[i] == expected(t), repr(t)


def test_many_random_batches(spark):
    """Several thousand random texts in one DataFrame (one Spark job)."""
    import random

    rng = random.Random(11)
    alphabet = ["AAPL", "MSFT", "F", "ON", "GE", "ZZZZ", "$", " ", ".", "_", "é", "2", "a", "NVDA", "́", "V"]
    batch = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i long, text string")
    got = {r.i: r.t for r in df.select("i", extract_tickers(F.col("text")).alias("t")).collect()}
    bad = [t for i, t in enumerate(batch) if got[i] != expected(t)]
    assert not bad, bad[:5]
