"""Scoring invariants on random token sequences (hypothesis)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickerlake.functions.lexicon import DEFAULT_LEXICON, lexicon_df
from tickerlake.operators.sentiment import score_texts

WORDS = [t for t, _, _ in DEFAULT_LEXICON] + ["stock", "today", "the", "AAPL", "$MSFT", "!", "?", "9:30", "é"]
texts = st.lists(st.sampled_from(WORDS), min_size=0, max_size=25).map(" ".join)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(batch=st.lists(texts, min_size=300, max_size=300))
def test_score_bounds(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i long, text string")
    rows = score_texts(df, lexicon_df(spark), keep=["i"]).collect()
    assert len(rows) == len(batch)
    for r in rows:
        assert -1.0 <= r.compound <= 1.0
        assert min(r.pos, r.neu, r.neg) >= 0.0
        assert abs(r.pos + r.neu + r.neg - 1.0) < 1e-5
        if r.compound > 0:
            assert r.pos >= r.neg or r.pos == 0.0
