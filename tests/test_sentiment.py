"""Lexicon scoring (reference expectations) and its rules."""

import pytest
from pyspark.sql import functions as F

from tickerlake.functions.lexicon import lexicon_df
from tickerlake.operators.sentiment import score_texts


def _score(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = score_texts(df, lexicon_df(spark), keep=["id"]).collect()
    return {r["id"]: r for r in rows}


def test_reference_examples(spark):
    s = _score(
        spark,
        [
            "This is fantastic news, I love it",
            "This is terrible, awful, the worst",
            "The market opened at 9:30 today",
            "",
        ],
    )
    assert s[0]["compound"] > 0.5 and s[0]["pos"] > s[0]["neg"]
    assert s[1]["compound"] < -0.5 and s[1]["neg"] > s[1]["pos"]
    assert -0.2 < s[2]["compound"] < 0.2
    assert s[3]["compound"] == 0.0 and s[3]["neu"] == 1.0


def test_null_text_scores_as_empty(spark):
    s = _score(spark, [None])
    assert (s[0]["compound"], s[0]["pos"], s[0]["neu"], s[0]["neg"]) == (0.0, 0.0, 1.0, 0.0)


def test_rules(spark):
    s = _score(
        spark,
        ["good", "very good", "not good", "good!", "good but terrible", "terrible but good", "good good good"],
    )
    good = s[0]["compound"]
    assert s[1]["compound"] > good  # booster
    assert s[2]["compound"] < 0  # negation flips
    assert s[3]["compound"] > good  # exclamation
    assert s[4]["compound"] < 0 < s[5]["compound"]  # contrast word weights the second clause
    assert s[6]["compound"] > good


def test_shares_sum_to_one(spark):
    s = _score(spark, ["great day but awful close, really bad", "nothing here"])
    for r in s.values():
        assert r["pos"] + r["neu"] + r["neg"] == pytest.approx(1.0, abs=1e-6)
        assert -1.0 <= r["compound"] <= 1.0


def test_duplicates_stay_duplicate(spark):
    rows = [(1, "love it"), (1, "love it"), (1, "love it"), (1, "awful, awful close"), (2, None), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = score_texts(df, lexicon_df(spark), keep=["id"]).collect()
    once = {t: score_texts(df.where(F.col("text") == t).limit(1), lexicon_df(spark), keep=["id"]).first() for t in ("love it", "awful, awful close")}
    assert len(got) == len(rows) and got.count(once["love it"]) == 3 and got.count(once["awful, awful close"]) == 1
    assert [r.compound for r in got if r.id == 2] == [0.0] * 3


def test_worked_values(spark):
    # fantastic 2.6 + love 3.2 = 5.8 -> 5.8 / sqrt(5.8^2 + 15)
    s = _score(spark, ["fantastic love"])
    assert s[0]["compound"] == pytest.approx(5.8 / (5.8**2 + 15) ** 0.5, abs=1e-6)


def test_all_caps_emphasis(spark):
    s = _score(spark, ["this is great news", "this is GREAT news", "GREAT", "great", "THIS IS GREAT NEWS"])
    assert s[1]["compound"] > s[0]["compound"]  # caps word among lower-case words
    assert s[2]["compound"] == s[3]["compound"]  # all words caps: no emphasis
    assert s[4]["compound"] == s[0]["compound"]


def test_each_rule_is_met_in_documents(spark):
    """Switching any one rule off changes the scores of at least 1 % of the texts."""
    from dataclasses import replace
    from decimal import Decimal

    from tickerlake.plans.params import RULE_LEXICON, RULE_PARAMS

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, zero = Decimal("1.0"), Decimal("0.000")

    def scores(params):
        rows = score_texts(docs, lexicon_df(spark, RULE_LEXICON), keep=["doc_id"], params=params).collect()
        return {r.doc_id: r.compound for r in rows}

    base = scores(RULE_PARAMS)
    off = {
        "negation": {"negation_scalar": Decimal("1.00")},
        "boosters": {"booster_decay": (zero, zero, zero)},
        "contrast": {"before_contrast": one, "after_contrast": one},
        "exclamation": {"exclaim_step": zero},
        "caps": {"caps_step": zero},
    }
    for rule, change in off.items():
        other = scores(replace(RULE_PARAMS, **change))
        changed = sum(base[d] != other[d] for d in base)
        assert changed >= 0.01 * len(base), (rule, changed, len(base))
