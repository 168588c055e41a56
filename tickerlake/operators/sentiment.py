"""Lexicon sentiment scoring as a Spark job.

Plan: tokenize each text in place -> explode tokens with their three
predecessors -> broadcast-join the lexicon (word valence, and booster /
negator kind of the predecessors) -> per-token contribution -> aggregate
back to one row per input row. The aggregation collapses map-side (a row's
tokens are adjacent in one task), so the shuffle carries one small row per
text, never the text itself.

Scores (compound in [-1, 1]; pos, neu, neg shares summing to 1):

* token contribution = (valence + boosters + caps) x negation x contrast,
  where a booster 1-3 tokens before adds its scalar (decayed) in the
  direction of the valence, an all-caps word in a text whose other words
  are not all caps adds ``caps_step`` in that direction, a negator 1-3
  tokens before multiplies by ``negation_scalar``, and words before / after
  the first contrast word ("but") are weighted 0.5 / 1.5;
* S = sum of contributions, moved away from 0 by ``exclaim_step`` per "!"
  (at most ``exclaim_cap``); compound = S / sqrt(S^2 + normaliser);
* pos = sum(c + 1 for c > 0), neg = |sum(c - 1 for c < 0)|, neu = number of
  zero-contribution tokens; the exclamation boost goes to the larger side;
  the three are divided by their total.
* Texts without tokens score (compound 0, pos 0, neu 1, neg 0).

Contributions are exact decimals, so sums do not depend on the order in
which Spark adds partial results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerlake.functions.lexicon import DEFAULT_PARAMS, ScoringParams
from tickerlake.plans.sizing import bounded_broadcast, ensure_parallelism

CONTRIB_TYPE = "decimal(18,8)"
VALENCE_TYPE = "decimal(6,3)"


def raw_tokens(text: Column, params: ScoringParams = DEFAULT_PARAMS) -> Column:
    """Word tokens of ``text`` as written (NULL treated as "")."""
    parts = F.split(F.coalesce(text, F.lit("")), params.token_pattern)
    return F.filter(parts, lambda t: t != "")


def tokens(text: Column, params: ScoringParams = DEFAULT_PARAMS) -> Column:
    """Lower-cased word tokens of ``text`` (split first, then lower-cased)."""
    return F.transform(raw_tokens(text, params), lambda t: F.lower(t))


def all_caps(t: Column) -> Column:
    """Every cased character upper-case, and at least one cased character."""
    return (t == F.upper(t)) & (t != F.lower(t))


def exclamations(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))


def score_texts(
    df: DataFrame,
    lexicon: DataFrame,
    keep: list[str],
    text_col: str = "text",
    params: ScoringParams = DEFAULT_PARAMS,
) -> DataFrame:
    """One output row per input row: ``keep`` columns + compound/pos/neu/neg (float).

    ``keep`` must not include the text column (it is not carried through
    the shuffle). Duplicate input rows stay duplicate.

    Rows are numbered where they are read, so ``df`` has to give a repeated
    task its rows in the same order, as scans and written tables do; store the
    result of a shuffle before it is scored.
    """
    contrib, group_cols = token_contributions(df, lexicon, keep, text_col, params)
    per_row = contrib.groupBy(*group_cols).agg(
        F.sum("__c").alias("__s"),
        F.sum(F.when(F.col("__c") > 0, F.col("__c") + 1)).alias("__pos"),
        F.sum(F.when(F.col("__c") < 0, F.col("__c") - 1)).alias("__neg"),
        F.count(F.when(F.col("__c") != 0, True)).alias("__hits"),
    )
    return per_row.select(*keep, *_finish(params))


LISTED_WORDS = 20_000


def _listed_words(lexicon: DataFrame) -> list[str] | None:
    """The lexicon's words, if there are at most ``LISTED_WORDS`` (no more are fetched)."""
    rows = lexicon.filter(F.col("kind") == "word").select("token").distinct().limit(LISTED_WORDS + 1).collect()
    return sorted(r[0] for r in rows if r[0] is not None) if len(rows) <= LISTED_WORDS else None


def token_contributions(
    df: DataFrame,
    lexicon: DataFrame,
    keep: list[str],
    text_col: str = "text",
    params: ScoringParams = DEFAULT_PARAMS,
) -> tuple[DataFrame, list[str]]:
    """Rows per text (group columns + ``__c``): one per lexicon-word token,
    plus the text's first token row so every text is present.

    ``__c`` is the token's exact DECIMAL contribution, NULL for tokens that
    are not lexicon words. Internal columns start with ``__``.
    """
    p = params
    clash = [c for c in keep if c.startswith("__") or c == text_col]
    if clash:
        raise ValueError(f"keep columns may not start with '__' or be the text column: {clash}")
    base = (
        # numbered at the scan, before any shuffle, so a repeated task numbers alike
        ensure_parallelism(df.select(*keep, F.col(text_col).alias("__text"), F.monotonically_increasing_id().alias("__row")))
        .withColumn("__otoks", raw_tokens(F.col("__text"), p))
        .withColumn("__excl", F.least(exclamations(F.col("__text")), F.lit(p.exclaim_cap)))
        .drop("__text")
    )
    # Per-text values are computed before the explode, so the token arrays
    # are not carried into (copied onto) every generated row.
    n_caps = F.size(F.filter(F.col("__otoks"), all_caps))
    base = (
        base.withColumn("__toks", F.transform("__otoks", lambda t: F.lower(t)))
        .withColumn("__n_tok", F.size("__otoks"))
        .withColumn("__capdiff", (n_caps > 0) & (n_caps < F.col("__n_tok")))
        .withColumn("__but", F.array_position("__toks", p.contrast_word))
    )
    toks = F.col("__toks")
    otoks = F.col("__otoks")

    def prev(i: Column, k: int) -> Column:
        return F.when(i >= k, toks[i - k])

    def seen(i: Column) -> Column:
        return F.struct(
            (i + 1).alias("__i"),
            toks[i].alias("__t"),
            all_caps(otoks[i]).alias("__cap"),
            prev(i, 1).alias("__p1"),
            prev(i, 2).alias("__p2"),
            prev(i, 3).alias("__p3"),
        )

    # Where the lexicon's words are few enough for a literal set, only the
    # places of lexicon words are exploded, not every token.
    listed = _listed_words(lexicon)
    if listed is None:
        ctx = F.transform(toks, lambda t, i: seen(i))
    else:
        places = F.filter(F.transform(toks, lambda t, i: F.when(t.isin(listed), i)), lambda i: i.isNotNull())
        ctx = F.transform(places, seen)
    group_cols = [*keep, "__row", "__n_tok", "__but", "__excl", "__capdiff"]
    exploded = base.select(
        *group_cols,
        F.explode_outer(ctx).alias("__c"),
    ).select(*group_cols, "__c.__i", "__c.__t", "__c.__cap", "__c.__p1", "__c.__p2", "__c.__p3")

    # The lexicon is a small parameter table: one partition, so deduplicating
    # it by token needs no shuffle.
    lexicon = lexicon.coalesce(1)
    words = bounded_broadcast(
        lexicon.filter(F.col("kind") == "word")
        .groupBy("token")
        .agg(F.max(F.col("valence")).cast(VALENCE_TYPE).alias("__v"))
        .withColumnRenamed("token", "__wtok")
    )
    mods = (
        lexicon.filter(F.col("kind").isin("booster", "negator"))
        .groupBy("token")
        .agg(
            F.sum(F.when(F.col("kind") == "booster", F.col("valence"))).cast(VALENCE_TYPE).alias("b"),
            F.max(F.col("kind") == "negator").alias("n"),
        )
    )

    j = exploded.join(words, exploded["__t"] == words["__wtok"], "left").drop("__wtok")
    # Only lexicon words contribute; the first token row of each text is kept
    # so texts without hits still reach the aggregate (i is NULL for texts
    # without tokens). This cuts the rows probed and aggregated to ~hits.
    j = j.filter(F.col("__v").isNotNull() | F.col("__i").isNull() | (F.col("__i") == 1))
    # The same broadcast modifier table is probed for each predecessor; the
    # three build sides are identical plans, so the exchange is reused.
    mods = bounded_broadcast(mods)
    for k in (1, 2, 3):
        m = mods.alias(f"__m{k}")
        key = F.when(F.col("__v").isNotNull(), F.col(f"__p{k}"))
        j = j.join(m, key == F.col(f"__m{k}.token"), "left").select(
            *[j[c] for c in j.columns], F.col(f"__m{k}.b").alias(f"__b{k}"), F.col(f"__m{k}.n").alias(f"__n{k}")
        )

    v = F.col("__v")
    d1, d2, d3 = (F.lit(str(x)).cast("decimal(3,2)") for x in p.booster_decay)
    boost = (
        F.coalesce(F.col("__b1"), F.lit(0).cast(VALENCE_TYPE)) * d1
        + F.coalesce(F.col("__b2"), F.lit(0).cast(VALENCE_TYPE)) * d2
        + F.coalesce(F.col("__b3"), F.lit(0).cast(VALENCE_TYPE)) * d3
    )
    # An all-caps word in a text that also has other words is emphasised.
    caps_on = F.col("__capdiff") & F.coalesce(F.col("__cap"), F.lit(False))
    caps = F.when(caps_on, F.lit(str(p.caps_step)).cast("decimal(4,3)")).otherwise(F.lit(0).cast("decimal(4,3)"))
    signed = F.when(v < 0, v - boost - caps).otherwise(v + boost + caps)
    negated = (
        F.coalesce(F.col("__n1"), F.lit(False))
        | F.coalesce(F.col("__n2"), F.lit(False))
        | F.coalesce(F.col("__n3"), F.lit(False))
    )
    neg_scaled = F.when(negated, signed * F.lit(str(p.negation_scalar)).cast("decimal(3,2)")).otherwise(signed)
    but = F.col("__but")
    contrasted = (
        F.when((but > 0) & (F.col("__i") < but), neg_scaled * F.lit(str(p.before_contrast)).cast("decimal(2,1)"))
        .when((but > 0) & (F.col("__i") > but), neg_scaled * F.lit(str(p.after_contrast)).cast("decimal(2,1)"))
        .otherwise(neg_scaled)
    )
    c = contrasted.cast(CONTRIB_TYPE)
    return j.select(*group_cols, c.alias("__c")), group_cols


def _finish(p: ScoringParams) -> list[Column]:
    zero = F.lit(0).cast(CONTRIB_TYPE)
    e = F.col("__excl").cast("decimal(4,0)") * F.lit(str(p.exclaim_step)).cast("decimal(4,3)")
    s = F.coalesce(F.col("__s"), zero)
    s_emph = F.when(s > 0, s + e).when(s < 0, s - e).otherwise(s).cast("double")
    compound = s_emph / F.sqrt(s_emph * s_emph + F.lit(p.normaliser))

    pos = F.coalesce(F.col("__pos"), zero)
    neg = -F.coalesce(F.col("__neg"), zero)
    neu = (F.col("__n_tok") - F.col("__hits")).cast("decimal(20,0)")
    pos_e = F.when(pos > neg, pos + e).otherwise(pos)
    neg_e = F.when(pos < neg, neg + e).otherwise(neg)
    total = (pos_e + neg_e + neu).cast("double")
    empty = F.col("__n_tok") == 0
    return [
        F.when(empty, 0.0).otherwise(compound).cast("float").alias("compound"),
        F.when(empty, 0.0).otherwise(pos_e.cast("double") / total).cast("float").alias("pos"),
        F.when(empty, 1.0).otherwise(neu.cast("double") / total).cast("float").alias("neu"),
        F.when(empty, 0.0).otherwise(neg_e.cast("double") / total).cast("float").alias("neg"),
    ]


def score_events(
    events: DataFrame,
    lexicon: DataFrame,
    scored_ts: Column | int | None = None,
    params: ScoringParams = DEFAULT_PARAMS,
) -> DataFrame:
    """Raw events -> sentiment rows (the scored-table contract).

    Tickers are extracted in place (row-local expression); scores come from
    ``score_texts``. ``scored_ts`` is one value per run (default: now).
    """
    from tickerlake.functions.tickers import extract_tickers

    ts = (
        F.unix_millis(F.current_timestamp())
        if scored_ts is None
        else (scored_ts if isinstance(scored_ts, Column) else F.lit(int(scored_ts)))
    )
    prepared = events.select(
        "source", "event_id", "event_ts", extract_tickers(F.col("text")).alias("tickers"), "text"
    )
    scored = score_texts(prepared, lexicon, keep=["source", "event_id", "event_ts", "tickers"], params=params)
    return scored.select(
        "source", "event_id", "event_ts", "compound", "pos", "neu", "neg", "tickers", ts.cast("long").alias("scored_ts")
    )
