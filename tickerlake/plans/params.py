"""Fixed parameters of the registered queries (shared by the Spark plans and
their SQL oracles so both compute the same thing)."""

from __future__ import annotations

from dataclasses import replace

from tickerlake.functions.lexicon import DEFAULT_PARAMS
from tickerlake.operators.backtest import PERIODS_PER_YEAR_5M

# Source name given to normalised upstream items.
ITEM_SOURCE = "forum"
# Ingest wall clock for normalised items; a fixed value keeps results
# reproducible (jobs pass the real clock).
INGEST_CLOCK_MS = 1_704_153_600_000
# Bar window length used for the market anchor.
BAR_MINUTES = 120
# A user-typed symbol list: messy on purpose (case, blanks, spaces).
UNIVERSE_TEXT = " intc, Amd ,, orcl ,zzzz"
# Windowed runs: hours to start from and to end with, the hour whose frames
# are stored before, and what that means for the rows of the full signal.
SINCE_HOUR, UNTIL_HOUR, FRAMES_HOUR = "2024-01-01T06", "2024-01-01T08", "2024-01-01T04"
WINDOWS = {"since": "bucket >= TIMESTAMP '2024-01-01 06:00:00'", "until": "bucket < TIMESTAMP '2024-01-01 09:00:00'"}
PERIODS_PER_YEAR = PERIODS_PER_YEAR_5M
# Scored-at stamp for registered queries.
SCORED_TS = 0


def universe_symbols() -> list[str]:
    return [s.strip().upper() for s in UNIVERSE_TEXT.split(",") if s.strip()]

# Frequent words of ``documents`` with made-up valences: a lexicon whose words,
# boosters, negators and contrast word meet in most texts.
RULE_LEXICON = (
    ("a", 1.2, "word"), ("that", 1.5, "word"), ("this", 2.1, "word"), ("are", 0.9, "word"), ("tion", 1.1, "word"),
    ("was", -1.7, "word"), ("from", -2.3, "word"), ("que", -1.3, "word"), ("st", -0.8, "word"), ("la", -1.4, "word"),
    ("of", 0.3, "booster"), ("as", -0.25, "booster"), ("de", 0.2, "booster"),
    ("it", 0.0, "negator"), ("by", 0.0, "negator"), ("en", 0.0, "negator"),
)
RULE_PARAMS = replace(DEFAULT_PARAMS, contrast_word="and")

# Hourly event budget for the rate guard.
RATE_BUDGET_PER_HOUR = 500
# Trading cost per unit of position change, basis points.
COST_BPS = 1.0
# Number of separate landings used to create small files before compaction.
COMPACT_BATCHES = 3
