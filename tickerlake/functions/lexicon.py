"""Default sentiment lexicon and scoring parameters.

The lexicon is a table ``(token string, valence double, kind string)`` with
kind one of ``word`` (carries valence), ``booster`` (intensity scalar added
to a following word) and ``negator`` (flips a following word). Any table of
that shape can replace the default; it is joined, never inlined.

The entries are a small, finance-tinted selection of common words. Their
valences follow the scale of the rating study of Hutto and Gilbert (2014),
whose published list (MIT licence) rates many of the same words alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tickerlake.functions.tables import values_df

LEXICON_SCHEMA = T.StructType(
    [
        T.StructField("token", T.StringType(), False),
        T.StructField("valence", T.DoubleType(), False),
        T.StructField("kind", T.StringType(), False),
    ]
)

DEFAULT_LEXICON: tuple[tuple[str, float, str], ...] = (
    # positive words
    ("fantastic", 2.6, "word"),
    ("love", 3.2, "word"),
    ("loving", 2.9, "word"),
    ("loved", 2.9, "word"),
    ("great", 3.1, "word"),
    ("good", 1.9, "word"),
    ("bullish", 2.0, "word"),
    ("strong", 1.7, "word"),
    ("happy", 2.7, "word"),
    ("excellent", 2.7, "word"),
    ("amazing", 2.8, "word"),
    ("win", 2.8, "word"),
    ("winning", 2.4, "word"),
    ("gain", 2.0, "word"),
    ("gains", 1.9, "word"),
    ("profit", 1.9, "word"),
    ("rally", 1.8, "word"),
    ("soaring", 2.1, "word"),
    ("beat", 1.2, "word"),
    ("upgrade", 1.5, "word"),
    ("like", 1.5, "word"),
    ("nice", 1.8, "word"),
    ("best", 3.2, "word"),
    ("optimistic", 2.2, "word"),
    ("confident", 2.0, "word"),
    # negative words
    ("terrible", -2.1, "word"),
    ("awful", -2.0, "word"),
    ("worst", -3.1, "word"),
    ("bad", -2.5, "word"),
    ("bearish", -2.0, "word"),
    ("worried", -1.8, "word"),
    ("worry", -1.9, "word"),
    ("weak", -1.9, "word"),
    ("sad", -2.1, "word"),
    ("hate", -2.7, "word"),
    ("loss", -1.5, "word"),
    ("losses", -1.7, "word"),
    ("crash", -2.4, "word"),
    ("dump", -1.6, "word"),
    ("fear", -2.2, "word"),
    ("panic", -2.3, "word"),
    ("downgrade", -1.5, "word"),
    ("miss", -1.2, "word"),
    ("poor", -2.1, "word"),
    ("fraud", -2.8, "word"),
    ("scam", -2.6, "word"),
    ("disappointing", -2.2, "word"),
    ("pessimistic", -1.9, "word"),
    # boosters: intensity scalars
    ("very", 0.293, "booster"),
    ("really", 0.293, "booster"),
    ("extremely", 0.293, "booster"),
    ("incredibly", 0.293, "booster"),
    ("so", 0.293, "booster"),
    ("super", 0.293, "booster"),
    ("hugely", 0.293, "booster"),
    ("barely", -0.293, "booster"),
    ("slightly", -0.293, "booster"),
    ("somewhat", -0.293, "booster"),
    ("hardly", -0.293, "booster"),
    # negators
    ("not", 0.0, "negator"),
    ("no", 0.0, "negator"),
    ("never", 0.0, "negator"),
    ("nothing", 0.0, "negator"),
    ("nobody", 0.0, "negator"),
    ("neither", 0.0, "negator"),
    ("nor", 0.0, "negator"),
    ("without", 0.0, "negator"),
    ("cannot", 0.0, "negator"),
    ("don't", 0.0, "negator"),
    ("doesn't", 0.0, "negator"),
    ("isn't", 0.0, "negator"),
    ("wasn't", 0.0, "negator"),
    ("aren't", 0.0, "negator"),
    ("won't", 0.0, "negator"),
    ("can't", 0.0, "negator"),
)


@dataclass(frozen=True)
class ScoringParams:
    """Rule constants of the lexicon scorer (after Hutto & Gilbert, 2014).

    Exact decimals so that per-token contributions and their sums are the
    same on every engine and in every summation order.
    """

    # tokens: runs of letters, digits and apostrophes (lower-cased after splitting)
    token_pattern: str = r"[^\p{L}\p{N}']+"
    negation_scalar: Decimal = Decimal("-0.74")
    # weight of a booster 1, 2 and 3 tokens before the word
    booster_decay: tuple[Decimal, Decimal, Decimal] = (Decimal("1.00"), Decimal("0.95"), Decimal("0.90"))
    contrast_word: str = "but"
    before_contrast: Decimal = Decimal("0.5")
    after_contrast: Decimal = Decimal("1.5")
    exclaim_step: Decimal = Decimal("0.292")
    caps_step: Decimal = Decimal("0.733")
    exclaim_cap: int = 4
    normaliser: float = 15.0


DEFAULT_PARAMS = ScoringParams()


def lexicon_df(spark: SparkSession, rows=DEFAULT_LEXICON) -> DataFrame:
    """The lexicon as a local relation, so its exact size is known to the planner."""
    return values_df(spark, list(rows), LEXICON_SCHEMA)
