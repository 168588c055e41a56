"""Ticker extraction as native column expressions (no Python UDF).

A text mentions a ticker either as a cashtag (``$AAPL``, 1-5 capitals) or as
a bare capitalised word of 2-5 letters. Either kind counts only if the symbol
is in the known list. The result keeps all cashtag hits first, then bare
hits, each symbol once, in order of first appearance within its kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values (must equal the reference's for identical results) -------
# Known symbol list (124 entries): popular US tickers and major index ETFs.
KNOWN_TICKERS: tuple[str, ...] = (
    "AAPL", "MSFT", "GOOGL", "GOOG", "AMZN", "META", "NVDA", "TSLA",
    "AVGO", "ORCL", "CRM", "ADBE", "AMD", "INTC", "CSCO", "QCOM",
    "TXN", "IBM", "NFLX", "PYPL",
    "JPM", "BAC", "WFC", "GS", "MS", "C", "V", "MA", "AXP", "SCHW",
    "COF", "USB", "BLK", "SQ", "COIN",
    "WMT", "TGT", "COST", "HD", "LOW", "NKE", "MCD", "SBUX", "DIS",
    "PG", "KO", "PEP", "PM", "MO",
    "XOM", "CVX", "COP", "OXY", "BA", "GE", "CAT", "HON", "RTX", "LMT",
    "JNJ", "PFE", "MRK", "ABBV", "LLY", "UNH", "CVS", "TMO", "ABT",
    "BMY", "AMGN",
    "F", "GM", "RIVN", "LCID", "NIO", "UBER", "LYFT", "DAL", "UAL",
    "AAL",
    "TSM", "ASML", "MU", "AMAT", "LRCX", "MRVL", "ON", "WDC", "STX",
    "GME", "AMC", "BB", "PLTR", "SOFI", "HOOD", "RBLX", "DKNG", "MARA",
    "RIOT", "MSTR",
    "SNOW", "DDOG", "NET", "MDB", "CRWD", "PANW", "ZS", "OKTA", "TEAM",
    "SPY", "QQQ", "IWM", "DIA", "VOO", "VTI", "ARKK", "GLD", "SLV",
    "TLT", "TQQQ", "SQQQ", "VIX", "UVXY", "USO",
)
# Symbols whose bars are built while nothing is mentioned yet.
DEFAULT_BASKET: tuple[str, ...] = ("AAPL", "MSFT", "NVDA", "TSLA", "AMZN", "META", "GOOGL", "SPY", "QQQ")
# Cashtag: "$" then 1-5 capitals ending at a word boundary.
CASHTAG_PATTERN = r"\$([A-Z]{1,5})\b"
# Bare symbol: 2-5 capitals between word boundaries.
BARE_PATTERN = r"\b([A-Z]{2,5})\b"
# ---------------------------------------------------------------------------

# The patterns above follow Python's str-regex semantics, where a word
# character is a Unicode letter or number, or "_". Java's \b differs (it
# counts combining marks after a letter as word characters, with or without
# (?U)), so the boundaries are written out as look-arounds on that class.
WORD_CHAR = r"[\p{L}\p{N}_]"
_CASHTAG_JAVA = r"\$([A-Z]{1,5})(?!" + WORD_CHAR + ")"
# (?=[A-Z]) first: most positions fail on one cheap test before the look-behind.
_BARE_JAVA = r"(?=[A-Z])(?<!" + WORD_CHAR + r")([A-Z]{2,5})(?!" + WORD_CHAR + ")"


def cashtag_candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_CASHTAG_JAVA), 1)


def bare_candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_BARE_JAVA), 1)


def ticker_candidates(text: Column) -> Column:
    """All symbol-shaped hits, cashtags first, before the known-list check."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(cashtag_candidates(t), bare_candidates(t))


def extract_tickers(text: Column, known: tuple[str, ...] = KNOWN_TICKERS) -> Column:
    """array<string> of known symbols in ``text`` (empty for NULL or "").

    The membership test is an ``IN`` list, which the optimizer turns into a
    hash-set lookup (``InSet``) built once per task, and ``array_distinct``
    keeps the first occurrence of each symbol.
    """
    known_list = list(known)
    return F.array_distinct(
        F.filter(ticker_candidates(text), lambda s: s.isin(known_list))
    )


def unknown_symbols(text: Column, known: tuple[str, ...] = KNOWN_TICKERS) -> Column:
    """Cashtag-shaped symbols that are not in the known list ($YOLO)."""
    known_list = list(known)
    t = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.filter(cashtag_candidates(t), lambda s: ~s.isin(known_list)))


def normalise_symbols(symbols: Column) -> Column:
    """Comma-separated user symbol list -> upper-cased, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(symbols, F.lit("")), ","), lambda s: F.upper(F.trim(s)))
    return F.filter(parts, lambda s: s != "")
