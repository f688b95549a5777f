"""Intent, ticker and count parsing of chat messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords per use case, first class with a hit wins.
USE_CASES = [
    ("text2sql", ["select ", "from ", "where ", "group by", "order by", "sql"]),
    ("summarization", ["summarize", "summarise", "summary", "overview"]),
    ("explanation", ["explain", "what is", "what does", "how does"]),
    ("export", ["export", "download", "send to"]),
    ("rag", ["search", "find", "look up", "retrieve", "rag"]),
]

# Route patterns, first hit wins.
ROUTES = [
    ("asx",
     r"\b(asx|announce(d|s|ment|ments)?|market.sensitive|price.sensitive"
     r"|quarterly.result|half.year(ly)?|annual.report"
     r"|asx.listed|listed.company|on.the.asx"
     r"|earnings.*result|results.*asx|asx.*result"
     r"|interpret.*asx|fetch.*asx|ingest.*asx"
     r"|capital.raise|placement|prospectus|appendix.4[ce]"
     r"|what did \w+ announce|latest.*announcement|recent.*announcement)\b"),
    ("sql",
     r"\b(select|from|where|group by|order by|join|having|count|sum|avg|max|min"
     r"|revenue|sales|orders|customers|products|metrics|kpi|report|dashboard"
     r"|breakdown|by (week|month|year|region|category|country|channel)"
     r"|how many|total|top \d+|bottom \d+|trend|growth|rate|volume"
     r"|compare|vs\.?|versus|over time|year over year|yoy|mom|wow"
     r"|run sql|query|table|database|schema)\b"),
    ("rag",
     r"\b(what is|what are|explain|describe|tell me about|documentation"
     r"|policy|process|procedure|how to|guide|tutorial|knowledge base"
     r"|our (data|schema|model|pipeline|architecture)|according to"
     r"|based on|in the docs?|from the docs?)\b"),
]

# Intent patterns of announcement requests.
INGEST_WORDS = r"\b(ingest|save|store|add to|knowledge base|index|embed)\b"
SIGNAL_WORDS = (
    r"\b(signal|trade|trading signal|buy|sell|strong buy|strong sell"
    r"|entry|stop.?loss|take.?profit|price target|technical analysis"
    r"|rsi|macd|bollinger|ema|moving average|ohlcv|candlestick|chart"
    r"|should i (buy|sell)|when to (buy|sell)|is it a buy|is it a sell"
    r"|bullish|bearish|momentum|breakout|support|resistance)\b")
FETCH_WORDS = r"\b(fetch|list|show|recent|latest|history|last \d+|get announcements?)\b"
INTERPRET_WORDS = (
    r"\b(interpret|analyse|analyze|summary|summarize|explain|what did|tell me"
    r"|results?|earnings?|report|quarterly|half.year|annual|guidance|dividend"
    r"|acquisition|capital raise|profit|revenue|outlook|material|announce)\b")

# Explicit ticker tag, and words that make a ticker likely.
TICKER_TAG = r"(?:ASX[:\s]|\[asx:\s*)([A-Za-z]{2,5})"
FINANCIAL_CONTEXT = (
    r"\b(asx|announce(d|ment|s)?|result|earnings|dividend|report|quarterly"
    r"|half.year|annual|interpret|ingest|fetch|listed|market.sensitive"
    r"|price.sensitive|acquire|acquisition|placement|capital.raise"
    r"|revenue|profit|loss|ebitda|npat|eps|dps|guidance)\b")
UPPER_WORD = r"\b([A-Z]{2,5})\b"
ANY_WORD = r"\b([A-Za-z]{2,5})\b"

# Words that look like tickers but are none.
NOT_TICKERS = [
    "A", "AN", "THE", "AND", "OR", "FOR", "OF", "TO", "IN", "ON", "BY", "AT", "AS", "IS", "IT", "BE", "DO", "GO",
    "NO", "SO", "UP", "US", "WE", "IF", "MY", "HE", "ME", "HI", "WHO", "WHY", "HOW", "WHAT", "WHEN", "WHERE",
    "WHICH", "DID", "HAS", "HAD", "ARE", "WAS", "WERE", "BEEN", "HAVE", "WILL", "CAN", "MAY", "COULD", "WOULD",
    "SHOULD", "GET", "GOT", "SAY", "SAID", "MAKE", "MADE", "KNOW", "SHOW", "TELL", "GIVE", "FIND", "LOOK", "WANT",
    "NEED", "CALL", "COME", "TAKE", "KEEP", "SEEM", "FEEL", "MEAN", "HELP", "PUT", "LAST", "NEXT", "NEW", "OLD",
    "BIG", "JUST", "ALSO", "ONLY", "MOST", "MORE", "LESS", "SOME", "VERY", "WELL", "BEST", "GOOD", "HIGH", "LOW",
    "TOP", "KEY", "LONG", "FULL", "HALF", "DAY", "YEAR", "DATE", "TIME", "WEEK", "MONTH", "NEWS", "STOCK", "SHARE",
    "PRICE", "MARKET", "FUND", "FIRM", "BOARD", "TEAM", "PLAN", "DEAL", "LIST", "FETCH", "INGEST", "SAVE", "STORE",
    "SEARCH", "QUERY", "ANALYSE", "ANALYZE", "INTERPRET", "REVIEW", "READ", "ABOUT", "RECENT", "LATEST", "ASX",
    "CEO", "CFO", "COO", "CTO", "EPS", "DPS", "IPO", "FY", "HY", "GDP", "ROI", "ESG", "FCF", "EBIT", "NPAT",
    "CAPEX", "OPEX", "P&L", "NAV", "NTA", "YOY", "MOM", "ETF", "LTD", "PTY", "INC", "LLC", "PLC", "USD", "AUD",
    "NZD", "EUR", "GBP",
]

DEFAULT_COUNT, MAX_COUNT = 20, 50


def use_case(message: Column) -> Column:
    text = F.lower(message)
    chain = F
    for name, words in USE_CASES:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        chain = chain.when(hit, name)
    return chain.otherwise("generic")


def _has(message: Column, pattern: str) -> Column:
    return message.rlike("(?iU)" + pattern)


def route(message: Column) -> Column:
    chain = F
    for name, pattern in ROUTES:
        chain = chain.when(_has(message, pattern), name)
    return chain.otherwise("chat")


def tagged_ticker(message: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(message, "(?i)" + TICKER_TAG, 1)), F.lit(""))


def _first_ticker(message: Column, pattern: str) -> Column:
    words = F.transform(F.regexp_extract_all(message, F.lit("(?U)" + pattern), F.lit(1)), F.upper)
    stop = F.array(*map(F.lit, NOT_TICKERS))
    return F.try_element_at(F.filter(words, lambda w: ~F.array_contains(stop, w)), F.lit(1))


def ticker(message: Column) -> Column:
    """Tag, then upper-case words, then any words: in financial context first."""
    anywhere = _first_ticker(message, ANY_WORD)
    return F.coalesce(
        tagged_ticker(message), _first_ticker(message, UPPER_WORD),
        F.when(_has(message, FINANCIAL_CONTEXT), anywhere), anywhere)


def wanted_count(message: Column) -> Column:
    """First number in the message, between 1 and the maximum."""
    number = F.nullif(F.regexp_extract(message, r"(?U)\b([0-9]+)\b", 1), F.lit(""))
    asked = F.when(F.length(number) > 9, F.lit(MAX_COUNT)).otherwise(number.cast("int"))
    return F.greatest(F.lit(1), F.least(F.coalesce(asked, F.lit(DEFAULT_COUNT)), F.lit(MAX_COUNT)))


def announcement_intent(message: Column) -> Column:
    return (
        F.when(_has(message, INGEST_WORDS), "ingest").when(_has(message, SIGNAL_WORDS), "signal")
        .when(_has(message, FETCH_WORDS) & ~_has(message, INTERPRET_WORDS), "fetch").otherwise("interpret"))


def database_tag(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"(?iU)\[db:(\w+)\]", 1), F.lit(""))


# Exchange code and label per ticker suffix.
EXCHANGE_CODES = {".AX": "AU", "": "US", ".US": "US", ".L": "LSE", ".TO": "TO", ".HK": "HK", ".NZ": "NZ", ".SI": "SG"}
EXCHANGE_LABELS = {
    ".AX": "ASX (Australian Securities Exchange)",
    ".L": "LSE (London Stock Exchange)",
    ".TO": "TSX (Toronto Stock Exchange)",
    ".HK": "HKEX (Hong Kong Stock Exchange)",
    "": "NYSE / NASDAQ",
}


def _from_table(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def exchange_code(suffix: Column) -> Column:
    return F.coalesce(_from_table(suffix, EXCHANGE_CODES), F.upper(F.regexp_replace(suffix, r"^\.+", "")))


def exchange_label(suffix: Column) -> Column:
    return F.coalesce(_from_table(suffix, EXCHANGE_LABELS), F.concat(F.lit("Exchange suffix: "), suffix))
