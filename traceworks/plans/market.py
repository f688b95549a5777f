"""Watchlist signals, market context and indicator text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceworks.operators.indicators import clean_bars, indicators, price_changes, truthy

# Ticker, sector fund, commodity, its label, currency pair, its label, sector label.
TICKER_CONTEXT = [
    ("BHP", "XMM.AX", "IRON30Y=EX", "Iron Ore", "AUDUSD=X", "AUD/USD", "ASX Materials"),
    ("RIO", "XMM.AX", "IRON30Y=EX", "Iron Ore", "AUDUSD=X", "AUD/USD", "ASX Materials"),
    ("FMG", "XMM.AX", "IRON30Y=EX", "Iron Ore", "AUDUSD=X", "AUD/USD", "ASX Materials"),
    ("MIN", "XMM.AX", "LIT", "Lithium ETF", "AUDUSD=X", "AUD/USD", "ASX Materials"),
    ("S32", "XMM.AX", "GC=F", "Gold", "AUDUSD=X", "AUD/USD", "ASX Materials"),
    ("NST", "XGD.AX", "GC=F", "Gold", "AUDUSD=X", "AUD/USD", "ASX Gold"),
    ("NCM", "XGD.AX", "GC=F", "Gold", "AUDUSD=X", "AUD/USD", "ASX Gold"),
    ("EVN", "XGD.AX", "GC=F", "Gold", "AUDUSD=X", "AUD/USD", "ASX Gold"),
    ("WDS", "XEJ.AX", "CL=F", "Crude Oil", "AUDUSD=X", "AUD/USD", "ASX Energy"),
    ("STO", "XEJ.AX", "CL=F", "Crude Oil", "AUDUSD=X", "AUD/USD", "ASX Energy"),
    ("BPT", "XEJ.AX", "CL=F", "Crude Oil", "AUDUSD=X", "AUD/USD", "ASX Energy"),
    ("CBA", "XFJ.AX", None, None, "AUDUSD=X", "AUD/USD", "ASX Financials"),
    ("ANZ", "XFJ.AX", None, None, "AUDUSD=X", "AUD/USD", "ASX Financials"),
    ("NAB", "XFJ.AX", None, None, "AUDUSD=X", "AUD/USD", "ASX Financials"),
    ("WBC", "XFJ.AX", None, None, "AUDUSD=X", "AUD/USD", "ASX Financials"),
    ("MQG", "XFJ.AX", None, None, "AUDUSD=X", "AUD/USD", "ASX Financials"),
    ("CSL", "XHJ.AX", None, None, "AUDUSD=X", "AUD/USD", "ASX Healthcare"),
    ("RMD", "XHJ.AX", None, None, "AUDUSD=X", "AUD/USD", "ASX Healthcare"),
    ("WTC", "XTJ.AX", None, None, "AUDUSD=X", "AUD/USD", "ASX Technology"),
    ("XRO", "XTJ.AX", None, None, "AUDUSD=X", "AUD/USD", "ASX Technology"),
    ("NVDA", "SOXX", None, None, None, None, "US Semiconductors"),
    ("AMD", "SOXX", None, None, None, None, "US Semiconductors"),
    ("INTC", "SOXX", None, None, None, None, "US Semiconductors"),
    ("QCOM", "SOXX", None, None, None, None, "US Semiconductors"),
    ("AVGO", "SOXX", None, None, None, None, "US Semiconductors"),
    ("MU", "SOXX", None, None, None, None, "US Semiconductors"),
    ("AMAT", "SOXX", None, None, None, None, "US Semiconductors"),
    ("AAPL", "QQQ", None, None, None, None, "US Mega-cap Tech"),
    ("MSFT", "QQQ", None, None, None, None, "US Mega-cap Tech"),
    ("GOOGL", "QQQ", None, None, None, None, "US Mega-cap Tech"),
    ("AMZN", "QQQ", None, None, None, None, "US Mega-cap Tech"),
    ("META", "QQQ", None, None, None, None, "US Mega-cap Tech"),
    ("TSLA", "XLY", "LIT", "Lithium ETF", None, None, "US Consumer Discretionary / EV"),
    ("XOM", "XLE", "CL=F", "WTI Crude", None, None, "US Energy"),
    ("CVX", "XLE", "CL=F", "WTI Crude", None, None, "US Energy"),
    ("COP", "XLE", "CL=F", "WTI Crude", None, None, "US Energy"),
    ("JPM", "XLF", None, None, None, None, "US Financials"),
    ("BAC", "XLF", None, None, None, None, "US Financials"),
    ("GS", "XLF", None, None, None, None, "US Financials"),
    ("MS", "XLF", None, None, None, None, "US Financials"),
]

# Signal labels.
STRONG_BUY, BUY, STRONG_SELL, SELL, HOLD = (
    "🟢 STRONG BUY", "🟩 BUY", "🔴 STRONG SELL", "🟥 SELL", "⬜ HOLD/NEUTRAL")


def watchlist(bars: DataFrame) -> DataFrame:
    """Daily indicator rows with a composite signal; bullish votes are read first."""
    def votes(*conds: Column) -> Column:
        return sum((F.when(c, 1).otherwise(0) for c in conds), F.lit(0))

    r, bb = F.col("rsi"), F.col("bb_pct")
    rows = indicators(clean_bars(bars.where("tf = '1d'")))
    scored = rows.withColumns({
        "bullish": votes(truthy(r) & (r < 40), F.col("macd_label") == "BULLISH", F.col("trend") == "UPTREND",
                         bb < 0.20),
        "bearish": votes(truthy(r) & (r > 65), F.col("macd_label") == "BEARISH", F.col("trend") == "DOWNTREND",
                         bb > 0.80),
    })
    up, down = F.col("bullish"), F.col("bearish")
    signal = (F.when(up >= 3, STRONG_BUY).when(up == 2, BUY).when(down >= 3, STRONG_SELL)
              .when(down == 2, SELL).otherwise(HOLD))
    return scored.select("ticker", "current_price", "change_pct", "trend", "rsi", "macd_label", "bb_pct",
                         "vol_ratio", "bullish", "bearish", signal.alias("signal"))


def context_table(spark: SparkSession) -> DataFrame:
    """The fixed ticker context, a few dozen rows."""
    return spark.createDataFrame(
        TICKER_CONTEXT, "ticker string, sector_etf string, commodity string, commodity_label string, fx string, "
                        "fx_label string, sector_label string")


def market_context(bars: DataFrame) -> DataFrame:
    """Each ticker's price changes beside those of its sector fund, commodity and
    currency pair; a ticker without context has its own changes only. The
    context side is a fixed small table."""
    changes = price_changes(bars)

    def beside(symbol: str) -> DataFrame:
        return changes.select(F.col("ticker").alias(symbol), F.col("chg_1d").alias(f"{symbol}_1d"),
                              F.col("chg_5d").alias(f"{symbol}_5d"), F.col("chg_1m").alias(f"{symbol}_1m"))

    known = changes.join(F.broadcast(context_table(bars.sparkSession)), "ticker", "left")
    for symbol in ("sector_etf", "commodity", "fx"):
        known = known.join(beside(symbol), symbol, "left")
    return known


def indicator_text(rows: DataFrame) -> DataFrame:
    """The indicator record as a short text block per (ticker, tf)."""
    def num(fmt: str, *cols: str) -> Column:
        return F.format_string(fmt, *[F.col(c) for c in cols])

    labels = {"5m": "5-Minute", "30m": "30-Minute", "1h": "1-Hour", "1d": "Daily"}
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]),
                                        F.col("tf")), F.col("tf"))
    change = F.coalesce(F.concat(F.when(F.col("change_pct") > 0, "+").otherwise(""),
                                 F.col("change_pct").cast("string"), F.lit("%")), F.lit("N/A"))
    emas = F.concat_ws(" | ", *[
        F.when(F.col(f"ema_{s}").isNotNull(), num(f"EMA{s}: $%.4f", f"ema_{s}")) for s in (9, 21, 50, 200)])
    lines = [
        F.concat(F.lit("["), label, F.lit("]")),
        F.concat(num("  Price : $%.4f", "current_price"), F.lit("  Change: "), change,
                 F.lit("  Trend: "), F.col("trend")),
        F.when(truthy(F.col("rsi")), F.concat(F.lit("  RSI(14): "), F.col("rsi").cast("string"), F.lit(" — "),
                                              F.col("rsi_label"))).otherwise("  RSI(14): N/A (< 14 bars)"),
        F.when(F.col("macd_line").isNotNull(),
               F.concat(num("  MACD: %+.5f | Sig: %+.5f | Hist: %+.5f — ", "macd_line", "macd_signal", "macd_hist"),
                        F.coalesce("macd_label", F.lit("None")))).otherwise("  MACD: N/A (< 26 bars)"),
        F.when(F.col("bb_upper").isNotNull(),
               F.concat(num("  BB: Upper $%.4f / Mid $%.4f / Lower $%.4f  BB%%: ", "bb_upper", "bb_middle",
                            "bb_lower"), F.coalesce(num("%.2f — ", "bb_pct"), F.lit("N/A")),
                        F.coalesce("bb_label", F.lit("")))).otherwise("  BB: N/A (< 20 bars)"),
        F.concat(F.lit("  "), F.coalesce(F.nullif(emas, F.lit("")), F.lit("EMAs: N/A"))),
        F.concat(F.lit("  Vol: "), F.format_number("volume", 0),
                 F.coalesce(F.concat(F.lit(" ("), F.col("vol_ratio").cast("string"), F.lit("× 20-bar avg)")),
                            F.lit(""))),
    ]
    missing = F.concat(F.lit("["), label, F.lit("] DATA UNAVAILABLE (price fetch failed or insufficient history)"))
    return rows.select(
        "ticker", "tf",
        F.when(F.col("current_price").isNull(), missing).otherwise(F.concat_ws("\n", *lines)).alias("block"))
