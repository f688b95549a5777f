"""Technical indicators over price bars.

Bars are keyed (ticker, tf, ts). Each series is cut to its newest bars before
it is gathered, at most 500 per key, so the arrays below stay small whatever
the length of the history; the cut itself is applied per task before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bars kept per timeframe, and the least that make a series.
BAR_LIMITS = {"5m": 120, "30m": 120, "1h": 120, "1d": 500}
TIMEFRAMES = list(BAR_LIMITS)
MIN_BARS = 15

SERIES = ["ticker", "tf"]


def newest_bars(bars: DataFrame, limits: dict[str, int] = BAR_LIMITS) -> DataFrame:
    """The newest bars of every series, at most the limit of its timeframe."""
    newest = Window.partitionBy(*SERIES).orderBy(F.desc("ts"))
    ranked = bars.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= max(limits.values()))
    allowed = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("tf"))
    return ranked.where(F.col("_rn") <= allowed).drop("_rn")


def clean_bars(bars: DataFrame, limits: dict[str, int] = BAR_LIMITS, min_bars: int = MIN_BARS) -> DataFrame:
    """Bars with a close, newest ones only, of series long enough to use."""
    kept = newest_bars(bars.where(F.col("close").isNotNull()), limits)
    size = Window.partitionBy(*SERIES)
    return kept.withColumn("_n", F.count("*").over(size)).where(F.col("_n") >= min_bars).drop("_n")


def gathered(bars: DataFrame, limits: dict[str, int] = BAR_LIMITS) -> DataFrame:
    """One row per series: bar count ``n``, ``closes`` and ``volumes`` by time."""
    rows = newest_bars(bars, limits).groupBy(*SERIES).agg(
        F.sort_array(F.collect_list(F.struct("ts", "close", "volume"))).alias("b"))
    return rows.select(
        *SERIES, F.size("b").alias("n"),
        F.col("b.close").alias("closes"), F.col("b.volume").alias("volumes"))


def _rest(values: Column) -> Column:
    return F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))


def ema(values: Column, span: int) -> Column:
    """Last value of the recursive average that starts at the first value."""
    a = 2.0 / (span + 1)
    return F.aggregate(_rest(values), values[0], lambda acc, x: acc * (1 - a) + x * a)


def rsi(values: Column, period: int = 14) -> Column:
    """Relative strength over Wilder averages; needs ``period`` price changes.

    Gains and losses carry the same weights, so their normaliser cancels.
    NULL while no price has fallen.
    """
    keep = 1 - 1.0 / period
    start = F.struct(values[0].alias("p"), F.lit(0.0).alias("g"), F.lit(0.0).alias("l"))

    def step(s: Column, x: Column) -> Column:
        d = x - s["p"]
        return F.struct(x.alias("p"),
                        (s["g"] * keep + F.greatest(d, F.lit(0.0))).alias("g"),
                        (s["l"] * keep + F.greatest(-d, F.lit(0.0))).alias("l"))

    def finish(s: Column) -> Column:
        return F.when(s["l"] > 0, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + s["g"] / s["l"]))

    return F.when(F.size(values) > period, F.aggregate(_rest(values), start, step, finish))


def macd(values: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """struct(line, signal, hist) of the last bar, in one pass over the closes."""
    af, asl, asig = (2.0 / (s + 1) for s in (fast, slow, signal))
    start = F.struct(values[0].alias("f"), values[0].alias("s"), F.lit(0.0).alias("g"))

    def step(s: Column, x: Column) -> Column:
        f = s["f"] * (1 - af) + x * af
        sl = s["s"] * (1 - asl) + x * asl
        return F.struct(f.alias("f"), sl.alias("s"), (s["g"] * (1 - asig) + (f - sl) * asig).alias("g"))

    def finish(s: Column) -> Column:
        line = s["f"] - s["s"]
        return F.struct(line.alias("line"), s["g"].alias("signal"), (line - s["g"]).alias("hist"))

    return F.aggregate(_rest(values), start, step, finish)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def bollinger(values: Column, period: int = 20, width: float = 2.0) -> Column:
    """struct(upper, middle, lower) over the last ``period`` closes."""
    tail = F.slice(values, -period, period)
    mid = mean_of(tail)
    spread = F.sqrt(F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + (x - mid) * (x - mid)) / (period - 1))
    return F.struct((mid + width * spread).alias("upper"), mid.alias("middle"),
                    (mid - width * spread).alias("lower"))


def truthy(value: Column) -> Column:
    """Present and not zero."""
    return value.isNotNull() & (value != 0)


def indicators(bars: DataFrame, limits: dict[str, int] = BAR_LIMITS) -> DataFrame:
    """The 21-field indicator record of every (ticker, tf)."""
    n, closes, volumes = F.col("n"), F.col("closes"), F.col("volumes")

    def from_bars(least: int, value: Column) -> Column:
        return F.when(n >= least, value)

    raw = gathered(bars, limits).select(
        *SERIES, "n",
        F.element_at(closes, -1).alias("price"),
        F.try_element_at(closes, F.lit(-2)).alias("prev"),
        from_bars(14, rsi(closes)).alias("r"),
        from_bars(26, macd(closes)).alias("m"),
        from_bars(20, bollinger(closes)).alias("b"),
        *[from_bars(s, ema(closes, s)).alias(f"e{s}") for s in (9, 21, 50, 200)],
        F.element_at(volumes, -1).cast("bigint").alias("volume"),
        from_bars(21, mean_of(F.slice(volumes, -21, 20).cast("array<double>"))).alias("avg_vol"),
    )
    return labelled(raw)


def labelled(raw: DataFrame) -> DataFrame:
    """Rounded fields and labels of raw indicator values."""
    price, prev, r = F.col("price"), F.col("prev"), F.col("r")
    upper, lower = F.col("b.upper"), F.col("b.lower")
    e21, e50 = F.col("e21"), F.col("e50")
    bb_pct = F.when(truthy(upper) & truthy(lower) & (upper > lower),
                    F.round((price - lower) / (upper - lower), 3))
    trend = (
        F.when(truthy(e21) & truthy(e50),
               F.when((price > e21) & (e21 > e50), "UPTREND")
               .when((price < e21) & (e21 < e50), "DOWNTREND").otherwise("SIDEWAYS"))
        .when(truthy(prev), F.when(price > prev, "UPTREND").otherwise("DOWNTREND"))
        .otherwise("UNKNOWN"))
    line = F.col("m.line")
    out = raw.withColumn("bb_pct", bb_pct)
    return out.select(
        *SERIES, "n",
        price.alias("current_price"), prev.alias("prev_close"),
        F.when(truthy(prev), F.round((price - prev) / prev * 100, 2)).alias("change_pct"),
        F.round(r, 2).alias("rsi"),
        F.when(truthy(r), F.when(r > 70, "OVERBOUGHT").when(r < 30, "OVERSOLD").otherwise("NEUTRAL"))
        .alias("rsi_label"),
        F.round(line, 5).alias("macd_line"), F.round("m.signal", 5).alias("macd_signal"),
        F.round("m.hist", 5).alias("macd_hist"),
        F.when(line > 0, "BULLISH").when(line < 0, "BEARISH").alias("macd_label"),
        F.round(upper, 4).alias("bb_upper"), F.round("b.middle", 4).alias("bb_middle"),
        F.round(lower, 4).alias("bb_lower"), "bb_pct",
        F.when(F.col("bb_pct") > 0.80, "NEAR UPPER BAND").when(F.col("bb_pct") < 0.20, "NEAR LOWER BAND")
        .when(F.col("bb_pct").isNotNull(), "MID BAND").alias("bb_label"),
        *[F.round(f"e{s}", 4).alias(f"ema_{s}") for s in (9, 21, 50, 200)],
        trend.alias("trend"), "volume",
        F.when(F.col("avg_vol") > 0, F.round(F.col("volume") / F.col("avg_vol"), 2)).alias("vol_ratio"),
    )


def all_timeframes(bars: DataFrame) -> DataFrame:
    """Indicator rows of every ticker in every timeframe; missing ones are NULL."""
    wanted = bars.select("ticker").distinct().select(
        "ticker", F.explode(F.array(*map(F.lit, TIMEFRAMES))).alias("tf"))
    return wanted.join(indicators(clean_bars(bars)), SERIES, "left")


def rolling(bars: DataFrame, period: int = 20) -> DataFrame:
    """Mean, sample deviation and mean earlier volume per bar; NULL until enough bars."""
    series = Window.partitionBy(*SERIES).orderBy("ts")
    last = series.rowsBetween(1 - period, 0)
    before = series.rowsBetween(-period, -1)

    def full(value: Column, w) -> Column:
        return F.when(F.count("close").over(w) == period, value)

    return bars.select(
        *SERIES, "ts", "close",
        full(F.avg("close").over(last), last).alias("mean"),
        full(F.stddev_samp("close").over(last), last).alias("std"),
        full(F.avg("volume").over(before), before).alias("earlier_volume"),
        F.lag("close").over(series).alias("prev_close"),
    )


def price_changes(bars: DataFrame, month_bars: int = 22) -> DataFrame:
    """Per ticker: last close and its change over 1 bar, 5 bars and the window."""
    limits = {"1d": month_bars}
    closes, n = F.col("closes"), F.col("n")

    def pct(back: Column | int) -> Column:
        base = F.try_element_at(closes, (-1 - back) if isinstance(back, int) else -(back + 1))
        return F.round((F.element_at(closes, -1) - base) / base * 100, 2)

    series = gathered(bars.where("tf = '1d' and close is not null"), limits).where(n >= 2)
    return series.select(
        "ticker", F.element_at(closes, -1).alias("price"),
        pct(F.lit(1)).alias("chg_1d"),
        F.when(n > 5, pct(F.lit(5))).alias("chg_5d"),
        pct(n - 1).alias("chg_1m"))


def indicator_series(bars: DataFrame, limits: dict[str, int] = BAR_LIMITS) -> DataFrame:
    """RSI, MACD, bands and averages for every kept bar, for charting.

    Recursive series need the whole of a cut series at once; each group
    holds at most the bar limit of its timeframe.
    """
    schema = ("ticker string, tf string, ts timestamp_ntz, close double, rsi double, macd double, "
              "macd_signal double, bb_upper double, bb_lower double, ema_21 double, ema_50 double")

    def per_series(pdf):
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        close = pdf["close"]
        change = close.diff()
        gain = change.clip(lower=0).ewm(com=13, min_periods=14).mean()
        loss = (-change).clip(lower=0).ewm(com=13, min_periods=14).mean()
        fast, slow, e21, e50 = (close.ewm(span=s, adjust=False).mean() for s in (12, 26, 21, 50))
        middle, spread = close.rolling(20).mean(), close.rolling(20).std()
        out = pdf[["ticker", "tf", "ts", "close"]].copy()
        out["rsi"] = 100 - 100 / (1 + gain / loss.where(loss > 0))
        out["macd"] = fast - slow
        out["macd_signal"] = out["macd"].ewm(span=9, adjust=False).mean()
        out["bb_upper"], out["bb_lower"] = middle + 2 * spread, middle - 2 * spread
        out["ema_21"], out["ema_50"] = e21, e50
        return out

    kept = newest_bars(bars, limits).select(*SERIES, "ts", "close")
    return kept.groupBy(*SERIES).applyInPandas(per_series, schema)
