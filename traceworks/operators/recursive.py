"""Recursive averages over whole series of any length, as a parallel scan.

y' = (1 - a) * y + a * x is an affine map of y, and affine maps compose: what a slice of a series does to the state in
front of it is known from the slice alone. So a series (ticker, tf) is cut into time slices of about ``SLICE_BARS``
bars; every slice is folded by itself, starting from zero; the few slice maps of a series are applied one after the
other, which gives the state in front of each slice; where values per bar are wanted, every slice then runs from its
state. No task sees more than one slice's bars or one series' slice maps, and nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceworks.operators.indicators import SERIES, bollinger, labelled, mean_of, newest_bars

#: Seconds from bar to bar, and bars in a slice of a series without gaps.
BAR_SECONDS = {"5m": 300, "30m": 1800, "1h": 3600, "1d": 86_400}
SLICE_BARS = 2000
SPANS = (9, 21, 50, 200)
FAST, SLOW, SIGNAL, PERIOD, BAND = 12, 26, 9, 14, 20
_AF, _AS, _AG = (2.0 / (s + 1) for s in (FAST, SLOW, SIGNAL))
_KEEP = 1 - 1.0 / PERIOD
#: Averages of the close itself; they start at the first close.
_DECAYS = {**{f"e{s}": 1 - 2.0 / (s + 1) for s in SPANS}, "f": 1 - _AF, "s": 1 - _AS}


def with_slice(bars: DataFrame, slice_bars: int = SLICE_BARS) -> DataFrame:
    width = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BAR_SECONDS.items() for x in kv]), F.col("tf")),
                       F.lit(min(BAR_SECONDS.values()))) * slice_bars
    return bars.where("close is not null and ts is not null").withColumn(
        "slice", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / width))


def slice_maps(bars: DataFrame, slice_bars: int = SLICE_BARS) -> DataFrame:
    """One row per slice: bars ``n``, first and last close, the ``tail`` of closes, and what the fold from zero gives.

    The first bar's change is left to the step that knows the close before the slice.
    """
    rows = with_slice(bars, slice_bars).groupBy(*SERIES, "slice").agg(
        F.sort_array(F.collect_list(F.struct("ts", "close"))).alias("b")).select(
        *SERIES, "slice", F.col("b.close").alias("closes"))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in (*_DECAYS, "g", "gain", "loss")], F.lit(None).cast("double").alias("p"))

    def step(y: Column, x: Column) -> Column:
        new = {k: y[k] * keep + x * (1 - keep) for k, keep in _DECAYS.items()}
        change = F.coalesce(x - y["p"], F.lit(0.0))
        return F.struct(*[v.alias(k) for k, v in new.items()],
                        (y["g"] * (1 - _AG) + (new["f"] - new["s"]) * _AG).alias("g"),
                        (y["gain"] * _KEEP + F.greatest(change, F.lit(0.0))).alias("gain"),
                        (y["loss"] * _KEEP + F.greatest(-change, F.lit(0.0))).alias("loss"), x.alias("p"))

    closes = F.col("closes")
    return rows.select(*SERIES, "slice", F.size(closes).cast("long").alias("n"), closes[0].alias("first"),
                       F.element_at(closes, -1).alias("last"),
                       F.slice(closes, -F.least(F.size(closes), F.lit(BAND - 1)), F.lit(BAND - 1)).alias("tail"),
                       F.aggregate(closes, zero, step).alias("y"))


_STATE = [*_DECAYS, "g", "gain", "loss"]


def _through(before: Column, s: Column) -> Column:
    """The state behind a slice, from the state in front of it and the slice's map."""
    n = s["n"].cast("double")
    start = {k: F.coalesce(before[k], s["first"] if k in _DECAYS else F.lit(0.0)) for k in _STATE}
    power = {k: F.pow(F.lit(keep), n) for k, keep in _DECAYS.items()}
    pg = F.pow(F.lit(1 - _AG), n)

    def carried(k: str) -> Column:
        """What the average in front of the slice adds to the signal behind it."""
        return start[k] * (_AG * _DECAYS[k] / ((1 - _AG) - _DECAYS[k])) * (pg - power[k])

    change = F.coalesce(s["first"] - before["p"], F.lit(0.0)) * F.pow(F.lit(_KEEP), n - 1)
    kept = F.pow(F.lit(_KEEP), n)
    out = {k: start[k] * power[k] + s["y"][k] for k in _DECAYS}
    out |= {"g": start["g"] * pg + carried("f") - carried("s") + s["y"]["g"],
            "gain": start["gain"] * kept + s["y"]["gain"] + F.greatest(change, F.lit(0.0)),
            "loss": start["loss"] * kept + s["y"]["loss"] + F.greatest(-change, F.lit(0.0))}
    tail = F.concat(before["tail"], s["tail"])
    return F.struct(*[out[k].alias(k) for k in _STATE], s["last"].alias("p"), (before["n"] + s["n"]).alias("n"),
                    F.slice(tail, -F.least(F.size(tail), F.lit(BAND - 1)), F.lit(BAND - 1)).alias("tail"))


def _nothing() -> Column:
    return F.struct(*[F.lit(None).cast("double").alias(k) for k in _STATE], F.lit(None).cast("double").alias("p"),
                    F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("tail"))


def _ordered(maps: DataFrame) -> DataFrame:
    return maps.groupBy(*SERIES).agg(F.sort_array(F.collect_list(
        F.struct("slice", "n", "first", "last", "tail", "y"))).alias("slices"))


def last_states(maps: DataFrame) -> DataFrame:
    """One row per series: the state behind its last bar."""
    return _ordered(maps).select(*SERIES, F.aggregate("slices", _nothing(), _through).alias("y"))


def states_before(maps: DataFrame) -> DataFrame:
    """One row per slice: the state in front of it (null averages before the first)."""
    start = F.struct(_nothing().alias("y"), F.array().cast(_states_type()).alias("all"))

    def step(acc: Column, s: Column) -> Column:
        here = F.struct(s["slice"].alias("slice"), acc["y"].alias("y"))
        return F.struct(_through(acc["y"], s).alias("y"), F.concat(acc["all"], F.array(here)).alias("all"))

    return _ordered(maps).select(*SERIES, F.explode(F.aggregate("slices", start, step, lambda acc: acc["all"])).alias("s")).select(
        *SERIES, "s.slice", "s.y")


def _states_type() -> str:
    fields = ", ".join(f"{k}: double" for k in [*_STATE, "p"])
    return f"array<struct<slice: bigint, y: struct<{fields}, n: bigint, tail: array<double>>>>"


def rsi_of(gain: Column, loss: Column) -> Column:
    return F.when(loss > 0, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + gain / loss))


def whole_series_indicators(bars: DataFrame, slice_bars: int = SLICE_BARS) -> DataFrame:
    """The indicator record of every (ticker, tf) over all its bars, however many."""
    states = last_states(slice_maps(bars, slice_bars))
    newest = newest_bars(bars.where("close is not null and ts is not null"), dict.fromkeys(BAR_SECONDS, BAND + 1)).groupBy(*SERIES).agg(
        F.sort_array(F.collect_list(F.struct("ts", "close", "volume"))).alias("b"))
    n, closes, volumes, y = F.col("y.n"), F.col("b.close"), F.col("b.volume"), F.col("y")

    def from_bars(least: int, value: Column) -> Column:
        return F.when(n >= least, value)

    line = y["f"] - y["s"]
    return labelled(states.join(newest, SERIES).select(
        *SERIES, n.alias("n"), F.element_at(closes, -1).alias("price"), F.try_element_at(closes, F.lit(-2)).alias("prev"),
        from_bars(PERIOD + 1, rsi_of(y["gain"], y["loss"])).alias("r"),
        from_bars(SLOW, F.struct(line.alias("line"), y["g"].alias("signal"), (line - y["g"]).alias("hist"))).alias("m"),
        from_bars(BAND, bollinger(closes)).alias("b"),
        *[from_bars(s, y[f"e{s}"]).alias(f"e{s}") for s in SPANS],
        F.element_at(volumes, -1).cast("bigint").alias("volume"),
        from_bars(BAND + 1, mean_of(F.slice(volumes, -21, 20).cast("array<double>"))).alias("avg_vol")))


def whole_series(bars: DataFrame, slice_bars: int = SLICE_BARS) -> DataFrame:
    """RSI, MACD, bands and averages of every bar; a slice runs from the state in front of it."""
    schema = ("ticker string, tf string, ts timestamp_ntz, close double, rsi double, macd double, macd_signal double, "
              "bb_upper double, bb_lower double, ema_21 double, ema_50 double, ema_200 double")
    states = states_before(slice_maps(bars, slice_bars))

    def per_slice(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ts").reset_index(drop=True)
        close, y = pdf["close"], pdf["y"].iloc[0]
        first, place = y["n"] == 0, pd.Series(range(1, len(pdf) + 1)) + y["n"]

        def run(values, keep, start):
            """The recursion over a slice that begins behind ``start``."""
            return pd.concat([pd.Series([start]), values]).ewm(alpha=1 - keep, adjust=False).mean().iloc[1:].reset_index(drop=True)

        e = {k: run(close, keep, close.iloc[0] if first else y[k]) for k, keep in _DECAYS.items()}
        change = close.diff()
        change.iloc[0] = 0.0 if first else close.iloc[0] - y["p"]
        gain, loss = (run(c.clip(lower=0) * PERIOD, _KEEP, 0.0 if first else y[k]) for c, k in ((change, "gain"), (-change, "loss")))
        known = pd.concat([pd.Series(list(y["tail"]), dtype=float), close])
        middle, spread = (getattr(known.rolling(BAND), how)().iloc[len(y["tail"]):].reset_index(drop=True) for how in ("mean", "std"))
        out = pdf[["ticker", "tf", "ts", "close"]].copy()
        out["rsi"] = (100 - 100 / (1 + gain / loss.where(loss > 0))).where(place > PERIOD)
        out["macd"] = e["f"] - e["s"]
        out["macd_signal"] = run(out["macd"], 1 - _AG, 0.0 if first else y["g"])
        out["bb_upper"], out["bb_lower"] = middle + 2 * spread, middle - 2 * spread
        for s in (21, 50, 200):
            out[f"ema_{s}"] = e[f"e{s}"]
        return out

    rows = with_slice(bars, slice_bars).select(*SERIES, "slice", "ts", "close").join(states, [*SERIES, "slice"])
    return rows.groupBy(*SERIES, "slice").applyInPandas(per_slice, schema)
