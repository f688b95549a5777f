import datetime as dt

import numpy as np
import pandas as pd
import pytest

from traceworks.operators import indicators as ind
from traceworks.operators import recursive
from traceworks.plans import market

SCHEMA = "ticker string, tf string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"


def bars(spark, ticker, closes, tf="1d"):
    start = dt.datetime(2023, 1, 1)
    return spark.createDataFrame(
        [(ticker, tf, start + dt.timedelta(days=i), c, c, c, c, 100 + i) for i, c in enumerate(closes)], SCHEMA)


@pytest.mark.parametrize("n", [5, 14, 15, 20, 26, 60, 250, 700])
def test_indicators_match_pandas(spark, n):
    rng = np.random.default_rng(n)
    closes = (100 + rng.normal(0, 1, n).cumsum()).tolist()
    got = ind.indicators(bars(spark, "T", closes)).first()
    s = pd.Series(closes[-500:])
    k = len(s)
    delta = s.diff()
    gain = delta.clip(lower=0).ewm(com=13, min_periods=14).mean()
    loss = (-delta).clip(lower=0).ewm(com=13, min_periods=14).mean()
    rsi = (100 - 100 / (1 + gain / loss)).dropna()
    assert got["rsi"] == (pytest.approx(rsi.iloc[-1], abs=0.006) if k >= 14 and len(rsi) else None)
    macd = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    signal = macd.ewm(span=9, adjust=False).mean()
    if k >= 26:
        assert got["macd_line"] == pytest.approx(macd.iloc[-1], abs=1e-5)
        assert got["macd_signal"] == pytest.approx(signal.iloc[-1], abs=1e-5)
    else:
        assert got["macd_line"] is None
    for span in (9, 21, 50, 200):
        want = s.ewm(span=span, adjust=False).mean().iloc[-1] if k >= span else None
        assert got[f"ema_{span}"] == (None if want is None else pytest.approx(want, abs=1e-4))
    if k >= 20:
        assert got["bb_upper"] == pytest.approx(s.tail(20).mean() + 2 * s.tail(20).std(), abs=1e-4)


def test_series_end_on_the_record(spark):
    closes = [100 + (i * 37 % 11) for i in range(80)]
    df = bars(spark, "T", [float(c) for c in closes])
    last = ind.indicator_series(df).toPandas().sort_values("ts").iloc[-1]
    record = ind.indicators(df).first()
    assert last["rsi"] == pytest.approx(record["rsi"], abs=0.006)
    assert last["macd_signal"] == pytest.approx(record["macd_signal"], abs=1e-5)


def test_rising_series_has_no_rsi_and_flat_labels(spark):
    got = ind.indicators(bars(spark, "T", [float(i) for i in range(1, 61)])).first()
    assert got["rsi"] is None and got["rsi_label"] is None
    assert (got["macd_label"], got["trend"]) == ("BULLISH", "UPTREND")


def test_short_series_are_dropped_and_missing_frames_listed(spark):
    df = bars(spark, "A", [1.0] * 14).unionByName(bars(spark, "B", [float(i % 5 + 1) for i in range(40)]))
    rows = {(r["ticker"], r["tf"]): r for r in ind.all_timeframes(df).collect()}
    assert len(rows) == 8 and rows["A", "1d"]["n"] is None and rows["B", "1d"]["n"] == 40
    text = {(r["ticker"], r["tf"]): r["block"] for r in market.indicator_text(ind.all_timeframes(df)).collect()}
    assert "DATA UNAVAILABLE" in text["A", "5m"] and text["B", "1d"].startswith("[Daily]\n  Price : $")


def test_price_changes(spark):
    got = ind.price_changes(bars(spark, "T", [float(c) for c in range(100, 130)])).first()
    assert (got["price"], got["chg_1d"], got["chg_5d"], got["chg_1m"]) == (129.0, 0.78, 4.03, 19.44)


@pytest.mark.parametrize("slice_bars", [3, 50, 2000])
def test_whole_series_equal_the_sequential_form(spark, slice_bars):
    rng = np.random.default_rng(4)
    closes = (100 + rng.normal(0, 1, 700).cumsum()).tolist()
    df = bars(spark, "T", closes).unionByName(bars(spark, "U", closes[:13])).unionByName(
        bars(spark, "V", closes[::-1], "5m")).repartition(5)
    rows = recursive.whole_series(df, slice_bars).toPandas()
    record = {r["ticker"]: r for r in recursive.whole_series_indicators(df, slice_bars).collect()}
    for ticker, values in (("T", closes), ("U", closes[:13]), ("V", closes[::-1])):
        s = pd.Series(values)
        delta = s.diff()
        gain, loss = (d.clip(lower=0).ewm(com=13, min_periods=14).mean() for d in (delta, -delta))
        macd = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
        want = {"rsi": 100 - 100 / (1 + gain / loss), "macd": macd, "macd_signal": macd.ewm(span=9, adjust=False).mean(),
                "bb_upper": s.rolling(20).mean() + 2 * s.rolling(20).std(), "bb_lower": s.rolling(20).mean() - 2 * s.rolling(20).std(),
                **{f"ema_{n}": s.ewm(span=n, adjust=False).mean() for n in (21, 50, 200)}}
        got = rows[rows.ticker == ticker].sort_values("ts").reset_index(drop=True)
        assert len(got) == len(s)
        for name, values in want.items():
            np.testing.assert_allclose(got[name].astype(float), values, rtol=1e-9, atol=1e-9, equal_nan=True)
        assert record[ticker]["n"] == len(s)
        if len(s) > 200:
            assert record[ticker]["ema_200"] == pytest.approx(want["ema_200"].iloc[-1], abs=1e-4)
            assert record[ticker]["rsi"] == pytest.approx(want["rsi"].iloc[-1], abs=0.006)
            assert record[ticker]["macd_signal"] == pytest.approx(want["macd_signal"].iloc[-1], abs=1e-5)


def test_an_intraday_series_beyond_the_cut_has_its_long_average(spark):
    df = bars(spark, "T", [100.0 + i % 7 for i in range(400)], "5m")
    assert ind.indicators(df).first()["ema_200"] is None
    record = recursive.whole_series_indicators(df, 60).first()
    assert record["n"] == 400 and record["ema_200"] is not None
