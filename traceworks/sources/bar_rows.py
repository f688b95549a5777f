"""Rows of price services as bars: ticker, tf, ts, open, high, low, close, volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAR_VALUES = ["open", "high", "low", "close", "volume"]
# One-letter names of bar values in rows with a time in epoch milliseconds.
SHORT_NAMES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}


def _required(rows: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"bars lack the columns {', '.join(missing)}")


def _bars(rows: DataFrame) -> DataFrame:
    return rows.where("ts is not null and close is not null").select("ticker", "tf", "ts", *BAR_VALUES)


def dated_bars(rows: DataFrame, tf: str = "1d") -> DataFrame:
    """Bars from rows with a text time: ``date`` for daily rows, ``datetime`` (UTC) for others.

    Daily rows close at ``adjusted_close`` where there is such a column; rows without a close or a readable time go.
    """
    time = "date" if tf == "1d" else "datetime"
    _required(rows, ["ticker", time, *BAR_VALUES])
    if tf == "1d" and "adjusted_close" in rows.columns:
        rows = rows.withColumn("close", F.col("adjusted_close"))
    return _bars(rows.withColumns({
        "tf": F.lit(tf), "ts": F.try_to_timestamp(F.col(time).cast("string")).cast("timestamp_ntz")}))


def epoch_bars(rows: DataFrame, tf: str) -> DataFrame:
    """Bars from rows with ``t`` in milliseconds since 1970 (UTC) and one-letter names."""
    _required(rows, ["ticker", "t", *SHORT_NAMES])
    named = rows.withColumnsRenamed(SHORT_NAMES)
    return _bars(named.withColumns({"tf": F.lit(tf), "ts": F.timestamp_millis("t").cast("timestamp_ntz")}))
