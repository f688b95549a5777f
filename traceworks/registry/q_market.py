"""Price-bar indicators, signals and market context."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceworks import fixtures as fx
from traceworks.operators import indicators as ind
from traceworks.operators import recursive
from traceworks.plans import market
from traceworks.registry.base import query, table

ALL_BARS_SQL = f"({fx.DAILY_BARS_SQL}\nunion all\n{fx.INTRADAY_BARS_SQL})"


def all_bars(spark, sf):
    return fx.daily_bars(spark, sf).unionByName(fx.intraday_bars(spark, sf))


_LIMIT = "case tf " + " ".join(f"when '{k}' then {v}" for k, v in ind.BAR_LIMITS.items()) + " end"


def newest_sql(source: str, limit: str = _LIMIT) -> str:
    return f"""(select * exclude (rn) from (select *, row_number() over (partition by ticker, tf order by ts desc)
  as rn from {source}) where rn <= {limit})"""


def gathered_sql(source: str, limit: str = _LIMIT) -> str:
    return f"""(select ticker, tf, count(*) as n, list(close order by ts) as c, list(volume order by ts) as v
  from {newest_sql(source, limit)} group by 1, 2)"""


def ema_sql(c: str, span: int) -> str:
    a = 2.0 / (span + 1)
    return f"list_reduce({c}, lambda p, x: p * {1 - a!r}::double + x * {a!r}::double)"


def indicator_sql(source: str, limit: str = _LIMIT) -> str:
    keep = repr(1 - 1.0 / 14)
    (af, asl, asg) = (2.0 / (s + 1) for s in (12, 26, 9))
    return f"""select ticker, tf, n, price as current_price, prev as prev_close,
  case when prev <> 0 then round((price - prev) / prev * 100, 2) end as change_pct,
  round(r, 2) as rsi, case when r <> 0 then case when r > 70 then 'OVERBOUGHT' when r < 30 then 'OVERSOLD'
    else 'NEUTRAL' end end as rsi_label,
  round(m.f - m.s, 5) as macd_line, round(m.g, 5) as macd_signal, round(m.f - m.s - m.g, 5) as macd_hist,
  case when m.f > m.s then 'BULLISH' when m.f < m.s then 'BEARISH' end as macd_label,
  round(up, 4) as bb_upper, round(mid, 4) as bb_middle, round(lo, 4) as bb_lower, bb_pct,
  case when bb_pct > 0.8 then 'NEAR UPPER BAND' when bb_pct < 0.2 then 'NEAR LOWER BAND'
    when bb_pct is not null then 'MID BAND' end as bb_label,
  round(e9, 4) as ema_9, round(e21, 4) as ema_21, round(e50, 4) as ema_50, round(e200, 4) as ema_200,
  case when e21 <> 0 and e50 <> 0 then case when price > e21 and e21 > e50 then 'UPTREND'
      when price < e21 and e21 < e50 then 'DOWNTREND' else 'SIDEWAYS' end
    when prev <> 0 then case when price > prev then 'UPTREND' else 'DOWNTREND' end else 'UNKNOWN' end as trend,
  volume, case when av > 0 then round(volume / av, 2) end as vol_ratio
from (select *, case when up <> 0 and lo <> 0 and up > lo then round((price - lo) / (up - lo), 3) end as bb_pct
from (select *, mid + 2 * sd as up, mid - 2 * sd as lo,
    case when w.l > 0 then 100 - 100 / (1 + w.g / w.l) end as r
from (select ticker, tf, n, c[-1] as price, case when n > 1 then c[-2] end as prev, v[-1]::bigint as volume,
  case when n >= 21 then list_avg(v[-21:-2]) end as av,
  case when n >= 20 then list_avg(c[-20:]) end as mid,
  case when n >= 20 then list_stddev_samp(c[-20:]) end as sd,
  {', '.join(f'case when n >= {s} then {ema_sql("c", s)} end as e{s}' for s in (9, 21, 50, 200))},
  case when n > 14 then list_reduce(
    list_transform(list_zip(c[:-2], c[2:]), lambda t: {{'g': greatest(t[2] - t[1], 0), 'l': greatest(t[1] - t[2], 0)}}),
    lambda p, x: {{'g': p.g * {keep}::double + x.g, 'l': p.l * {keep}::double + x.l}}) end as w,
  case when n >= 26 then list_reduce(list_transform(c, lambda x: {{'f': x, 's': x, 'g': 0.0::double}}),
    lambda p, x: {{'f': p.f * {1 - af!r}::double + x.f * {af!r}::double,
      's': p.s * {1 - asl!r}::double + x.s * {asl!r}::double,
      'g': p.g * {1 - asg!r}::double + ((p.f * {1 - af!r}::double + x.f * {af!r}::double)
        - (p.s * {1 - asl!r}::double + x.s * {asl!r}::double)) * {asg!r}::double}}) end as m
  from {gathered_sql(source, limit)})))"""


def clean_sql(source: str) -> str:
    return f"""(select * exclude (k) from (select *, count(*) over (partition by ticker, tf) as k
  from {newest_sql(source)}) where k >= 15)"""


CLEAN_SQL = clean_sql(ALL_BARS_SQL)


@query("v01_indicators", indicator_sql(ALL_BARS_SQL))
def _(spark, sf):
    return ind.indicators(all_bars(spark, sf))


@query("v02_all_timeframes", f"""select * from (select distinct ticker, unnest(['5m', '30m', '1h', '1d']) as tf
  from {ALL_BARS_SQL}) left join ({indicator_sql(CLEAN_SQL)}) using (ticker, tf)""")
def _(spark, sf):
    return ind.all_timeframes(all_bars(spark, sf))


@query("v03_clean_bars", f"select * from {CLEAN_SQL}")
def _(spark, sf):
    return ind.clean_bars(all_bars(spark, sf))


WATCH_SQL = f"""select *, case when bullish >= 3 then '{market.STRONG_BUY}' when bullish = 2 then '{market.BUY}'
  when bearish >= 3 then '{market.STRONG_SELL}' when bearish = 2 then '{market.SELL}' else '{market.HOLD}' end as signal
from (select ticker, current_price, change_pct, trend, rsi, macd_label, bb_pct, vol_ratio,
  (coalesce(rsi <> 0 and rsi < 40, false)::int + coalesce(macd_label = 'BULLISH', false)::int
    + (trend = 'UPTREND')::int + coalesce(bb_pct < 0.2, false)::int) as bullish,
  (coalesce(rsi <> 0 and rsi > 65, false)::int + coalesce(macd_label = 'BEARISH', false)::int
    + (trend = 'DOWNTREND')::int + coalesce(bb_pct > 0.8, false)::int) as bearish
from ({indicator_sql(CLEAN_SQL)}) where tf = '1d')"""


@query("v04_watchlist_signal", WATCH_SQL)
def _(spark, sf):
    return market.watchlist(all_bars(spark, sf))


# The twenty daily series under names the context table knows.
SYMBOLS = ["BHP", "CBA", "NVDA", "TSLA", "XOM", "STO", "JPM", "AAPL", "MIN", "NST", "XMM.AX", "XFJ.AX", "SOXX",
           "XLY", "XLE", "IRON30Y=EX", "LIT", "CL=F", "AUDUSD=X", "QQQ"]
_SYMBOL_CASE = "case ticker " + " ".join(f"when 'T{i}' then '{s}'" for i, s in enumerate(SYMBOLS)) + " end"
SYMBOL_BARS_SQL = f"(select * replace ({_SYMBOL_CASE} as ticker) from ({fx.DAILY_BARS_SQL}))"


def symbol_bars(spark, sf):
    return fx.daily_bars(spark, sf).withColumn("ticker", F.expr(_SYMBOL_CASE))


CHANGES_SQL = f"""(select ticker, c[-1] as price, round((c[-1] - c[-2]) / c[-2] * 100, 2) as chg_1d,
  case when n > 5 then round((c[-1] - c[-6]) / c[-6] * 100, 2) end as chg_5d,
  round((c[-1] - c[1]) / c[1] * 100, 2) as chg_1m
from {gathered_sql(SYMBOL_BARS_SQL, '22')} where n >= 2)"""


@query("w06_price_changes", f"select * from {CHANGES_SQL}")
def _(spark, sf):
    return ind.price_changes(symbol_bars(spark, sf))


def _sql_text(v):
    return "null" if v is None else f"'{v}'"


_CONTEXT_SQL = "(values " + ", ".join(
    "(" + ", ".join(map(_sql_text, row)) + ")" for row in market.TICKER_CONTEXT
) + ") k(ticker, sector_etf, commodity, commodity_label, fx, fx_label, sector_label)"
_CONTEXT_COLUMNS = "sector_etf, commodity, commodity_label, fx, fx_label, sector_label"


def _context_sql(source: str) -> str:
    joins, columns = "", ""
    for s in ("sector_etf", "commodity", "fx"):
        joins += f" left join {CHANGES_SQL} {s}_c on {s}_c.ticker = k.{s}"
        columns += f", {s}_c.chg_1d as {s}_1d, {s}_c.chg_5d as {s}_5d, {s}_c.chg_1m as {s}_1m"
    return f"""select c.*, {_CONTEXT_COLUMNS}{columns}
from {CHANGES_SQL} c left join {_CONTEXT_SQL} on k.ticker = c.ticker{joins}"""


@query("v05_market_context", _context_sql(CHANGES_SQL))
def _(spark, sf):
    return market.market_context(symbol_bars(spark, sf))


@query("j12_ticker_context", f"""select c_custkey, t as ticker, {_CONTEXT_COLUMNS}
from (select c_custkey, {_SYMBOL_CASE.replace('case ticker', "case concat('T', c_custkey % 25)")} as t from customer)
left join {_CONTEXT_SQL} on k.ticker = t""")
def _(spark, sf):
    named = table(spark, sf, "customer").select(
        "c_custkey", F.expr(_SYMBOL_CASE.replace("case ticker", "case concat('T', c_custkey % 25)")).alias("ticker"))
    return named.join(F.broadcast(market.context_table(spark)), "ticker", "left")


def _series_sql() -> str:
    """Every bar's indicators from the closes up to it."""
    keep = repr(1 - 1.0 / 14)
    (af, asl, asg) = (2.0 / (s + 1) for s in (12, 26, 9))
    f, s = f"(p.f * {1 - af!r}::double + x.f * {af!r}::double)", f"(p.s * {1 - asl!r}::double + x.s * {asl!r}::double)"
    return f"""select ticker, tf, ts, close, round(case when i > 14 and w.l > 0 then 100 - 100 / (1 + w.g / w.l) end, 4) as rsi,
  round(m.f - m.s, 4) as macd, round(m.g, 4) as macd_signal,
  round(case when i >= 20 then list_avg(h[-20:]) + 2 * list_stddev_samp(h[-20:]) end, 4) as bb_upper,
  round(case when i >= 20 then list_avg(h[-20:]) - 2 * list_stddev_samp(h[-20:]) end, 4) as bb_lower,
  round({ema_sql('h', 21)}, 4) as ema_21, round({ema_sql('h', 50)}, 4) as ema_50
from (select *, h[-1] as close, case when i > 1 then list_reduce(list_transform(list_zip(h[:-2], h[2:]),
      lambda t: {{'g': greatest(t[2] - t[1], 0), 'l': greatest(t[1] - t[2], 0)}}),
      lambda p, x: {{'g': p.g * {keep}::double + x.g, 'l': p.l * {keep}::double + x.l}}) end as w,
    list_reduce(list_transform(h, lambda x: {{'f': x, 's': x, 'g': 0.0::double}}),
      lambda p, x: {{'f': {f}, 's': {s}, 'g': p.g * {1 - asg!r}::double + ({f} - {s}) * {asg!r}::double}}) as m
  from (select ticker, tf, i, times[i] as ts, c[:i] as h from (select *, unnest(range(1, n + 1)) as i from (
    select ticker, tf, count(*) as n, list(close order by ts) as c, list(ts order by ts) as times
    from {newest_sql(ALL_BARS_SQL)} group by 1, 2))))"""


@query("v06_indicator_series", _series_sql())
def _(spark, sf):
    series = ind.indicator_series(all_bars(spark, sf))
    numbers = ["rsi", "macd", "macd_signal", "bb_upper", "bb_lower", "ema_21", "ema_50"]
    return series.withColumns({c: F.round(c, 4) for c in numbers})


_EMA_TEXT = "nullif(concat_ws(' | ', " + ", ".join(
    f"case when ema_{s} is not null then printf('EMA{s}: $%.4f', ema_{s}) end" for s in (9, 21, 50, 200)) + "), '')"
_LABEL_SQL = "case tf when '5m' then '5-Minute' when '30m' then '30-Minute' when '1h' then '1-Hour' when '1d' then 'Daily' end"


@query("v07_indicator_text", f"""select ticker, tf, case when current_price is null
  then '[' || {_LABEL_SQL} || '] DATA UNAVAILABLE (price fetch failed or insufficient history)'
  else concat_ws(chr(10), '[' || {_LABEL_SQL} || ']',
    printf('  Price : $%.4f', current_price) || '  Change: ' || coalesce(case when change_pct > 0 then '+' else '' end
      || change_pct || '%', 'N/A') || '  Trend: ' || trend,
    case when rsi <> 0 then '  RSI(14): ' || rsi || ' — ' || rsi_label else '  RSI(14): N/A (< 14 bars)' end,
    case when macd_line is not null then printf('  MACD: %+.5f | Sig: %+.5f | Hist: %+.5f — ', macd_line, macd_signal, macd_hist)
      || coalesce(macd_label, 'None') else '  MACD: N/A (< 26 bars)' end,
    case when bb_upper is not null then printf('  BB: Upper $%.4f / Mid $%.4f / Lower $%.4f  BB%%: ', bb_upper, bb_middle, bb_lower)
      || coalesce(printf('%.2f — ', sign(bb_pct) * floor(round(abs(bb_pct) * 1000) / 10 + 0.5) / 100), 'N/A') || coalesce(bb_label, '') else '  BB: N/A (< 20 bars)' end,
    '  ' || coalesce({_EMA_TEXT}, 'EMAs: N/A'),
    '  Vol: ' || format('{{:,}}', volume) || coalesce(' (' || vol_ratio || '× 20-bar avg)', '')) end as block
from (select * from (select distinct ticker, unnest(['5m', '30m', '1h', '1d']) as tf from {ALL_BARS_SQL})
  left join ({indicator_sql(CLEAN_SQL)}) using (ticker, tf))""")
def _(spark, sf):
    return market.indicator_text(ind.all_timeframes(all_bars(spark, sf)))


_SERIES = "over (partition by ticker, tf order by ts"
ROLLING_SQL = f"""select ticker, tf, ts, close,
  round(case when count(close) {_SERIES} rows 19 preceding) = 20 then avg(close) {_SERIES} rows 19 preceding) end, 4) as mean,
  round(case when count(close) {_SERIES} rows 19 preceding) = 20
    then stddev_samp(close) {_SERIES} rows 19 preceding) end, 4) as std,
  round(case when count(close) {_SERIES} rows between 20 preceding and 1 preceding) = 20
    then avg(volume) {_SERIES} rows between 20 preceding and 1 preceding) end, 4) as earlier_volume,
  lag(close) {_SERIES}) as prev_close from ({fx.DAILY_BARS_SQL})"""


@query("w05_rolling_mean_std", ROLLING_SQL)
def _(spark, sf):
    rows = ind.rolling(fx.daily_bars(spark, sf))
    return rows.withColumns({c: F.round(c, 4) for c in ("mean", "std", "earlier_volume")})


@query("w07_earlier_volume_mean", f"select ticker, tf, ts, earlier_volume from ({ROLLING_SQL})")
def _(spark, sf):
    return ind.rolling(fx.daily_bars(spark, sf)).select(
        "ticker", "tf", "ts", F.round("earlier_volume", 4).alias("earlier_volume"))


@query("w08_newest_bars", f"select * from {newest_sql(ALL_BARS_SQL)}")
def _(spark, sf):
    return ind.newest_bars(all_bars(spark, sf))


_SPANS = (9, 12, 21, 26, 50, 200)


@query("w09_ema", "select ticker, tf, " + ", ".join(f"round({ema_sql('c', s)}, 4) as ema_{s}" for s in _SPANS)
       + f" from {gathered_sql(ALL_BARS_SQL)}")
def _(spark, sf):
    return ind.gathered(all_bars(spark, sf)).select(
        "ticker", "tf", *[F.round(ind.ema(F.col("closes"), s), 4).alias(f"ema_{s}") for s in _SPANS])


@query("w10_wilder_rsi", f"select ticker, tf, rsi from ({indicator_sql(ALL_BARS_SQL)})")
def _(spark, sf):
    return ind.gathered(all_bars(spark, sf)).select(
        "ticker", "tf", F.round(ind.rsi(F.col("closes")), 2).alias("rsi"))


@query("f37_indicator_labels", f"select ticker, tf, rsi_label, macd_label, bb_label, trend from ({indicator_sql(ALL_BARS_SQL)})")
def _(spark, sf):
    return ind.indicators(all_bars(spark, sf)).select("ticker", "tf", "rsi_label", "macd_label", "bb_label", "trend")


# Whole series, not cut to their newest bars; every order is a bar of one long series beside the others.
LONG_BARS_SQL = f"""(select * from {ALL_BARS_SQL} union all
  select 'LONG' as ticker, '5m' as tf, timestamp '2020-01-01' + interval 5 minute * o_orderkey as ts,
    o_totalprice::double as open, o_totalprice::double as high, o_totalprice::double as low, o_totalprice::double as close,
    o_custkey::bigint as volume from orders)"""


def long_bars(spark, sf):
    extra = table(spark, sf, "orders").selectExpr(
        "'LONG' as ticker", "'5m' as tf", "cast(timestamp_seconds(1577836800 + 300 * o_orderkey) as timestamp_ntz) as ts",
        *[f"cast(o_totalprice as double) as {c}" for c in ("open", "high", "low", "close")], "cast(o_custkey as bigint) as volume")
    return all_bars(spark, sf).unionByName(extra)


_WHOLE = f"""(select ticker, tf, count(*) as n, list(close order by ts) as c, list(volume order by ts) as v
  from {LONG_BARS_SQL} where close is not null group by 1, 2)"""


@query("w09_ema_whole_series", "select ticker, tf, n, " + ", ".join(f"round({ema_sql('c', s)}, 4) as ema_{s}" for s in (9, 21, 50, 200))
       + f" from {_WHOLE}")
def _(spark, sf):
    states = recursive.last_states(recursive.slice_maps(long_bars(spark, sf)))
    return states.select("ticker", "tf", "y.n", *[F.round(f"y.e{s}", 4).alias(f"ema_{s}") for s in (9, 21, 50, 200)])


@query("v01_whole_series", indicator_sql(LONG_BARS_SQL, 10**9))
def _(spark, sf):
    return recursive.whole_series_indicators(long_bars(spark, sf))
