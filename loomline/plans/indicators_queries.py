"""Window functions, technical indicators, price adjustment."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions.indicators import PATTERNS, REGISTRY, indicator, indicators, names, output_columns
from loomline.operators import fundamentals as fund
from loomline.operators import indicator_tables as it
from loomline.operators import panel as P
from loomline.operators.ranking import ordinal, tied_rank, tiles
from loomline.plans.panel_queries import sma, win
from loomline.plans.registry import query, r, rd
from loomline.plans.sqlviews import month

ALL = "PARTITION BY sym ORDER BY date"
RUN = f"{ALL} ROWS UNBOUNDED PRECEDING"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {agg}({x}) OVER w{n} END"


def ema_sql(x: str, a: float, i: str = "i") -> str:
    """Closed form of the recursion; safe for the few hundred rows per symbol
    of the check data, where the powers stay far from overflow."""
    q = 1 - a
    return (f"power({q!r}, {i}) * sum(CASE WHEN {i} = 1 THEN ({x}) / {q!r} "
            f"ELSE {a!r} * ({x}) * power({q!r}, -{i}) END) OVER ({RUN})")


TR = "greatest(high - low, abs(high - lag(close) OVER p), abs(low - lag(close) OVER p))"
NUM = f"x AS (SELECT *, row_number() OVER ({ALL}) AS i, lag(close) OVER ({ALL}) AS pc FROM bars_w)"


def bars(t, *cols):
    return t.bars("W").select("date", "sym", *cols)


def stored(t, *cols):
    """For plans that read the bars more than once."""
    return t.stored("W").select("date", "sym", *cols)


def out(df, *cols, digits=6):
    return df.select("date", "sym", *[rd(c, digits).alias(c) for c in cols])


@query("w01_sma", f"SELECT date, sym, {r(sma(10))} AS sma_10, {r(sma(20))} AS sma_20 FROM bars_w {win(10, 20)}")
def w01(t):
    b = indicators(bars(t, "close"), [("SMA", "sma_10", {"timeperiod": 10}), ("SMA", "sma_20", {"period": 20})])
    return out(b, "sma_10", "sma_20")


@query("w02_ema", f"WITH {NUM} SELECT date, sym, CASE WHEN i >= 12 THEN {r(ema_sql('close', 2 / 13))} END AS ema_12 FROM x")
def w02(t):
    return out(indicator(bars(t, "close"), "EMA", timeperiod=12, prefix="ema_12"), "ema_12")


def _rsi_sql(n):
    a = 1 / n
    up = ema_sql("greatest(close - pc, 0)", a, "(i - 1)")
    dn = ema_sql("greatest(pc - close, 0)", a, "(i - 1)")
    return f"""
WITH {NUM},
d AS (SELECT date, sym, i, {up} AS g, {dn} AS l FROM x WHERE i > 1),
v AS (SELECT date, sym, CASE WHEN i > {n} THEN CASE WHEN l = 0 THEN CASE WHEN g = 0 THEN 50.0 ELSE 100.0 END
  ELSE 100 - 100 / (1 + g / l) END END AS v FROM d)"""


@query("w03_rsi", _rsi_sql(14) + f"""
SELECT date, sym, {r('v')} AS rsi FROM bars_w LEFT JOIN v USING (date, sym)""")
def w03(t):
    return out(indicator(bars(t, "close"), "RSI", timeperiod=14, prefix="rsi"), "rsi")


@query("w03_rsi_simple", f"""
WITH {NUM}, d AS (SELECT date, sym, greatest(close - pc, 0) + 0 * pc AS g, greatest(pc - close, 0) + 0 * pc AS l FROM x),
m AS (SELECT date, sym, {full('avg', 'g', 14)} AS g, {full('avg', 'l', 14)} AS l
  FROM (SELECT date, sym, CASE WHEN g IS NOT NULL THEN g END AS g, l FROM d) {win(14)})
SELECT date, sym, CASE WHEN l = 0 THEN CASE WHEN g = 0 THEN 50.0 ELSE 100.0 END ELSE {r('100 - 100 / (1 + g / l)', 6)} END AS rsi FROM m""")
def w03b(t):
    return out(indicator(bars(t, "close"), "RSI_SIMPLE", period=14, prefix="rsi"), "rsi", digits=6)


@query("w04_macd", f"""
WITH {NUM}, l AS (SELECT date, sym, i, {ema_sql('close', 2 / 13)} - {ema_sql('close', 2 / 27)} AS line FROM x),
s AS (SELECT *, {ema_sql('line', 0.2)} AS sig FROM l)
SELECT date, sym, CASE WHEN i >= 26 THEN {r('line', 4)} END AS line, CASE WHEN i >= 34 THEN {r('sig', 4)} END AS signal,
  CASE WHEN i >= 34 THEN {r('line - sig', 4)} END AS hist FROM s""")
def w04(t):
    """Four digits: the nested closed form of the SQL is exact to about 1e-9."""
    b = indicator(bars(t, "close"), "MACD", prefix="m")
    return b.select("date", "sym", *[rd(f"m_{o}", 4).alias(o) for o in ("line", "signal", "hist")])


@query("w05_bbands", f"""
WITH m AS (SELECT date, sym, {sma(20)} AS middle, {full('stddev_pop', 'close', 20)} AS dev FROM bars_w {win(20)})
SELECT date, sym, {r('middle + 2 * dev', 6)} AS upper, {r('middle', 6)} AS middle, {r('middle - 2 * dev', 6)} AS lower FROM m""")
def w05(t):
    b = indicator(bars(t, "close"), "BBANDS", prefix="b", timeperiod=20)
    return b.select("date", "sym", *[rd(f"b_{o}", 6).alias(o) for o in ("upper", "middle", "lower")])


@query("w06_stoch", f"""
WITH f AS (SELECT date, sym, 100 * (close - ({full('min', 'low', 9)})) / nullif(({full('max', 'high', 9)}) - ({full('min', 'low', 9)}), 0) AS f
  FROM bars_w {win(9)}),
k AS (SELECT date, sym, {full('avg', 'f', 3)} AS k FROM f {win(3)})
SELECT date, sym, {r('k')} AS k, {r(full('avg', 'k', 3))} AS d FROM k {win(3)}""")
def w06(t):
    b = indicator(bars(t, "high", "low", "close"), "STOCH", prefix="s")
    return b.select("date", "sym", rd("s_k").alias("k"), rd("s_d").alias("d"))


@query("w07_supertrend", f"""
WITH RECURSIVE t AS (SELECT *, {TR} AS tr FROM bars_w WINDOW p AS ({ALL})), n AS (SELECT *, row_number() OVER ({ALL}) AS i FROM t),
b AS (SELECT sym, date, i, close, (high + low) / 2 AS mid, 3 * {ema_sql('tr', 1 / 10)} AS w FROM n),
f AS (
  SELECT sym, i, close, mid - w AS dn, mid + w AS up, 1.0::DOUBLE AS s FROM b WHERE i = 10
  UNION ALL
  SELECT sym, i, close, dn, up, CASE WHEN s > 0 AND close < dn THEN -1.0::DOUBLE WHEN s < 0 AND close > up THEN 1.0::DOUBLE ELSE s END FROM (
    SELECT b.sym, b.i, b.close, f.s, CASE WHEN f.close >= f.dn THEN greatest(b.mid - b.w, f.dn) ELSE b.mid - b.w END AS dn,
      CASE WHEN f.close <= f.up THEN least(b.mid + b.w, f.up) ELSE b.mid + b.w END AS up
    FROM f JOIN b ON b.sym = f.sym AND b.i = f.i + 1))
SELECT b.date, b.sym, {r('CASE WHEN s > 0 THEN dn ELSE up END')} AS st_line, s + 0.0 AS st_direction FROM b LEFT JOIN f ON f.sym = b.sym AND f.i = b.i""")
def w07(t):
    b = indicator(bars(t, "high", "low", "close"), "SUPERTREND", prefix="st")
    return out(b, "st_line", "st_direction")


ATR = f"""a AS (SELECT date, sym, close, tr, {full('avg', 'tr', 14)} AS atr
  FROM (SELECT *, {TR} AS tr FROM bars_w WINDOW p AS ({ALL})) {win(14)})"""


@query("w08_atr", f"""
WITH {ATR}, n AS (SELECT *, row_number() OVER ({ALL}) AS i FROM a)
SELECT date, sym, {r('atr')} AS atr, CASE WHEN i >= 14 THEN {r(ema_sql('tr', 1 / 14))} END AS atr_wilder FROM n""")
def w08(t):
    b = indicators(bars(t, "high", "low", "close"), [("ATR", "atr", {}), ("ATR_WILDER", "atr_wilder", {})])
    return out(b, "atr", "atr_wilder")


def _q(n):
    return f"({full('sum', 'bp', n)}) / nullif(({full('sum', 'tr', n)}), 0)"


@query("w09_ultimate_oscillator", f"""
WITH x AS (SELECT date, sym, {TR} AS tr, close - least(low, lag(close) OVER p) AS bp FROM bars_w WINDOW p AS ({ALL}))
SELECT date, sym, {r(f'100 * (4 * {_q(7)} + 2 * {_q(14)} + {_q(28)}) / 7')} AS uo FROM x {win(7, 14, 28)}""")
def w09(t):
    return out(indicator(bars(t, "high", "low", "close"), "ULTOSC", prefix="uo"), "uo")


@query("w10_volatility", f"SELECT date, sym, {r(full('stddev_samp', 'close', 20), 6)} AS vol FROM bars_w {win(20)}")
def w10(t):
    return out(indicator(bars(t, "close"), "STDDEV", prefix="vol"), "vol", digits=6)


@query("w11_new_high", f"""
SELECT date, sym, {r(full('max', 'high', 52))} AS high_52, coalesce(high = {full('max', 'high', 52)}, false) AS new_high
FROM bars_w {win(52)}""")
def w11(t):
    b = indicator(bars(t, "high"), "MAX", prefix="high_52", timeperiod=52, source="high")
    return b.select("date", "sym", rd("high_52").alias("high_52"), P.holds(F.col("high") == F.col("high_52")).alias("new_high"))


@query("w12_returns", "SELECT date, sym, " + ", ".join(
    r(f"close / lag(close, {k}) OVER p - 1") + f" AS r{k}" for k in (2, 5, 10, 21)) + f" FROM bars_w WINDOW p AS ({ALL})")
def w12(t):
    b = indicators(bars(t, "close"), [("RETURN", f"r{k}", {"timeperiod": k}) for k in (2, 5, 10, 21)])
    return out(b, "r2", "r5", "r10", "r21")


@query("w13_sma_ratio", f"SELECT date, sym, {r(f'close / ({sma(20)})')} AS ratio FROM bars_w {win(20)}")
def w13(t):
    b = indicator(bars(t, "close"), "BIAS", prefix="bias", timeperiod=20)
    return out(b.withColumn("ratio", F.col("bias") + 1), "ratio")


@query("w14_momentum_12_2", f"""
SELECT date, sym, {r('lag(close, 1) OVER p / lag(close, 12) OVER p - 1')} AS mom FROM bars_m WINDOW p AS ({ALL})""")
def w14(t):
    return out(it.momentum_skip(t.bars("M").select("date", "sym", "close")), "mom")


_HIGH52 = full("max", "high", 52)


@query("w15_high_distance", f"SELECT date, sym, {r(f'close / ({_HIGH52}) - 1')} AS dist FROM bars_w {win(52)}")
def w15(t):
    b = indicator(bars(t, "high", "close"), "MAX", prefix="m", timeperiod=52, source="high")
    return out(b.withColumn("dist", F.try_divide("close", "m") - 1), "dist")


@query("w16_volatility_percentile", f"""
WITH v AS (SELECT date, sym, round({full('stddev_samp', 'close', 20)}, 6) AS vol FROM bars_w {win(20)})
SELECT date, sym, {r('percent_rank() OVER (PARTITION BY date ORDER BY vol)')} AS pct FROM v WHERE vol IS NOT NULL""")
def w16(t):
    b = indicator(bars(t, "close"), "STDDEV", prefix="vol").withColumn("vol", F.round("vol", 6))
    b = tied_rank(b.where(F.col("vol").isNotNull()), ["date"], "vol", "pct", "percent")
    return out(b, "pct")


@query("w17_risk_adjusted_return", f"""
WITH {ATR} SELECT date, sym, {r('(close / lag(close, 4) OVER p - 1) / nullif(atr, 0)')} AS v FROM a WINDOW p AS ({ALL})""")
def w17(t):
    b = indicators(bars(t, "high", "low", "close"), [("RETURN", "ret", {"timeperiod": 4}), ("ATR", "atr", {})])
    return out(b.withColumn("v", F.try_divide("ret", "atr")), "v")


@query("w18_ma_cross", f"""
WITH s AS (SELECT date, sym, sign(({sma(13)}) - ({sma(26)})) AS s FROM bars_w {win(13, 26)}),
c AS (SELECT *, lag(s) OVER ({ALL}) AS ps FROM s)
SELECT date, sym, CAST(CASE WHEN s > 0 AND ps <= 0 THEN 1 WHEN s < 0 AND ps >= 0 THEN -1 ELSE 0 END AS INTEGER) AS cross_dir FROM c""")
def w18(t):
    return it.ma_cross(bars(t, "close"), 13, 26).select("date", "sym", "cross_dir")


@query("w19_zscore", f"""
WITH s AS (SELECT date, avg(volume) AS m, stddev_samp(volume) AS d FROM bars_w GROUP BY date)
SELECT b.date, b.sym, {r(f'(close - ({sma(20)})) / nullif(({full("stddev_samp", "close", 20)}), 0)', 6)} AS z_time,
  {r('(volume - m) / nullif(d, 0)', 6)} AS z_cross FROM bars_w b JOIN s ON b.date = s.date
WINDOW w20 AS (PARTITION BY b.sym ORDER BY b.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def w19(t):
    b = indicator(stored(t, "close", "volume"), "ZSCORE", prefix="z_time")
    return out(it.cross_zscore(b, "volume", "z_cross"), "z_time", "z_cross", digits=6)


@query("w20_running_nav", f"""
SELECT date, sym, {r(f'close / first_value(close) OVER (PARTITION BY sym ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS nav,
  CAST(sum(volume) OVER ({RUN}) AS DOUBLE) AS cum_volume FROM bars_w""")
def w20(t):
    b = indicator(bars(t, "close", "volume"), "RETURN", prefix="ret")
    b = it.prefix_product(b, "ret", "nav").withColumn("cum_volume", F.sum("volume").over(P.to_here()))
    return b.select("date", "sym", rd("nav").alias("nav"), "cum_volume")


@query("w21_cross_section_rank", f"""
SELECT date, sym, row_number() OVER (PARTITION BY date ORDER BY volume DESC, sym) AS rank,
  {r("rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0::DOUBLE")} AS avg_rank
FROM bars_w""")
def w21(t):
    b = ordinal(bars(t, "volume"), ["date"], [-F.col("volume"), F.col("sym")], "rank")
    return tied_rank(b, ["date"], "volume", "avg_rank", "average").select("date", "sym", "rank", "avg_rank")


@query("w21_rank_without_bound", f"""
SELECT d, id, row_number() OVER (PARTITION BY d ORDER BY v DESC, id) AS rank,
  {r("rank() OVER (PARTITION BY d ORDER BY v) + (count(*) OVER (PARTITION BY d, v) - 1) / 2.0::DOUBLE")} AS avg_rank
FROM (SELECT l_orderkey * 100 + line AS id, CASE WHEN l_linestatus = 'F' THEN 'all' ELSE l_returnflag END AS d, l_quantity AS v FROM lines)""")
def w21_hot(t):
    """One group holds half of all rows: ranges instead of one window."""
    d = t.tasks().select("id", "state", "labels", F.col("effort").alias("v"))
    flag = F.split_part(F.get("labels", F.lit(1)), F.lit(":"), F.lit(2))
    d = d.select("id", F.when(F.col("state") == "closed", "all").otherwise(flag).alias("d"), "v")
    return tied_rank(ordinal(d, ["d"], [-F.col("v"), F.col("id")], "rank"), ["d"], "v", "avg_rank").select("d", "id", "rank", "avg_rank")


@query("w22_bins", "SELECT date, sym, ntile(8) OVER (PARTITION BY date ORDER BY close, sym) AS bin FROM bars_w")
def w22(t):
    return tiles(bars(t, "close"), ["date"], [F.col("close"), F.col("sym")], 8, "bin").select("date", "sym", "bin")


@query("w23_river", f"""
WITH v AS (SELECT b.date, b.sym, b.close, equity / shares AS base, close / nullif(equity / shares, 0) AS pb
  FROM bars_w b ASOF JOIN funda f ON b.sym = f.sym AND b.date >= f.available),
m AS (SELECT sym, min(pb) AS lo, max(pb) AS hi FROM v GROUP BY sym)
SELECT date, sym, CAST(k AS INTEGER) AS band, {r('lo + (hi - lo) * k / 10', 6)} AS multiple,
  {r('(lo + (hi - lo) * k / 10) * base', 4)} AS price
FROM v JOIN m USING (sym), range(0, 11) g(k)""")
def w23(t):
    j = P.as_of(stored(t, "close"), t.fundamentals(), ["equity", "shares"], "available").where(F.col("equity").isNotNull())
    j = j.withColumn("base", F.try_divide("equity", "shares"))
    return it.river(j, "close", "base", 10).select(
        "date", "sym", "band", rd("multiple", 6).alias("multiple"), rd("price", 4).alias("price"))


@query("w23_river_of_symbol", f"""
WITH v AS (SELECT b.date, b.sym, b.close, net / nullif(shares, 0) AS base, close / nullif(net / nullif(shares, 0), 0) AS pe
  FROM bars_w b ASOF JOIN funda f ON b.sym = f.sym AND b.date >= f.available
  WHERE b.sym = 3 AND b.date BETWEEN DATE '1994-01-01' AND DATE '1996-07-01'),
m AS (SELECT sym, min(pe) AS lo, max(pe) AS hi FROM v GROUP BY sym)
SELECT date, sym, CAST(k AS INTEGER) AS band, {r('lo + (hi - lo) * k / 8', 4)} AS multiple, {r('(lo + (hi - lo) * k / 8) * base', 4)} AS price
FROM v JOIN m USING (sym), range(0, 9) g(k)""")
def w23_symbol(t):
    v = it.river_of(t.bars("W"), t.fundamentals(), symbol=3, start="1994-01-01", end="1996-07-01", mode="pe", split_range=8)
    return v.select("date", "sym", "band", rd("multiple", 4).alias("multiple"), rd("price", 4).alias("price"))


@query("w24_radar_portfolio", f"""
WITH q AS (SELECT sym, quarter, (revenue - cost) / nullif(revenue, 0) AS gross_margin, net / nullif(revenue, 0) AS net_margin,
  net / equity AS roe FROM funda),
u AS (UNPIVOT q ON gross_margin, net_margin, roe INTO NAME ratio VALUE v),
s AS (SELECT sym, quarter, ratio, ntile(8) OVER (PARTITION BY quarter, ratio ORDER BY round(v, 9), sym) AS score FROM u)
SELECT s.* FROM s JOIN universe USING (sym) WHERE market = 'ASIA'""")
def w24_portfolio(t):
    """Symbols of one market, scored among all."""
    f = fund.ratios(t.fundamentals())
    return it.radar(f, ["gross_margin", "net_margin", "roe"], 8, t.universe().where("market = 'ASIA'").select("sym"))


@query("w24_radar_scores", f"""
WITH q AS (SELECT sym, quarter, (revenue - cost) / nullif(revenue, 0) AS gross_margin, net / nullif(revenue, 0) AS net_margin,
  net / equity AS roe FROM funda),
u AS (UNPIVOT q ON gross_margin, net_margin, roe INTO NAME ratio VALUE v)
SELECT sym, quarter, ratio, ntile(8) OVER (PARTITION BY quarter, ratio ORDER BY round(v, 9), sym) AS score FROM u""")
def w24(t):
    f = fund.ratios(t.fundamentals())
    return it.radar(f, ["gross_margin", "net_margin", "roe"], 8)


@query("w25_candle_overlay", f"""
SELECT date, sym, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close,
  {r(sma(10))} AS sma_10, {r(f'({sma(20)}) + 2 * ({full("stddev_pop", "close", 20)})', 6)} AS bb_upper FROM bars_w {win(10, 20)}""")
def w25(t):
    c = it.candles(t.bars("W"), overlays=[("SMA", "sma_10", {"timeperiod": 10}), ("BBANDS", "bb", {"timeperiod": 20})], technicals=[])
    return c.select("date", "sym", *[rd(x).alias(x) for x in ("open", "high", "low", "close", "sma_10")], rd("bb_upper", 6).alias("bb_upper"))


@query("w25_candles_of_symbol", f"""
WITH a AS (SELECT b.date, b.sym, open, high, low, close, volume,
    exp(coalesce(sum(ln(coalesce(factor, 1))) OVER (PARTITION BY b.sym ORDER BY b.date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS f
  FROM bars_w b LEFT JOIN adj a ON a.sym = b.sym AND a.date = b.date WHERE b.sym = 5),
m AS (SELECT {month('date')} AS date, sym, arg_min(open * f, date) AS open, max(high * f) AS high, min(low * f) AS low,
  arg_max(close * f, date) AS close, sum(volume) AS volume FROM a GROUP BY 1, 2),
s AS (SELECT *, {sma(3)} AS sma_3, {full('max', 'high', 3)} - {full('min', 'low', 3)} AS spread FROM m {win(3)})
SELECT date, sym, {", ".join(f"{r(c)} AS {c}" for c in ("open", "high", "low", "close", "sma_3", "spread"))}, volume
FROM s WHERE date > (SELECT max(date) FROM m) - 1000""")
def w25_symbol(t):
    """Three years of adjusted monthly candles of one symbol, with an overlay and the width of the channel."""
    c = it.candles(t.bars("W"), overlays=[("SMA", "sma_3", {"timeperiod": 3})], technicals=[("DONCHIAN", "dc", {"timeperiod": 3})],
                   symbol=5, recent_days=1000, factors=t.adjust_factors(), resample="M")
    c = c.withColumn("spread", F.col("dc_upper") - F.col("dc_lower"))
    return c.select("date", "sym", *[rd(x).alias(x) for x in ("open", "high", "low", "close", "sma_3", "spread")], "volume")


@query("w26_volatility_forecast", f"""
WITH {NUM}, y AS (SELECT *, power(close / pc - 1, 2) AS rr FROM x WHERE i > 1),
e AS (SELECT date, sym, {ema_sql('rr', 0.06, '(i - 1)')} AS v FROM y)
SELECT date, sym, {r('v')} AS ewm_var FROM bars_w LEFT JOIN e USING (date, sym)""")
def w26(t):
    return out(indicator(bars(t, "close"), "EWMVAR", prefix="ewm_var"), "ewm_var")


@query("w28_adjusted_prices", f"""
SELECT b.date, b.sym, {r("close * exp(coalesce(sum(ln(coalesce(factor, 1))) OVER (PARTITION BY b.sym ORDER BY b.date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0))", 6)} AS adj_close
FROM bars_w b LEFT JOIN adj a ON a.sym = b.sym AND a.date = b.date""")
def w28(t):
    return out(it.adjust(stored(t, "close"), t.adjust_factors(), ["close"]), "adj_close", digits=6)


@query("x02_indicator_registry", f"""
WITH {NUM}, a AS (SELECT date, sym, i, {sma(20)} AS sma_20, {ema_sql('close', 2 / 13)} AS e FROM x {win(20)}),
{_rsi_sql(14).split('WITH ' + NUM + ',')[1].replace('d AS', 'd14 AS').replace('FROM d)', 'FROM d14)').replace('v AS (', 'v14 AS (')},
{_rsi_sql(21).split('WITH ' + NUM + ',')[1].replace('d AS', 'd21 AS').replace('FROM d)', 'FROM d21)').replace('v AS (', 'v21 AS (')}
SELECT a.date, a.sym, {r('v14.v')} AS rsi_14, {r('v21.v')} AS rsi_21, {r('sma_20')} AS sma_20,
  CASE WHEN i >= 12 THEN {r('e')} END AS ema_12
FROM a LEFT JOIN v14 USING (date, sym) LEFT JOIN v21 USING (date, sym)""")
def x02(t):
    b = indicators(bars(t, "close"), [
        ("RSI", "rsi_14", {"timeperiod": 14}), ("RSI", "rsi_21", {"period": 21}),
        ("SMA", "sma_20", {"timeperiod": 20}), ("EMA", "ema_12", {"timeperiod": 12})])
    return out(b, "rsi_14", "rsi_21", "sma_20", "ema_12")


def _wma_sql(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN (sum(i * {x}) OVER w{n} - (i - {n}) * sum({x}) OVER w{n}) / {n * (n + 1) / 2} END"


def _middle(n: int) -> str:
    return f"({full('max', 'high', n)} + {full('min', 'low', n)}) / 2"


@query("x02_window_indicators", f"""
WITH {NUM}, a AS (SELECT *, {full('avg', 'close', 15)} AS inner15, 2 * {_wma_sql('close', 8)} - {_wma_sql('close', 16)} AS lead, {_middle(9)} AS conversion, {_middle(26)} AS base,
  {_middle(52)} AS long, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  abs(high - lag(low) OVER ({ALL})) AS up, abs(low - lag(high) OVER ({ALL})) AS down FROM x {win(8, 9, 15, 16, 26, 52)})
SELECT date, sym, {r(full('avg', 'inner15', 16))} AS trima, {r(_wma_sql('lead', 4))} AS hma, {r('conversion')} AS conversion, {r('base')} AS base,
  {r(f'lag((conversion + base) / 2, 26) OVER ({ALL})')} AS span_a, {r(f'lag(long, 26) OVER ({ALL})')} AS span_b,
  {r(f"({full('sum', 'up', 14)}) / nullif({full('sum', 'tr', 14)}, 0)")} AS vortex_plus, {r(f"({full('sum', 'down', 14)}) / nullif({full('sum', 'tr', 14)}, 0)")} AS vortex_minus
FROM a {win(4, 14, 16)}""")
def x02c(t):
    b = indicators(bars(t, "close", "high", "low"), [("TRIMA", "trima", {}), ("HMA", "hma", {}), ("ICHIMOKU", "ich", {}), ("VORTEX", "vortex", {})])
    b = b.withColumnsRenamed({f"ich_{c}": c for c in ("conversion", "base", "span_a", "span_b")})
    return out(b, "trima", "hma", "conversion", "base", "span_a", "span_b", "vortex_plus", "vortex_minus")


_SHAPES = ", ".join(f"lag({v}, {i}) OVER ({ALL}) AS {k}{i}" for i in (1, 2) for k, v in {"o": "open", "h": "high", "l": "low", "c": "close"}.items())


@query("x02_candle_patterns", f"""
WITH x AS (SELECT date, sym, open AS o, high AS h, low AS l, close AS c, {_SHAPES} FROM bars_w)
SELECT date, sym, {", ".join(f"CAST(CASE WHEN o{back or ''} IS NOT NULL THEN {condition} END AS DOUBLE) + 0.0 AS {name.lower()}" for name, (back, condition) in PATTERNS.items())} FROM x""")
def x02d(t):
    b = indicators(bars(t, "open", "high", "low", "close"), [(n, None, {}) for n in PATTERNS])
    return b.select("date", "sym", *[(F.col(n.lower()) + 0.0).alias(n.lower()) for n in PATTERNS])


#: Indicators by windows that share a pass over the bars.
AT_ONCE = 8


@query("x02_all_indicators")
def x02b(t):
    """Every registered indicator on every symbol; values per indicator."""
    b = stored(t, "open", "high", "low", "close", "volume")
    # Bars are narrow; a row with all outputs would be carried through every window of the others.
    rolling, folded = ([n for n in names() if REGISTRY[n].recursive is kind] for kind in (False, True))
    found = None
    for part in [folded, *[rolling[i:i + AT_ONCE] for i in range(0, len(rolling), AT_ONCE)]]:
        cols = [c for n in part for c in output_columns(n, {})]
        counts = indicators(b, [(n, None, {}) for n in part]).groupBy().agg(*[F.count(c).alias(c) for c in cols]).unpivot([], cols, "indicator", "n_values")
        found = counts if found is None else found.unionByName(counts)
    return found
