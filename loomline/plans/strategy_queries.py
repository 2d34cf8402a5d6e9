"""Strategies, simulation, trades, costs, orders and holdings."""

from pyspark.sql import functions as F

from loomline.functions.indicators import indicator, indicators, rolled
from loomline.operators import backtest as B
from loomline.operators import panel as P
from loomline.operators.fundamentals import valuation
from loomline.operators.ranking import tiles
from loomline.plans.indicators_queries import ALL, _rsi_sql, ema_sql, full
from loomline.plans.panel_queries import sma, win
from loomline.plans.registry import query, r, rd
from loomline.plans.sqlviews import month, week


def wide(t):
    return t.stored("W").select("date", "sym", "open", "high", "low", "close", "volume", "turnover")


# ---- SQL of the simulation ----------------------------------------------


def sim_sql(sig: str, period: str, px: str = "open", limit: int | None = 10, fee: float = B.FEE_RATIO, tax: float = B.TAX_RATIO) -> str:
    """CTEs up to ``nav``; ``sig`` gives (strategy, date, sym, v)."""
    cut = f"WHERE rk <= {limit}" if limit else ""
    return f"""
sig AS ({sig}),
cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM bars_w)),
eff AS (SELECT max(date) AS d, arg_max(nxt, date) AS e FROM cal GROUP BY {period} HAVING arg_max(coalesce(nxt, DATE '1900-01-01'), date) > DATE '1900-01-01'),
pick AS (SELECT strategy, e, sym FROM (SELECT strategy, e, sym, row_number() OVER (PARTITION BY strategy, e ORDER BY v DESC, sym) AS rk
  FROM sig JOIN eff ON sig.date = eff.d) {cut}),
sel AS (SELECT strategy, e, sym, 1.0::DOUBLE / count(*) OVER (PARTITION BY strategy, e) AS w FROM pick),
px AS (SELECT date, sym, {px} AS px FROM dense),
hold AS (SELECT p.date, p.sym, p.px, eff.e FROM px p ASOF JOIN eff ON p.date > eff.e),
g AS (SELECT s.strategy, h.date, h.e, h.sym, s.w, h.px, b.px AS base, h.px / b.px AS g FROM hold h JOIN sel s ON s.e = h.e AND s.sym = h.sym
  JOIN px b ON b.sym = h.sym AND b.date = h.e),
gd AS (SELECT strategy, e, date, 1 + sum(w * (g - 1)) AS growth FROM g GROUP BY ALL),
drift AS (SELECT strategy, date AS e, sym, w * g / growth AS w FROM g JOIN gd USING (strategy, e, date) WHERE date IN (SELECT e FROM eff)),
cost AS (SELECT strategy, e AS date, sum(abs(coalesce(n.w, 0) - coalesce(d.w, 0))) AS turnover,
  sum(greatest(coalesce(d.w, 0) - coalesce(n.w, 0), 0)) AS sold FROM sel n FULL JOIN drift d USING (strategy, e, sym) GROUP BY 1, 2),
step AS (SELECT strategy, date, growth / coalesce(lag(growth) OVER (PARTITION BY strategy, e ORDER BY date), 1) - 1 AS ret FROM gd),
ser AS (SELECT strategy, date, coalesce(ret, 0) AS gross, coalesce({fee!r} * turnover + {tax!r} * sold, 0) AS cost
  FROM (SELECT DISTINCT strategy FROM sel) CROSS JOIN (SELECT date FROM cal WHERE date >= (SELECT min(e) FROM eff)) c
  LEFT JOIN step USING (strategy, date) LEFT JOIN cost USING (strategy, date)),
net AS (SELECT *, (1 + gross) * (1 - cost) - 1 AS ret FROM ser),
nav AS (SELECT *, 10000000.0 * exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM net)"""


def stats_sql(nav: str = "nav", periods: int = 52, cap: float = 1e7) -> str:
    return f"""SELECT strategy, count(*) AS n, {r(f'ln(arg_max(nav, date) / {cap!r})')} AS log_total,
  {r(f'ln(power(arg_max(nav, date) / {cap!r}, {periods}::DOUBLE / count(*)))')} AS log_annual,
  {r('least(min(nav / peak - 1), 0)')} AS max_drawdown,
  {r(f'avg(ret) / nullif(stddev_samp(ret), 0) * sqrt({periods})')} AS sharpe
FROM (SELECT *, greatest(max(nav) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING), {cap!r}) AS peak FROM {nav})
GROUP BY strategy"""


MOM = f"""SELECT 'mom' AS strategy, date, sym, mom AS v FROM (
  SELECT date, sym, close, close / lag(close, 4) OVER (PARTITION BY sym ORDER BY date) - 1 AS mom, {sma(10)} AS ma
  FROM bars_w {win(10)}) WHERE close > ma AND mom IS NOT NULL"""


def mom_signals(t):
    b = indicators(t.stored("W").select("date", "sym", "close"),
                   [("RETURN", "mom", {"timeperiod": 4}), ("SMA", "ma", {"timeperiod": 10})])
    return b.select("date", "sym", P.holds((F.col("close") > F.col("ma")) & F.col("mom").isNotNull()).alias("signal"), "mom")


def mom_sim(t, **kw):
    kw = {"resample": "M", "position_limit": 10, "name": "mom", "rank": "mom", **kw}
    return B.sim(mom_signals(t), wide(t), **kw)


def report(df, *more):
    """Growth in logs: prices in the check data are noise, so NAV spans many
    orders of magnitude."""
    return df.select("strategy", "n", rd(F.log1p("total_return")).alias("log_total"), rd(F.log1p("annual_return")).alias("log_annual"),
                     rd("max_drawdown").alias("max_drawdown"), rd("sharpe").alias("sharpe"), *[rd(c).alias(c) for c in more])


@query("b01_sim_nav", f"""
WITH {sim_sql(MOM, month('date'))}
SELECT strategy, date, {r('ret', 8)} AS ret, {r('cost', 8)} AS cost, {r('ln(nav)')} AS log_nav FROM nav""")
def b01(t):
    return mom_sim(t).nav.select("strategy", "date", rd("ret", 8).alias("ret"), rd("cost", 8).alias("cost"), rd(F.ln("nav")).alias("log_nav"))


for _m, _sql in (("close", "close"), ("avg", "avgpx")):
    _extra = ""

    @query(f"b02_trade_at_{_m}", (f"""
WITH {sim_sql(MOM, month('date'), 'close')} SELECT strategy, date, {r('ret', 8)} AS ret FROM nav""" if _m == "close" else f"""
WITH {sim_sql(MOM, month('date'), 'px').replace('FROM dense)', '''FROM (SELECT g.date, g.sym, last_value(b.avgpx IGNORE NULLS) OVER (PARTITION BY g.sym ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS px
  FROM dense g LEFT JOIN (SELECT date, sym, (open + high + low + close) / 4 AS avgpx FROM bars_w) b ON b.sym = g.sym AND b.date = g.date))''')}
SELECT strategy, date, {r('ret', 8)} AS ret FROM nav"""))
    def b02(t, mode=_m):
        return mom_sim(t, trade_at_price=mode).nav.select("strategy", "date", rd("ret", 8).alias("ret"))


@query("b03_costs", f"""
WITH {sim_sql(MOM, month('date'))}
SELECT strategy, date, {r('turnover', 8)} AS turnover, {r('sold', 8)} AS sold, {r(f'{B.FEE_RATIO!r} * turnover + {B.TAX_RATIO!r} * sold', 8)} AS cost FROM cost""")
def b03(t):
    return mom_sim(t).costs.select("strategy", "date", *[rd(c, 8).alias(c) for c in ("turnover", "sold", "cost")])


_POS = f"""
pos AS (SELECT date, sym, CASE WHEN close > ma THEN 1.0 ELSE 0.0 END AS position, close / lag(close) OVER ({ALL}) - 1 AS ret
  FROM (SELECT date, sym, close, {sma(10)} AS ma FROM bars_w {win(10)})),
tc AS (SELECT *, abs(position - coalesce(lag(position) OVER ({ALL}), 0)) AS turnover FROM pos),
cc AS (SELECT *, CASE WHEN turnover > 0 THEN turnover * 10 / 1e4 ELSE 1 / 1e4 END AS cost FROM tc)"""


def _positions(t):
    b = indicators(t.bars("W").select("date", "sym", "close"), [("SMA", "ma", {"timeperiod": 10}), ("RETURN", "ret", {})])
    b = b.withColumn("position", F.when(F.col("close") > F.col("ma"), 1.0).otherwise(0.0)).select("date", "sym", "position", "ret")
    return B.trading_costs(b, 10, 1)


@query("b04_bps_costs", f"WITH {_POS} SELECT date, sym, CAST(turnover AS DOUBLE) AS turnover, {r('cost', 8)} AS cost FROM cc")
def b04(t):
    return _positions(t).select("date", "sym", "turnover", rd("cost", 8).alias("cost"))


@query("b05_net_rewards", f"""
WITH {_POS} SELECT date, sym, {r(f'coalesce(lag(position) OVER ({ALL}), 0) * coalesce(ret, 0) - cost', 8)} AS reward FROM cc""")
def b05(t):
    return B.net_rewards(_positions(t)).select("date", "sym", rd("reward", 8).alias("reward"))


@query("b06_report", f"WITH {sim_sql(MOM, month('date'))} {stats_sql()}")
def b06(t):
    return report(mom_sim(t).report())


_SPELLS = """
k AS (SELECT e, row_number() OVER (ORDER BY e) AS k, lead(e) OVER (ORDER BY e) AS until FROM eff),
sp AS (SELECT s.*, k.until, k - row_number() OVER (PARTITION BY strategy, sym ORDER BY k) AS spell FROM sel s JOIN k USING (e)),
tp AS (SELECT g.*, sp.until, sp.spell, b.low, b.high FROM g JOIN sp USING (strategy, e, sym) LEFT JOIN bars_w b ON b.sym = g.sym AND b.date = g.date),
te AS (SELECT *, first_value(base) OVER w AS entry_px, greatest(max(px) OVER w, first_value(base) OVER w) AS peak FROM tp
  WINDOW w AS (PARTITION BY strategy, sym, spell ORDER BY date ROWS UNBOUNDED PRECEDING)),
se AS (SELECT strategy, sym, spell, bool_or(until IS NULL) AS open_end, max(until) AS exit_last FROM sp GROUP BY 1, 2, 3),
tr AS (SELECT strategy, sym, spell, min(e) AS entry_date, max(date) AS last, arg_min(w, e) AS weight,
  arg_min(base, date) AS entry_price, arg_max(px, date) AS exit_price, min(px / peak - 1) AS mdd, min(low) AS lo, max(high) AS hi FROM te GROUP BY 1, 2, 3),
trades AS (SELECT strategy, sym, entry_date, CASE WHEN NOT open_end THEN exit_last END AS exit_date,
  date_diff('day', entry_date, CASE WHEN NOT open_end THEN exit_last ELSE last END) AS days,
  weight, entry_price, exit_price, exit_price / entry_price - 1 AS ret, mdd, least(0, lo / entry_price - 1) AS mae, greatest(0, hi / entry_price - 1) AS mfe FROM tr JOIN se USING (strategy, sym, spell))"""


@query("b07_trades", f"""
WITH {sim_sql(MOM, month('date'))}, {_SPELLS}
SELECT strategy, sym, entry_date, exit_date, days, {r('weight')} AS weight, {r('ret')} AS ret, {r('mdd')} AS mdd FROM trades""")
def b07(t):
    d = mom_sim(t).get_trades()
    return d.select("strategy", "sym", "entry_date", "exit_date", F.col("days").cast("bigint").alias("days"),
                    *[rd(c).alias(c) for c in ("weight", "ret", "mdd")])


@query("b08_mae_mfe", f"""
WITH {sim_sql(MOM, month('date'))}, {_SPELLS}
SELECT strategy, sym, entry_date, {r('mae')} AS mae, {r('mfe')} AS mfe FROM trades""")
def b08(t):
    return mom_sim(t).get_trades().select("strategy", "sym", "entry_date", rd("mae").alias("mae"), rd("mfe").alias("mfe"))


_BENCH = f"""
br AS (SELECT date, avg(close / pc - 1) AS ret FROM (SELECT date, close, lag(close) OVER ({ALL}) AS pc FROM bars_w) WHERE pc IS NOT NULL GROUP BY date)"""


def bench_returns(t):
    b = indicator(t.stored("W").select("date", "sym", "close"), "RETURN", prefix="ret")
    return b.where(F.col("ret").isNotNull()).groupBy("date").agg(F.avg("ret").alias("ret"))


@query("b09_benchmark_curve", f"""
WITH {sim_sql(MOM, month('date'))}, {_BENCH}
SELECT strategy, date, {r('sum(ln(1 + n.ret)) OVER w')} AS log_curve, {r('sum(ln(1 + b.ret)) OVER w')} AS log_bench,
  {r('n.ret - b.ret')} AS excess FROM nav n JOIN br b USING (date) WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def b09(t):
    d = B.against_benchmark(mom_sim(t).nav, bench_returns(t))
    return d.select("strategy", "date", rd(F.ln("curve")).alias("log_curve"), rd(F.ln("bench_curve")).alias("log_bench"), rd("excess").alias("excess"))


# ---- strategies ----------------------------------------------------------


_RSI14 = _rsi_sql(14).strip()[len("WITH "):]

_B10 = f"""
s AS (SELECT date, sym, close, {sma(20)} AS ma, {sma(30, 'close * volume')} AS dv FROM bars_w {win(20, 30)}),
ev AS (SELECT s.date, s.sym, CASE WHEN coalesce(close < ma, false) OR coalesce(v < 30, false) THEN 0
  WHEN coalesce(close > ma AND v > 50 AND dv > 50000, false) THEN 1 END AS ev FROM s JOIN v USING (date, sym)),
held AS (SELECT date, sym, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY sym ORDER BY date ROWS UNBOUNDED PRECEDING), 0) = 1 AS held FROM ev)"""


def simple_momentum(t, ma=20):
    b = indicators(wide(t), [("SMA", "ma", {"timeperiod": ma}), ("RSI", "rsi", {"timeperiod": 14})])
    b = b.withColumn("dv", rolled(F.avg, F.col("close") * F.col("volume"), 30))
    c = F.col
    s = b.select("date", "sym",
                 P.holds((c("close") > c("ma")) & (c("rsi") > 50) & (c("dv") > 50000)).alias("entry"),
                 P.holds(c("close") < c("ma")).__or__(P.holds(c("rsi") < 30)).alias("exit"))
    return P.hold_until(s)


@query("b10_simple_momentum", f"""
WITH {_RSI14.replace('v AS (SELECT', 'v0 AS (SELECT')}, v AS (SELECT date, sym, v FROM bars_w LEFT JOIN v0 USING (date, sym)), {_B10},
{sim_sql("SELECT 'simple' AS strategy, date, sym, 0 AS v FROM held WHERE held", 'date', limit=30)}
{stats_sql()}""")
def b10(t):
    s = simple_momentum(t).select("date", "sym", F.col("held").alias("signal"))
    return report(B.sim(s, wide(t), resample="W", position_limit=30, name="simple").report())


@query("b11_weekly_momentum", f"""
WITH {_RSI14}, s AS (SELECT date, sym, close, {sma(20)} AS ma FROM bars_w {win(20)}),
{sim_sql("SELECT 'mom_w' AS strategy, date, sym, v AS v FROM s JOIN v USING (date, sym) WHERE close > ma AND v > 50", 'date', limit=20)}
{stats_sql()}""".replace("SELECT date, sym, CASE WHEN i > 14", "SELECT date, sym, CASE WHEN i > 14").replace("v AS v FROM s JOIN v", "round(v, 6) AS v FROM s JOIN v"))
def b11(t):
    b = indicators(t.stored("W").select("date", "sym", "close"), [("SMA", "ma", {"timeperiod": 20}), ("RSI", "rsi", {})])
    s = b.select("date", "sym", P.holds((F.col("close") > F.col("ma")) & (F.col("rsi") > 50)).alias("signal"), F.round("rsi", 6).alias("rsi"))
    return report(B.sim(s, wide(t), resample="W", position_limit=20, rank="rsi", name="mom_w").report())


_VAL = """
val AS (SELECT b.date, b.sym, round(close / nullif(equity / shares, 0), 6) AS pb, round(net / equity, 9) AS roe
  FROM bars_w b ASOF JOIN funda f ON b.sym = f.sym AND b.date >= f.available),
vk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pb, sym) AS rp FROM val),
vr AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY roe DESC, sym) AS rr FROM vk)"""


def value_screen(t, n=40):
    """Low price-to-book and high return on equity with visible statements."""
    v = P.as_of(t.stored("W").select("date", "sym", "close"), t.fundamentals(), ["net", "equity", "shares"], "available")
    v = v.select("date", "sym", F.round(F.try_divide("close", F.try_divide("equity", "shares")), 6).alias("pb"),
                 F.round(F.try_divide("net", "equity"), 9).alias("roe"))
    cheap = P.top(v, "pb", n, ascending=True).select("date", "sym")
    good = P.top(v, "roe", n).select("date", "sym", "roe")
    return good.join(cheap, ["date", "sym"], "left_semi").withColumn("signal", F.lit(True))


@query("b12_value_monthly", f"""
WITH {_VAL}, {sim_sql("SELECT 'val_m' AS strategy, date, sym, roe AS v FROM vr WHERE rp <= 40 AND rr <= 40", month('date'), limit=15)}
{stats_sql()}""")
def b12(t):
    return report(B.sim(value_screen(t), wide(t), resample="M", position_limit=15, rank="roe", name="val_m").report())


@query("b13_stop_loss", f"""
WITH {sim_sql(MOM, month('date'))}, {_SPELLS},
hit AS (SELECT strategy, sym, spell, min(date) AS stop_date FROM te WHERE round(px / entry_px - 1, 12) <= -0.1 GROUP BY 1, 2, 3)
SELECT te.strategy, te.sym, min(te.e) AS entry_date, h.stop_date, count(*) AS n_bars, {r('arg_max(px, date) / any_value(entry_px) - 1')} AS ret
FROM te LEFT JOIN hit h USING (strategy, sym, spell) WHERE h.stop_date IS NULL OR date <= h.stop_date
GROUP BY te.strategy, te.sym, spell, h.stop_date""")
def b13(t):
    from pyspark.sql import Window

    res = mom_sim(t)
    p = res.path.join(res.spells.select("strategy", "sym", "effective", "spell"), ["strategy", "sym", "effective"])
    w = Window.partitionBy("strategy", "sym", "spell").orderBy("date")
    p = p.withColumn("entry_px", F.first("base").over(w))
    return B.stop_loss(p, 0.10).groupBy("strategy", "sym", "spell").agg(
        F.min("effective").alias("entry_date"), F.first("stop_date").alias("stop_date"), F.count("*").alias("n_bars"),
        rd(F.max_by("px", "date") / F.first("entry_px") - 1).alias("ret")).drop("spell")


@query("b14_hard_stop", f"""
WITH RECURSIVE {sim_sql(MOM, month('date'))},
s AS (SELECT strategy, date, ret, date IN (SELECT e FROM eff) AS reb, row_number() OVER (PARTITION BY strategy ORDER BY date) AS i FROM nav),
f AS (
  SELECT strategy, date, ret, i, 1 + ret AS level, greatest(1.0::DOUBLE, 1 + ret) AS peak, false AS stopped, 1 + ret <= 0.9 + 1e-12 AS cash FROM s WHERE i = 1
  UNION ALL
  SELECT strategy, date, ret, i, level, peak, stopped, stopped OR level / peak - 1 <= -0.1 + 1e-12 FROM (
    SELECT s.strategy, s.date, s.ret, s.i, CASE WHEN f.cash THEN f.level ELSE f.level * (1 + s.ret) END AS level,
      CASE WHEN f.cash AND s.reb THEN f.level WHEN f.cash THEN f.peak ELSE greatest(f.peak, f.level * (1 + s.ret)) END AS peak,
      f.cash AND NOT s.reb AS stopped
    FROM f JOIN s ON s.strategy = f.strategy AND s.i = f.i + 1))
SELECT strategy, date, {r('ret')} AS ret, {r('ln(level)')} AS log_nav, stopped FROM f""")
def b14(t):
    res = mom_sim(t)
    d = B.portfolio_hard_stop(res.nav, res.sched.select(F.col("effective").alias("date")))
    return d.select("strategy", "date", rd("ret").alias("ret"), rd(F.ln("nav")).alias("log_nav"), "stopped")


@query("b15_soft_stop", f"""
WITH {sim_sql(MOM, month('date'))},
x AS (SELECT *, CASE WHEN count(nav) OVER w = 18 THEN nav < avg(nav) OVER w - 2 * stddev_pop(nav) OVER w ELSE false END AS low FROM nav
  WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN 17 PRECEDING AND CURRENT ROW))
SELECT strategy, date, CASE WHEN lag(low) OVER (PARTITION BY strategy ORDER BY date) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS exposure FROM x""")
def b15(t):
    return B.soft_stop(mom_sim(t).nav, 18).select("strategy", "date", "exposure")


@query("b16_position_caps", f"""
WITH w AS (SELECT date, sym, category, volume / sum(volume) OVER (PARTITION BY date) AS weight FROM bars_w JOIN universe USING (sym)),
s AS (SELECT *, sum(least(weight, 0.05)) OVER (PARTITION BY date, category) AS s FROM w)
SELECT date, sym, category, {r('least(weight, 0.05) * CASE WHEN s > 0.1 THEN 0.1 / s ELSE 1 END', 8)} AS capped FROM s""")
def b16(t):
    return B.cap_weights(volume_weights(t), 0.05, 0.1).select("date", "sym", "category", rd("capped", 8).alias("capped"))


def volume_weights(t):
    b = t.stored("W").select("date", "sym", "volume")
    tot = b.groupBy("date").agg(F.sum("volume").alias("tot"))
    return b.join(tot, "date").withColumn("weight", F.col("volume") / F.col("tot")).join(t.universe(), "sym")


@query("b17_half_kelly", f"""
WITH x AS (SELECT date, sym, close / lag(close) OVER ({ALL}) - 1 AS ret FROM bars_w)
SELECT date, sym, {r('CASE WHEN count(ret) OVER w52 = 52 THEN greatest(0, least(0.1, 0.5 * avg(ret) OVER w52 / nullif(var_samp(ret) OVER w52, 0))) END')} AS weight
FROM x {win(52)}""")
def b17(t):
    b = indicator(t.bars("W").select("date", "sym", "close"), "RETURN", prefix="ret")
    return B.half_kelly(b, 52).select("date", "sym", rd("weight").alias("weight"))


_THREE = f"""
th AS (SELECT strategy, date, sym, rk FROM (
  SELECT 'mom' AS strategy, date, sym, row_number() OVER (PARTITION BY date ORDER BY close / pc DESC, sym) AS rk FROM lagd WHERE pc IS NOT NULL
  UNION ALL SELECT 'vol', date, sym, row_number() OVER (PARTITION BY date ORDER BY volume DESC, sym) FROM lagd
  UNION ALL SELECT 'cheap', date, sym, row_number() OVER (PARTITION BY date ORDER BY close, sym) FROM lagd) WHERE rk <= 10),
tw AS (SELECT strategy, date, sym, 1.0::DOUBLE / count(*) OVER (PARTITION BY strategy, date) AS weight FROM th)"""
_LAGD = f"lagd AS (SELECT *, lag(close) OVER ({ALL}) AS pc, lead(close) OVER ({ALL}) / close - 1 AS fwd FROM bars_w)"


def three_strategies(t):
    """Weights of three screens in one table, one rank pass over all."""
    b = t.bars("W").select("date", "sym", "close", "volume")
    pc = F.lag("close").over(P.by_sym())
    b = b.withColumn("fwd", F.lead("close").over(P.by_sym()) / F.col("close") - 1).withColumn("_mom", F.col("close") / pc)
    long = b.select("date", "sym", "fwd", F.explode(F.create_map(
        F.lit("mom"), F.col("_mom"), F.lit("vol"), F.col("volume"), F.lit("cheap"), -F.col("close"))).alias("strategy", "v"))
    return B.equal_weights(P.top(long, "v", 10, ("strategy", "date")), ["strategy", "date"])


@query("b18_static_blend", f"""
WITH {_LAGD}, {_THREE}
SELECT date, sym, {r('sum(weight * CASE strategy WHEN $$mom$$ THEN 0.3 WHEN $$vol$$ THEN 0.3 ELSE 0.4 END)')} AS weight FROM tw GROUP BY 1, 2""")
def b18(t):
    return B.blend(three_strategies(t), {"mom": 0.3, "vol": 0.3, "cheap": 0.4}).withColumn("weight", rd("weight"))


_SRET = """
sr AS (SELECT strategy, date, sum(weight * coalesce(fwd, 0)) AS ret FROM tw JOIN lagd USING (date, sym) GROUP BY 1, 2)"""


def strategy_returns(t):
    return three_strategies(t).groupBy("strategy", "date").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("ret"))


@query("b19_risk_parity_blend", f"""
WITH {_LAGD}, {_THREE}, {_SRET},
v AS (SELECT strategy, date, CASE WHEN count(ret) OVER w = 52 THEN 1 / nullif(stddev_samp(ret) OVER w, 0) END AS iv FROM sr
  WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
SELECT strategy, date, {r('iv / sum(iv) OVER (PARTITION BY date)')} AS weight FROM v WHERE iv IS NOT NULL""")
def b19(t):
    from loomline.operators.risk import inverse_volatility

    s = strategy_returns(t).withColumnRenamed("strategy", "sym")
    return inverse_volatility(s, 52).select(F.col("sym").alias("strategy"), "date", rd("weight").alias("weight"))


_SWEEP = " UNION ALL ".join(
    f"SELECT 'MA{n}' AS strategy, date, sym, 0 AS v FROM (SELECT date, sym, close, {sma(n)} AS ma FROM bars_w {win(n)}) s{n} WHERE close > ma"
    for n in (10, 20, 30, 50))


def sweep_signals(t):
    grid = (10, 20, 30, 50)
    b = t.stored("W").select("date", "sym", "close")
    b = b.select("date", "sym", "close", *[rolled(F.avg, "close", n).alias(f"m{n}") for n in grid])
    return b.select("date", "sym", F.explode(F.array(*[
        F.struct(F.lit(f"MA{n}").alias("strategy"), P.holds(F.col("close") > F.col(f"m{n}")).alias("signal"))
        for n in grid])).alias("s")).select("date", "sym", "s.*")


@query("b22_parameter_sweep", f"WITH {sim_sql(_SWEEP, month('date'), limit=20)} {stats_sql()}")
def b22(t):
    return report(B.sim(sweep_signals(t), wide(t), resample="M", position_limit=20).report())


@query("a12_best_parameter", f"""
WITH {sim_sql(_SWEEP, month('date'), limit=20)}, st AS ({stats_sql()})
SELECT arg_max(strategy, sharpe) AS strategy, max(sharpe) AS sharpe FROM st""")
def a12(t):
    s = report(B.sim(sweep_signals(t), wide(t), resample="M", position_limit=20).report())
    return s.agg(F.max_by("strategy", "sharpe").alias("strategy"), F.max("sharpe").alias("sharpe"))


@query("b24_deflated_sharpe")
def b24(t):
    from loomline.operators.statistics import deflated_sharpe

    d = deflated_sharpe(B.sim(sweep_signals(t), wide(t), resample="M", position_limit=20).nav)
    return d.select("strategy", "n", *[rd(c).alias(c) for c in ("sharpe", "skew", "kurt", "threshold", "dsr")])


@query("b25_stress_test", f"""
WITH {_LAGD}, {_THREE}, shock(market, shock) AS (VALUES ('ASIA', -0.2), ('EUROPE', -0.1), ('AMERICA', -0.15), ('AFRICA', -0.25), ('MIDDLE EAST', -0.3))
SELECT strategy, date, {r('sum(weight * coalesce(shock, 0))')} AS loss FROM tw JOIN universe USING (sym) LEFT JOIN shock USING (market) GROUP BY 1, 2""")
def b25(t):
    from loomline.operators.risk import stress

    shocks = {"ASIA": -0.2, "EUROPE": -0.1, "AMERICA": -0.15, "AFRICA": -0.25, "MIDDLE EAST": -0.3}
    w = three_strategies(t).join(t.universe(), "sym")
    return stress(w, shocks, "market").withColumn("loss", rd("loss"))


_B26 = f"""
SELECT 'new_high' AS strategy, date, sym, 0 AS v FROM (SELECT date, sym, high, {full('max', 'high', 52)} AS m FROM bars_w {win(52)}) WHERE high = m
UNION ALL SELECT 'rsi', date, sym, round(v, 6) FROM v WHERE v IS NOT NULL
UNION ALL SELECT 'low_price', date, sym, 0 FROM bars_w WHERE close < 1500"""


@query("b26_example_strategies", f"WITH {_RSI14}, {sim_sql(_B26, month('date'), limit=20)} {stats_sql()}")
def b26(t):
    b = indicators(t.stored("W").select("date", "sym", "high", "close"),
                   [("MAX", "m", {"timeperiod": 52, "source": "high"}), ("RSI", "rsi", {})])
    flat = F.lit(0.0)
    s = b.select("date", "sym", F.explode(F.array(
        F.struct(F.lit("new_high").alias("strategy"), P.holds(F.col("high") == F.col("m")).alias("signal"), flat.alias("v")),
        F.struct(F.lit("rsi").alias("strategy"), F.col("rsi").isNotNull().alias("signal"), F.round("rsi", 6).alias("v")),
        F.struct(F.lit("low_price").alias("strategy"), (F.col("close") < 1500).alias("signal"), flat.alias("v")),
    )).alias("s")).select("date", "sym", "s.*")
    return report(B.sim(s, wide(t), resample="M", position_limit=20, rank="v").report())


@query("b27_rolling_sharpe", f"""
WITH {_LAGD}, {_THREE}, {_SRET}
SELECT strategy, date, {r('CASE WHEN count(ret) OVER w = 26 THEN avg(ret) OVER w / nullif(stddev_samp(ret) OVER w, 0) * sqrt(52) END')} AS sharpe
FROM sr WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)""")
def b27(t):
    return B.rolling_sharpe(strategy_returns(t), 26, 52).select("strategy", "date", rd("sharpe").alias("sharpe"))


@query("b28_target_positions", f"""
WITH s AS (SELECT date, sym, close, count(*) OVER (PARTITION BY date) AS n FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, sym) AS rk FROM bars_w) WHERE rk <= 20)
SELECT date, sym, CAST(floor(1e6 / n / close) AS BIGINT) AS shares FROM s""")
def b28(t):
    b = t.stored("W").select("date", "sym", "close", "volume")
    return B.target_positions(P.top(b.select("date", "sym", "volume"), "volume", 20), b.select("date", "sym", F.col("close").alias("price")), 1e6).select(
        "date", "sym", F.col("shares").cast("bigint").alias("shares"))


@query("t07_first_trades", f"""
WITH {sim_sql(MOM, month('date'))}, {_SPELLS}
SELECT strategy, sym, entry_date, {r('ret')} AS ret FROM trades ORDER BY entry_date, sym LIMIT 5""")
def t07(t):
    return mom_sim(t).get_trades().orderBy("entry_date", "sym").limit(5).select("strategy", "sym", "entry_date", rd("ret").alias("ret"))


@query("a13_trade_statistics", f"""
WITH {sim_sql(MOM, month('date'))}, {_SPELLS}
SELECT strategy, count(*) AS n_trades, {r('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {r('avg(days)')} AS avg_days,
  {r('avg(ret)')} AS avg_ret, {r('exp(sum(ln(1 + ret))) - 1')} AS compounded FROM trades WHERE exit_date IS NOT NULL GROUP BY strategy""")
def a13(t):
    d = B.trade_statistics(mom_sim(t).get_trades())
    return d.select("strategy", "n_trades", *[rd(c).alias(c) for c in ("win_rate", "avg_days", "avg_ret", "compounded")])


# ---- orders and holdings --------------------------------------------------


@query("j17_order_trigger", """
SELECT o.order_id, o.sym, o.date, o.qty, min(b.date) AS trigger_date FROM orders_t o LEFT JOIN bars_w b ON b.sym = o.sym AND b.date > o.date AND (
  o.type = 'Market' OR (o.type = 'Limit' AND o.side = 'Buy' AND b.low <= o.limit_price) OR (o.type = 'Limit' AND o.side = 'Sell' AND b.high >= o.limit_price)
  OR (o.type = 'StopLoss' AND o.side = 'Sell' AND b.low <= o.limit_price) OR (o.type = 'StopLoss' AND o.side = 'Buy' AND b.high >= o.limit_price))
GROUP BY o.order_id, o.sym, o.date, o.qty, o.limit_price, o.side, o.type""")
def j17(t):
    return B.trigger_dates(t.orders(), t.stored("W")).select("order_id", "sym", "date", "qty", "trigger_date")


_HOLD = """
d AS (SELECT sym, date, sum(CASE WHEN side = 'Buy' THEN qty ELSE 0 END) AS bq, sum(CASE WHEN side = 'Buy' THEN qty * price ELSE 0 END) AS ba,
  sum(CASE WHEN side = 'Sell' THEN qty ELSE 0 END) AS sq, sum(CASE WHEN side = 'Sell' THEN qty * price ELSE 0 END) AS sa FROM orders_t GROUP BY 1, 2),
c AS (SELECT *, sum(bq - sq) OVER w AS quantity, sum(ba) OVER w / nullif(sum(bq) OVER w, 0) AS avg_cost FROM d
  WINDOW w AS (PARTITION BY sym ORDER BY date ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, sa - sq * coalesce(avg_cost, 0) AS realised FROM c),
hl AS (SELECT sym, arg_max(quantity, date) AS quantity, arg_max(avg_cost, date) AS avg_cost, sum(realised) AS realised_total FROM h GROUP BY sym),
lp AS (SELECT sym, arg_max(close, date) AS price FROM bars_w GROUP BY sym)"""


@query("a14_average_cost", f"WITH {_HOLD} SELECT sym, date, quantity, {r('avg_cost')} AS avg_cost, {r('realised', 3)} AS realised FROM h")
def a14(t):
    return B.holdings(t.orders()).select("sym", "date", "quantity", rd("avg_cost").alias("avg_cost"), rd("realised", 3).alias("realised"))


@query("j21_position_value", f"""
WITH {_HOLD} SELECT sym, quantity, {r('quantity * price', 3)} AS market_value, {r('quantity * (price - avg_cost)', 3)} AS pnl,
  {r('price / nullif(avg_cost, 0) - 1')} AS pnl_ratio FROM hl LEFT JOIN lp USING (sym)""")
def j21(t):
    m = B.mark(B.latest_holdings(t.orders()), t.bars("W"))
    return m.select("sym", "quantity", rd("market_value", 3).alias("market_value"), rd("pnl", 3).alias("pnl"), rd("pnl_ratio").alias("pnl_ratio"))


@query("a15_account_totals", f"""
WITH {_HOLD} SELECT count(*) AS n_positions, {r('sum(quantity * price)', 2)} AS market_value, {r('1e6 + sum(quantity * price)', 2)} AS total_value
FROM hl LEFT JOIN lp USING (sym)""")
def a15(t):
    a = B.account(B.mark(B.latest_holdings(t.orders()), t.bars("W")), 1e6)
    return a.select("n_positions", rd("market_value", 2).alias("market_value"), rd("total_value", 2).alias("total_value"))


@query("a10_treemap", f"""
WITH p AS (SELECT sym, sum(turnover) AS turnover, arg_max(close, date) / nullif(arg_min(close, date), 0) - 1 AS ret FROM bars_w GROUP BY sym)
SELECT category, sym, {r('sum(turnover)', 2)} AS turnover, {r('avg(ret)')} AS ret, count(*) AS n FROM p JOIN universe USING (sym)
GROUP BY GROUPING SETS ((category, sym), (category), ())""")
def a10(t):
    m = B.treemap(t.bars("W"), t.universe())
    return m.select("category", "sym", rd("area", 2).alias("turnover"), rd("item").alias("ret"), "n")


@query("a10_treemap_market_value", f"""
WITH v AS (SELECT b.sym, b.date, close * shares AS mv, close / nullif(net / nullif(shares, 0), 0) AS pe
  FROM bars_w b ASOF LEFT JOIN funda f ON b.sym = f.sym AND b.date >= f.available WHERE b.date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'),
p AS (SELECT sym, max_by(mv, date) FILTER (mv IS NOT NULL) AS area, max_by(pe, date) FILTER (pe IS NOT NULL) AS pe FROM v GROUP BY sym)
SELECT category, sym, {r('sum(area)', 2)} AS area, {r('avg(CASE WHEN pe IS NOT NULL THEN least(greatest(pe, 0), 50) END)', 4)} AS item, count(*) AS n
FROM p JOIN universe USING (sym) GROUP BY GROUPING SETS ((category, sym), (category), ())""")
def a10_market_value(t):
    m = B.treemap(valuation(t.bars("W").select("date", "sym", "close"), t.fundamentals()), t.universe(),
                  start="1995-01-01", end="1996-06-30", area="market_value", item="pe", clip=(0, 50))
    return m.select("category", "sym", rd("area", 2).alias("area"), rd("item", 4).alias("item"), "n")


@query("a10_treemap_turnover_ratio", f"""
WITH p AS (SELECT sym, sum(turnover) AS area, sum(turnover) / nullif(sum(sum(turnover)) OVER (), 0) AS item FROM bars_w
  WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-03-31' GROUP BY sym)
SELECT category, sym, {r('sum(area)', 2)} AS area, {r('avg(item)')} AS item, count(*) AS n
FROM p JOIN universe USING (sym) GROUP BY GROUPING SETS ((category, sym), (category), ())""")
def a10_turnover_ratio(t):
    m = B.treemap(t.bars("W", start="1995-01-01", end="1995-03-31"), t.universe(), start="1995-01-01", end="1995-03-31", item="turnover_ratio")
    return m.select("category", "sym", rd("area", 2).alias("area"), rd("item").alias("item"), "n")


@query("a11_sunburst", f"""
WITH {_LAGD}, {_THREE}
SELECT strategy, category, sym, {r('sum(weight)')} AS weight FROM tw JOIN universe USING (sym) GROUP BY ROLLUP (strategy, category, sym)""")
def a11(t):
    return B.sunburst(three_strategies(t).join(t.universe(), "sym")).withColumn("weight", rd("weight"))
