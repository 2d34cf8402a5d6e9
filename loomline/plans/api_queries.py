"""Strategies written with the fluent panels."""

from pyspark.sql import functions as F

from loomline.api import Data, run_strategy, sim
from loomline.plans.panel_queries import sma, win
from loomline.plans.registry import query
from loomline.plans.strategy_queries import _RSI14, report, sim_sql, stats_sql
from loomline.plans.sqlviews import month


def trend_strategy(data):
    close, volume = data.get("price:close"), data.get("price:volume")
    ma = close.rolling(20).mean()
    rsi = data.indicator("RSI", period=14)
    liquid = (close * volume).rolling(30).mean() > 50_000
    return (close > ma) & (rsi > 50) & liquid, (close < ma) | (rsi < 30)


@query("x01_user_strategy", f"""
WITH {_RSI14.replace('v AS (SELECT', 'v0 AS (SELECT')}, v AS (SELECT date, sym, v FROM bars_w LEFT JOIN v0 USING (date, sym)),
s AS (SELECT date, sym, close, {sma(20)} AS ma, {sma(30, 'close * volume')} AS dv FROM bars_w {win(20, 30)})
SELECT s.date, s.sym, coalesce(close > ma, false) AND coalesce(v > 50, false) AND coalesce(dv > 50000, false) AS buy,
  coalesce(close < ma, false) OR coalesce(v < 30, false) AS sell FROM s JOIN v USING (date, sym)""")
def x01(t):
    return run_strategy(trend_strategy, Data(t))


@query("x01_value_and_price", f"""
WITH f AS (SELECT sym, available AS date, net / equity AS roe FROM funda),
l AS (SELECT date, sym, row_number() OVER (PARTITION BY date ORDER BY round(roe, 9) DESC, sym) <= 30 AS top FROM f),
s AS (SELECT date, sym, close, {sma(20)} AS ma FROM bars_w {win(20)})
SELECT s.date, s.sym FROM s ASOF JOIN l ON s.sym = l.sym AND s.date >= l.date WHERE close < ma * 0.95 AND top""")
def x01b(t):
    """Names in the top of the visible equity returns and below their mean."""
    data = Data(t)
    roe, close = data.get("fundamental_features:roe"), data.get("price:close")
    pick = roe._with(F.round(roe.expr, 9)).top(30) & (close < close.average(20) * 0.95)
    return pick.signals().where(F.col("signal")).select("date", "sym")


@query("x01_panel_simulation", f"""
WITH s AS (SELECT date, sym, close, {sma(20)} AS a, {sma(10)} AS b FROM bars_w {win(10, 20)}),
e AS (SELECT date, sym, CASE WHEN coalesce(close < b, false) THEN 0 WHEN coalesce(close > a, false) THEN 1 END AS ev FROM s),
held AS (SELECT date, sym, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY sym ORDER BY date ROWS UNBOUNDED PRECEDING), 0) = 1 AS held FROM e),
{sim_sql("SELECT 'panel' AS strategy, date, sym, 0 AS v FROM held WHERE held", month('date'), limit=None)}
{stats_sql()}""")
def x01c(t):
    data = Data(t)
    data.set_storage()
    close = data.get("price:close")
    position = (close > close.average(20)).hold_until(close < close.average(10))
    return report(sim(position, data, resample="M", name="panel").report())
