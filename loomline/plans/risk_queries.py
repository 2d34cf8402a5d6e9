"""Portfolio weights, risk measures, limits."""

from pyspark.sql import functions as F

from loomline.functions.indicators import indicator
from loomline.operators import backtest as B
from loomline.operators import risk as R
from loomline.plans.indicators_queries import ALL
from loomline.plans.registry import query, r, rd
from loomline.plans.strategy_queries import MOM, mom_sim, report, sim_sql, stats_sql, volume_weights
from loomline.plans.sqlviews import month

RET = f"ret AS (SELECT date, sym, ret FROM (SELECT date, sym, close / lag(close) OVER ({ALL}) - 1 AS ret FROM bars_w) WHERE ret IS NOT NULL)"
# one weight per symbol, from its share of all turnover
WT = "wt AS (SELECT sym, sum(volume) / (SELECT sum(volume) FROM bars_w) AS weight FROM bars_w GROUP BY sym)"


def returns(t):
    b = indicator(t.stored("W").select("date", "sym", "close"), "RETURN", prefix="ret")
    return b.where(F.col("ret").isNotNull()).select("date", "sym", "ret")


def share_weights(t):
    b = t.stored("W").select("sym", "volume")
    return b.groupBy("sym").agg((F.sum("volume") / b.agg(F.sum("volume")).scalar()).alias("weight"))


@query("j18_covariance", f"""
WITH {RET} SELECT a.sym AS a, b.sym AS b, count(*) AS n, {r('covar_samp(a.ret, b.ret)')} AS cov
FROM ret a JOIN ret b ON a.date = b.date AND a.sym <= b.sym GROUP BY 1, 2""")
def j18(t):
    return R.covariance(returns(t)).select("a", "b", "n", rd("cov").alias("cov"))


@query("o01_equal_weight", f"SELECT date, sym, {r('1.0::DOUBLE / count(*) OVER (PARTITION BY date)', 8)} AS weight FROM bars_w")
def o01(t):
    return R.equal_weight(t.bars("W").select("date", "sym")).select("date", "sym", rd("weight", 8).alias("weight"))


@query("o02_market_cap_weight", f"""
WITH c AS (SELECT b.date, b.sym, close * shares AS cap FROM bars_w b ASOF JOIN funda f ON b.sym = f.sym AND b.date >= f.available)
SELECT date, sym, {r('cap / sum(cap) OVER (PARTITION BY date)', 8)} AS weight FROM c""")
def o02(t):
    from loomline.operators.panel import as_of

    c = as_of(t.bars("W").select("date", "sym", "close"), t.fundamentals(), ["shares"], "available")
    c = c.where(F.col("shares").isNotNull()).withColumn("cap", F.col("close") * F.col("shares"))
    return R.share_weight(c, "cap").select("date", "sym", rd("weight", 8).alias("weight"))


@query("o03_risk_parity", f"""
WITH {RET}, v AS (SELECT date, sym, CASE WHEN count(ret) OVER w = 20 THEN 1 / nullif(stddev_samp(ret) OVER w, 0) END AS iv FROM ret
  WINDOW w AS (PARTITION BY sym ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT date, sym, {r('iv / sum(iv) OVER (PARTITION BY date)', 8)} AS weight FROM v WHERE iv IS NOT NULL""")
def o03(t):
    return R.inverse_volatility(returns(t), 20).select("date", "sym", rd("weight", 8).alias("weight"))


RIDGE = 1e-4
# Correlations as the solvers see them: a date that a symbol lacks counts as its mean. Rows are numbered from 1.
CORR = f"""{RET}, tn AS (SELECT count(DISTINCT date) - 1.0::DOUBLE AS t FROM ret),
mu AS (SELECT sym, avg(ret) AS m, sqrt(sum((ret - (SELECT avg(b.ret) FROM ret b WHERE b.sym = a.sym)) ** 2) / (SELECT t FROM tn)) AS sd FROM ret a GROUP BY sym),
cx AS (SELECT date, dense_rank() OVER (ORDER BY sym) AS i, (ret - m) / sd AS x FROM ret JOIN mu USING (sym) WHERE sd > 1e-12),
nm AS (SELECT sym, sd, row_number() OVER (ORDER BY sym) AS i FROM mu WHERE sd > 1e-12),
rr AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (SELECT t FROM tn) + CASE WHEN a.i = b.i THEN {RIDGE} ELSE 0 END AS v FROM cx a JOIN cx b ON a.date = b.date GROUP BY 1, 2),
rf AS (SELECT a.i, list(coalesce(rr.v, 0.0) ORDER BY b.i) AS v FROM nm a CROSS JOIN nm b LEFT JOIN rr ON rr.i = a.i AND rr.j = b.i GROUP BY 1)"""


def _linear_sql(right: str) -> str:
    """Elimination, one column a step."""
    return f"""
WITH RECURSIVE {CORR}, e AS (
  SELECT CAST(0 AS BIGINT) AS k, i, list_append(rf.v, {right}) AS v FROM rf JOIN nm USING (i)
  UNION ALL
  SELECT a.k + 1, a.i, CASE WHEN a.i = p.i THEN list_transform(a.v, lambda x: x / a.v[p.i])
    ELSE list_transform(list_zip(a.v, p.v), lambda y: y[1] - y[2] * (a.v[p.i] / p.v[p.i])) END
  FROM e a JOIN e p ON p.i = a.k + 1 AND p.k = a.k
), w AS (SELECT sym, v[-1] / sd AS w FROM e JOIN nm USING (i) WHERE k = (SELECT max(i) FROM nm))
SELECT sym, {r('w / sum(w) OVER ()')} AS weight FROM w"""


# One symbol a step: its z solves its own condition with all others held; forty sweeps.
@query("o03_equal_risk_contribution", f"""
WITH RECURSIVE {CORR}, c AS (SELECT list(v ORDER BY i) AS m, count(*) AS n FROM rf), s AS (
  SELECT CAST(0 AS BIGINT) AS k, list_transform(range(n), lambda x: 1.0::DOUBLE / sqrt(n)) AS z FROM c
  UNION ALL
  SELECT k + 1, z[:i - 1] || [(sqrt(a * a + 4 * d / n) - a) / (2 * d)] || z[i + 1:] FROM (
    SELECT k, z, n, k % n + 1 AS i, m[k % n + 1][k % n + 1] AS d, list_dot_product(m[k % n + 1], z) - m[k % n + 1][k % n + 1] * z[k % n + 1] AS a
    FROM s, c WHERE k < 40 * n)
), w AS (SELECT sym, z[i] / sd AS w FROM nm, (SELECT z FROM s ORDER BY k DESC LIMIT 1))
SELECT sym, {r('w / sum(w) OVER ()')} AS weight FROM w""")
def o03b(t):
    return R.equal_risk_contribution(returns(t)).withColumn("weight", rd("weight"))


@query("o04_max_diversification", _linear_sql("1.0::DOUBLE"))
def o04(t):
    return R.max_diversification(returns(t)).withColumn("weight", rd("weight"))


@query("o05_min_variance", _linear_sql("1 / sd"))
def o05(t):
    return R.min_variance(returns(t)).withColumn("weight", rd("weight"))


_PF = f"{RET}, {WT}, pf AS (SELECT 'fixed' AS strategy, date, sum(weight * ret) AS ret FROM ret JOIN wt USING (sym) GROUP BY date)"


def fixed_portfolio(t):
    return R.portfolio_returns(returns(t), share_weights(t))


@query("o06_performance", f"""
WITH {_PF}, nv AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM pf WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31')
SELECT s.*, {r('v.vol')} AS volatility FROM ({stats_sql('nv', 52, 1.0)}) s, (SELECT stddev_samp(ret) * sqrt(52) AS vol FROM nv) v""")
def o06(t):
    s = fixed_portfolio(t).where(F.col("date").between("1996-01-01", "2000-12-31")).withColumn("strategy", F.lit("fixed"))
    return report(B.statistics(B.nav_of(s), 52), "volatility")


@query("o07_value_at_risk", f"""
WITH {_PF}, l AS (SELECT * FROM pf ORDER BY date DESC LIMIT 252) SELECT count(*) AS n, {r('-quantile_cont(ret, 0.05)')} AS "var" FROM l""")
def o07(t):
    return R.value_at_risk(fixed_portfolio(t)).withColumn("var", rd("var"))


@query("o08_conditional_var", f"""
WITH {_PF}, l AS (SELECT * FROM pf ORDER BY date DESC LIMIT 252)
SELECT count(*) AS n, {r('-avg(ret)')} AS cvar FROM l WHERE ret <= (SELECT quantile_cont(ret, 0.05) FROM l)""")
def o08(t):
    return R.conditional_var(fixed_portfolio(t)).withColumn("cvar", rd("cvar"))


@query("o09_risk_contribution", f"""
WITH {RET}, {WT}, c AS (SELECT a.sym AS a, b.sym AS b, covar_samp(a.ret, b.ret) AS cov FROM ret a JOIN ret b ON a.date = b.date GROUP BY 1, 2),
p AS (SELECT c.a AS sym, sum(x.weight * y.weight * cov) AS p FROM c JOIN wt x ON x.sym = c.a JOIN wt y ON y.sym = c.b GROUP BY 1)
SELECT sym, {r('p / (SELECT sum(p) FROM p)')} AS contribution FROM p""")
def o09(t):
    from loomline.operators.pairs import risk_contribution

    return risk_contribution(returns(t), share_weights(t)).select("sym", rd("contribution").alias("contribution"))


_VW = "vw AS (SELECT date, sym, category, volume / sum(volume) OVER (PARTITION BY date) AS weight FROM bars_w JOIN universe USING (sym))"


@query("o10_concentration", f"""
WITH {_VW} SELECT date, 'position' AS limit_name, CAST(sym AS VARCHAR) AS subject, {r('weight')} AS measure FROM vw WHERE weight > 0.04
UNION ALL SELECT date, 'sector', category, {r('sum(weight)')} FROM vw GROUP BY date, category HAVING sum(weight) > 0.12""")
def o10(t):
    return R.concentration(volume_weights(t), 0.04, 0.12).withColumn("measure", rd("measure"))


@query("o11_limit_breaches", f"""
WITH {sim_sql(MOM, month('date'))}, {_VW},
m AS (SELECT date, 'position' AS limit_name, max(weight) AS measure FROM vw GROUP BY date
  UNION ALL SELECT date, 'sector', max(s) FROM (SELECT date, category, sum(weight) AS s FROM vw GROUP BY 1, 2) GROUP BY date
  UNION ALL SELECT date, 'daily_loss', -ret FROM nav
  UNION ALL SELECT date, 'drawdown', 1 - nav / max(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) FROM nav),
l(limit_name, threshold) AS (VALUES ('position', 0.05::DOUBLE), ('sector', 0.15::DOUBLE), ('daily_loss', 0.02::DOUBLE), ('drawdown', 0.15::DOUBLE))
SELECT date, limit_name, {r('measure')} AS measure, threshold FROM m JOIN l USING (limit_name) WHERE measure >= threshold""")
def o11(t):
    m = R.limit_measures(volume_weights(t), mom_sim(t).nav)
    lim = {"position": 0.05, "sector": 0.15, "daily_loss": 0.02, "drawdown": 0.15}
    return R.breaches(m, lim).select("date", "limit_name", rd("measure").alias("measure"), "threshold")


@query("j20_pairs", f"""
WITH {RET}, c AS (SELECT a.sym AS a, b.sym AS b, corr(a.ret, b.ret) AS corr, count(*) AS n FROM ret a JOIN ret b ON a.date = b.date AND a.sym <> b.sym GROUP BY 1, 2),
best AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(corr, 9) DESC, b) AS rk FROM c WHERE n >= 60) WHERE rk = 1),
p AS (SELECT best.a, best.b, y.date, y.close AS y, x.close AS x FROM best JOIN bars_w y ON y.sym = best.a JOIN bars_w x ON x.sym = best.b AND x.date = y.date),
h AS (SELECT a, b, regr_slope(y, x) AS beta FROM p GROUP BY 1, 2),
s AS (SELECT p.a AS sym, p.b AS partner, date, beta, y - beta * x AS spread FROM p JOIN h USING (a, b))
SELECT sym, partner, date, {r('beta')} AS beta, {r('CASE WHEN count(spread) OVER w = 20 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END', 5)} AS z
FROM s WINDOW w AS (PARTITION BY sym ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def j20(t):
    from loomline.operators.pairs import best_partners, spread_scores

    p = best_partners(returns(t), 60)
    return spread_scores(p, t.stored("W").select("date", "sym", "close"), 20).select(
        "sym", "partner", "date", rd("beta").alias("beta"), rd("z", 5).alias("z"))
