"""Labels, information coefficients, quantiles, folds, attribution."""

from pyspark.sql import functions as F

from loomline.functions.indicators import indicators
from loomline.operators import factors as E
from loomline.operators.panel import for_each_param
from loomline.plans.indicators_queries import ALL, full
from loomline.plans.panel_queries import sma, win
from loomline.plans.registry import query, r, rd
from loomline.plans.risk_queries import returns
from loomline.session import written

NAMES = ["mom", "ratio", "vol"]
_FEAT = f"""
feat AS (SELECT date, sym, close / lag(close, 4) OVER p - 1 AS mom, round(close / ({sma(10)}), 9) AS ratio,
  round(({full('stddev_samp', 'close', 20)}) / close, 9) AS vol, lead(close, 4) OVER p / close - 1 AS label
  FROM bars_w WINDOW p AS ({ALL}), {win(10, 20)[7:]}),
fl AS (SELECT date, sym, label, factor, value FROM feat UNPIVOT (value FOR factor IN (mom, ratio, vol)) WHERE label IS NOT NULL)"""
_RK = """
rk AS (SELECT *, rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY factor, date ORDER BY label) + (count(*) OVER (PARTITION BY factor, date, label) - 1) / 2.0::DOUBLE AS b FROM fl),
ic AS (SELECT factor, date, CASE WHEN NOT isnan(corr(a, b)) THEN corr(a, b) END AS ic, count(*) AS n FROM rk GROUP BY 1, 2)"""
_Q5 = "q5 AS (SELECT *, ntile(5) OVER (PARTITION BY factor, date ORDER BY value, sym) AS quantile FROM fl)"
_FR = f"{_Q5}, fr AS (SELECT factor, date, avg(label) FILTER (quantile = 5) - avg(label) FILTER (quantile = 1) AS ret FROM q5 GROUP BY 1, 2)"


def features(t):
    """Three factors and the forward label, one window pass over the bars."""
    b = indicators(t.bars("W").select("date", "sym", "close"), [
        ("RETURN", "mom", {"timeperiod": 4}), ("SMA", "ma", {"timeperiod": 10}), ("STDDEV", "sd", {"timeperiod": 20})])
    b = E.price_change(b, 4)
    return b.select("date", "sym", "mom", F.round(F.col("close") / F.col("ma"), 9).alias("ratio"),
                    F.round(F.col("sd") / F.col("close"), 9).alias("vol"), "label")


def stored_features(t):
    """The features written once: the windows are passed once, however often they are read."""
    return t.once("features", lambda: features(t))


def factor_rows(t):
    return E.long_factors(features(t), NAMES)


@query("e01_price_change", f"SELECT date, sym, {r(f'lead(close, 21) OVER ({ALL}) / close - 1')} AS label FROM bars_w")
def e01(t):
    return E.price_change(t.bars("W").select("date", "sym", "close"), 21).select("date", "sym", rd("label").alias("label"))


@query("e02_risk_adjusted_label", f"""
WITH x AS (SELECT date, sym, lead(close, 21) OVER p / close - 1 AS f, close / lag(close) OVER p - 1 AS ret FROM bars_w WINDOW p AS ({ALL}))
SELECT date, sym, {r(f"f / nullif({full('stddev_samp', 'ret', 21)}, 0)")} AS label FROM x {win(21)}""")
def e02(t):
    return E.risk_adjusted_return(t.bars("W").select("date", "sym", "close"), 21).select("date", "sym", rd("label").alias("label"))


@query("e03_excess_over_mean", f"""
WITH x AS (SELECT date, sym, lead(close) OVER ({ALL}) / close - 1 AS f FROM bars_m)
SELECT date, sym, {r('f - avg(f) OVER (PARTITION BY date)')} AS label FROM x""")
def e03(t):
    return E.excess_over_mean(t.bars("M").select("date", "sym", "close")).select("date", "sym", rd("label").alias("label"))


@query("e04_ic_by_date", f"WITH {_FEAT}, {_RK} SELECT factor, date, {r('ic')} AS ic, n FROM ic")
def e04(t):
    return E.ic_by_date(factor_rows(t)).select("factor", "date", rd("ic").alias("ic"), "n")


@query("e04_ic_summary", f"""
WITH {_FEAT}, {_RK} SELECT factor, {r('avg(ic)')} AS ic_mean, {r('stddev_samp(ic)')} AS ic_std,
  {r('avg(ic) / stddev_samp(ic) * sqrt(count(ic))', 5)} AS t_stat, count(ic) AS n FROM ic GROUP BY factor""")
def e04b(t):
    s = E.ic_summary(E.ic_by_date(factor_rows(t)))
    return s.select("factor", rd("ic_mean").alias("ic_mean"), rd("ic_std").alias("ic_std"), rd("t_stat", 5).alias("t_stat"), "n")


@query("e05_factor_returns", f"WITH {_FEAT}, {_FR} SELECT factor, date, {r('ret')} AS ret FROM fr")
def e05(t):
    return E.factor_returns(factor_rows(t), 5).select("factor", "date", rd("ret").alias("ret"))


@query("e06_quantile_table", f"WITH {_FEAT}, {_Q5} SELECT factor, quantile, {r('avg(label)')} AS mean_ret, count(*) AS n FROM q5 GROUP BY 1, 2")
def e06(t):
    return E.quantile_table(factor_rows(t), 5).select("factor", "quantile", rd("mean_ret").alias("mean_ret"), "n")


@query("e07_prepare_data", f"""
WITH {_FEAT} SELECT date, sym, {r('mom')} AS mom, {r('ratio')} AS ratio, {r('vol')} AS vol, {r('label')} AS label FROM feat
WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND mom IS NOT NULL AND ratio IS NOT NULL AND vol IS NOT NULL AND label IS NOT NULL""")
def e07(t):
    f = features(t)
    d = E.prepare_data(f.drop("label"), f.select("date", "sym", "label"), NAMES, "1996-01-01", "2000-12-31")
    return d.select("date", "sym", *[rd(c).alias(c) for c in (*NAMES, "label")])


@query("e11_time_folds", """
WITH d AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS r FROM (SELECT DISTINCT date FROM bars_w)),
f AS (SELECT k AS fold, 'test' AS part, k * 26 + 1 AS lo, (k + 1) * 26 AS hi FROM range(0, 4) g(k)
  UNION ALL SELECT k, 'train', (k + 1) * 26 + 4 + 1, (k + 1) * 26 + 4 + 104 FROM range(0, 4) g(k))
SELECT date, CAST(fold AS INTEGER) AS fold, part, count(*) AS n FROM bars_w JOIN d USING (date) JOIN f ON r BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def e11(t):
    b = t.stored("W").select("date", "sym")
    return b.join(E.time_folds(b, 104, 26, 4, 4), "date").groupBy("date", "fold", "part").agg(F.count("*").alias("n"))


@query("e12_best_alpha", f"""
WITH {_FEAT}, {_RK} SELECT arg_max(factor, m) AS factor, max(m) AS ic_mean FROM (SELECT factor, {r('avg(ic)')} AS m FROM ic GROUP BY factor)""")
def e12(t):
    s = E.ic_summary(E.ic_by_date(factor_rows(t))).withColumn("ic_mean", rd("ic_mean"))
    return s.agg(F.max_by("factor", "ic_mean").alias("factor"), F.max("ic_mean").alias("ic_mean"))


@query("e13_centrality")
def e13(t):
    return E.centrality(E.factor_returns(factor_rows(t), 5), NAMES).withColumn("centrality", rd("centrality"))


def _r2(*names: str) -> str:
    """R2 of one, two or three of the factors from their correlations."""
    y = [f"y{n}" for n in names]
    pair = lambda a, b: f"r{min(a, b)}{max(a, b)}"
    if len(names) == 1:
        return f"{y[0]} * {y[0]}"
    if len(names) == 2:
        q = pair(*names)
        return f"({y[0]} * {y[0]} + {y[1]} * {y[1]} - 2 * {y[0]} * {y[1]} * {q}) / (1 - {q} * {q})"
    return ("((1 - r23 * r23) * y1 * y1 + (1 - r13 * r13) * y2 * y2 + (1 - r12 * r12) * y3 * y3 + 2 * (r13 * r23 - r12) * y1 * y2"
            " + 2 * (r12 * r23 - r13) * y1 * y3 + 2 * (r12 * r13 - r23) * y2 * y3) / (1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23)")


def _share(i: str, j: str, k: str) -> str:
    two = lambda a, b: "v" + "".join(sorted(a + b))
    return f"v{i} / 3 + ({two(i, j)} - v{j} + {two(i, k)} - v{k}) / 6 + (v123 - {two(j, k)}) / 3"


@query("e14_shapley", f"""
WITH {_FEAT}, d AS (SELECT year(date) AS year, * FROM feat WHERE mom IS NOT NULL AND ratio IS NOT NULL AND vol IS NOT NULL AND label IS NOT NULL),
c AS (SELECT year, corr(mom, label) AS y1, corr(ratio, label) AS y2, corr(vol, label) AS y3, corr(mom, ratio) AS r12, corr(mom, vol) AS r13,
  corr(ratio, vol) AS r23 FROM d GROUP BY year),
v AS (SELECT year, {_r2('1')} AS v1, {_r2('2')} AS v2, {_r2('3')} AS v3, {_r2('1', '2')} AS v12, {_r2('1', '3')} AS v13, {_r2('2', '3')} AS v23,
  {_r2('1', '2', '3')} AS v123 FROM c)
SELECT CAST(year AS INTEGER) AS year, 'mom' AS factor, {r(_share('1', '2', '3'))} AS shapley, {r('v123')} AS r2 FROM v
UNION ALL SELECT CAST(year AS INTEGER), 'ratio', {r(_share('2', '1', '3'))}, {r('v123')} FROM v
UNION ALL SELECT CAST(year AS INTEGER), 'vol', {r(_share('3', '1', '2'))}, {r('v123')} FROM v""")
def e14(t):
    d = features(t).withColumn("year", F.year("date"))
    return E.shapley(d, NAMES, "label", "year").select("year", "factor", rd("shapley").alias("shapley"), rd("r2").alias("r2"))


@query("e15_trend", f"""
WITH {_FEAT}, {_FR}, i AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date) AS i FROM fr WHERE ret IS NOT NULL)
SELECT factor, count(*) AS n, {r('regr_slope(ret, i)', 8)} AS slope, {r('regr_r2(ret, i)', 8)} AS r2 FROM i GROUP BY factor""")
def e15(t):
    from loomline.operators.statistics import trend

    s = trend(E.factor_returns(factor_rows(t), 5), "factor", "ret")
    return s.select("factor", "n", rd("slope", 8).alias("slope"), rd("r2", 8).alias("r2"))


@query("e15_trend_p_value")
def e15b(t):
    from loomline.operators.statistics import trend

    return trend(E.factor_returns(factor_rows(t), 5), "factor", "ret").select("factor", rd("p_value").alias("p_value"))


@query("e16_factor_analysis")
def e16(t):
    rows = written(factor_rows(t), "factors")
    ic = E.ic_summary(E.ic_by_date(rows))
    c = E.centrality(E.factor_returns(rows, 5), NAMES)
    return ic.join(c, "factor").select("factor", *[rd(x).alias(x) for x in ("ic_mean", "ic_std", "ratio", "centrality")])


@query("w27_factor_decay", f"""
WITH {_FEAT}, {_RK}, m AS (SELECT factor, date, CASE WHEN count(ic) OVER w = 12 THEN avg(ic) OVER w END AS m FROM ic
  WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT factor, date, {r('m')} AS rolling_ic, coalesce(m < -0.02, false) AS decayed FROM m""")
def w27(t):
    d = E.decay(E.ic_by_date(factor_rows(t)), 12, -0.02)
    return d.select("factor", "date", rd("rolling_ic").alias("rolling_ic"), "decayed")


@query("b20_ic_weights", f"""
WITH {_FEAT}, {_RK}, m AS (SELECT factor, date, CASE WHEN count(ic) OVER w = 12 THEN avg(ic) OVER w END AS m FROM ic
  WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
l AS (SELECT factor, date, greatest(x, 0) AS x FROM (SELECT factor, date, lag(m) OVER (PARTITION BY factor ORDER BY date) AS x FROM m) WHERE x IS NOT NULL)
SELECT date, factor, {r('x / nullif(sum(x) OVER (PARTITION BY date), 0)')} AS weight FROM l""")
def b20(t):
    return E.ic_weights(E.ic_by_date(factor_rows(t)), 12).withColumn("weight", rd("weight"))


@query("w22_label_bins", f"""
WITH x AS (SELECT date, sym, lead(close, 4) OVER ({ALL}) / close - 1 AS f FROM bars_w)
SELECT date, sym, ntile(8) OVER (PARTITION BY date ORDER BY f, sym) AS label FROM x WHERE f IS NOT NULL""")
def w22b(t):
    return E.price_change_bin(t.bars("W").select("date", "sym", "close"), 8, 4).select("date", "sym", "label")


@query("x03_grouped_score", f"""
WITH x AS (SELECT sym, close / lag(close) OVER ({ALL}) - 1 AS ret FROM bars_w)
SELECT sym, {r('avg(ret) / nullif(sqrt(avg(power(least(ret, 0), 2))), 0)')} AS score FROM x WHERE ret IS NOT NULL GROUP BY sym""")
def x03(t):
    return E.downside_score(returns(t)).select("sym", rd("score").alias("score"))


@query("x05_expand", f"""
SELECT date, sym, CAST(k AS INTEGER) AS band, {r('close * (1 + k * 0.01)')} AS price FROM bars_w, range(0, 5) g(k)""")
def x05(t):
    b = for_each_param(t.bars("W").select("date", "sym", "close"), list(range(5)), "band")
    return b.select("date", "sym", "band", rd(F.col("close") * (1 + F.col("band") * 0.01)).alias("price"))
