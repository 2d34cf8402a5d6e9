"""Statistics that need a normal quantile or a t distribution."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def deflated_sharpe(series: DataFrame, key: str = "strategy") -> DataFrame:
    """Probability that the Sharpe ratio exceeds the best of all trials by
    chance, with skew and kurtosis (Bailey and Lopez de Prado, 2014). One row
    per strategy reaches Python; the moments are aggregates."""
    m = series.groupBy(key).agg(
        F.count("ret").alias("n"),
        F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"),
        F.skewness("ret").alias("skew"),
        (F.kurtosis("ret") + 3).alias("kurt"),
    )
    trials = m.agg(F.count("*").alias("n_trials"), F.var_samp("sharpe").alias("v"))
    m = m.withColumns({"n_trials": trials.select("n_trials").scalar(), "v": trials.select("v").scalar()})

    @F.pandas_udf("threshold double, dsr double")
    def probability(n: pd.Series, sr: pd.Series, sk: pd.Series, ku: pd.Series, k: pd.Series, v: pd.Series) -> pd.DataFrame:
        rows = []
        for n_, s, a, b, k_, v_ in zip(n, sr, sk, ku, k, v):
            if k_ < 2 or pd.isna(v_):
                top = 0.0
            else:
                top = math.sqrt(v_) * ((1 - EULER_GAMMA) * _quantile(1 - 1 / k_) + EULER_GAMMA * _quantile(1 - 1 / (k_ * math.e)))
            var = 1 - a * s + (b - 1) / 4 * s * s
            ok = n_ > 1 and var > 0
            rows.append((top, _phi((s - top) * math.sqrt(n_ - 1) / math.sqrt(var)) if ok else None))
        return pd.DataFrame(rows, columns=["threshold", "dsr"])

    p = probability("n", "sharpe", "skew", "kurt", "n_trials", "v")
    return m.withColumn("_p", p).select(key, "n", "sharpe", "skew", "kurt", "_p.threshold", "_p.dsr")


def _betacf(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + num * d, 1.0 + num / c
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_tail(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1 - front * _betacf(b, a, 1 - x) / b


def trend(series: DataFrame, key: str, value: str) -> DataFrame:
    """Least squares of a value on time: slope, R2, p-value, one row per key.
    The time index is the row number of the by-date series."""
    d = series.where(F.col(value).isNotNull()).withColumn(
        "_i", F.row_number().over(Window.partitionBy(key).orderBy("date")).cast("double"))
    s = d.groupBy(key).agg(
        F.count("*").alias("n"), F.regr_slope(value, "_i").alias("slope"), F.regr_r2(value, "_i").alias("r2"))

    @F.pandas_udf("double")
    def p_value(n: pd.Series, r2: pd.Series) -> pd.Series:
        return pd.Series([
            None if k < 3 or q is None or pd.isna(q) else 0.0 if q >= 1 else t_tail(math.sqrt(q * (k - 2) / (1 - q)), k - 2)
            for k, q in zip(n, r2)], dtype="float64")

    return s.withColumn("p_value", p_value("n", "r2"))
