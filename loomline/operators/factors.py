"""Labels, information coefficients, quantiles, folds, attribution."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.indicators import rolled
from loomline.operators.panel import by_sym
from loomline.operators.ranking import correlation_of, tied_rank, tiles

MAX_SHAPLEY = 10


def threshold_signals(predictions: DataFrame, threshold: float) -> DataFrame:
    return predictions.withColumn("signal", F.coalesce(F.col("prediction") > threshold, F.lit(False)))


def backtest_data(bars: DataFrame, predictions: DataFrame) -> DataFrame:
    return bars.join(predictions, ["date", "sym"])


# ---- labels ---------------------------------------------------------------


def price_change(bars: DataFrame, period: int = 21, out: str = "label") -> DataFrame:
    return bars.withColumn(out, F.try_divide(F.lead("close", period).over(by_sym()), F.col("close")) - 1)


def risk_adjusted_return(bars: DataFrame, period: int = 21, out: str = "label") -> DataFrame:
    """Forward return over the deviation of the past ``period`` returns."""
    b = bars.withColumn("_r", F.try_divide("close", F.lag("close").over(by_sym())) - 1)
    b = price_change(b, period, "_f").withColumn("_s", rolled(F.stddev_samp, "_r", period))
    return b.withColumn(out, F.try_divide("_f", "_s")).drop("_r", "_f", "_s")


def excess_over_mean(bars: DataFrame, period: int = 1, out: str = "label") -> DataFrame:
    """Forward return minus its cross-section mean; bars at the label's frequency."""
    b = price_change(bars, period, "_f")
    m = b.groupBy("date").agg(F.avg("_f").alias("_m"))
    return b.join(m, "date").withColumn(out, F.col("_f") - F.col("_m")).drop("_f", "_m")


def price_change_bin(bars: DataFrame, bins: int, period: int = 21) -> DataFrame:
    b = price_change(bars, period, "_f").where(F.col("_f").isNotNull())
    return tiles(b, ["date"], [F.col("_f"), F.col("sym")], bins, "label").drop("_f")


def long_factors(features: DataFrame, names: list[str]) -> DataFrame:
    """(date, sym, factor, value, label) rows with both values present."""
    return features.unpivot(["date", "sym", "label"], names, "factor", "value").where(
        F.col("value").isNotNull() & F.col("label").isNotNull())


# ---- factor evaluation ---------------------------------------------------------


def ic_by_date(rows: DataFrame) -> DataFrame:
    """Spearman coefficient per factor and date: correlation of average ranks."""
    by = ["factor", "date"]
    d = tied_rank(rows, by, "value", "_a")
    d = tied_rank(d, by, "label", "_b")
    return d.groupBy(*by).agg(correlation_of("_a", "_b").alias("ic"), F.count("*").alias("n"))


def ic_summary(ic: DataFrame) -> DataFrame:
    sd = F.stddev_samp("ic")
    return ic.groupBy("factor").agg(
        F.avg("ic").alias("ic_mean"), sd.alias("ic_std"),
        F.try_divide(F.avg("ic"), sd).alias("ratio"),
        (F.try_divide(F.avg("ic"), sd) * F.sqrt(F.count("ic"))).alias("t_stat"), F.count("ic").alias("n"))


def quantile_rows(rows: DataFrame, bins: int = 5) -> DataFrame:
    return tiles(rows, ["factor", "date"], [F.col("value"), F.col("sym")], bins, "quantile")


def factor_returns(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Top minus bottom quantile label per factor and date."""
    q = quantile_rows(rows, bins)
    top, low = (F.avg(F.when(F.col("quantile") == k, F.col("label"))) for k in (bins, 1))
    return q.groupBy("factor", "date").agg((top - low).alias("ret"))


def quantile_table(rows: DataFrame, bins: int = 5) -> DataFrame:
    return quantile_rows(rows, bins).groupBy("factor", "quantile").agg(
        F.avg("label").alias("mean_ret"), F.count("*").alias("n"))


def decay(ic: DataFrame, n: int, floor: float) -> DataFrame:
    """Rolling mean of the coefficient; a factor below ``floor`` is flagged."""
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(-(n - 1), 0)
    m = F.when(F.count("ic").over(w) == n, F.avg("ic").over(w))
    return ic.withColumn("rolling_ic", m).withColumn("decayed", F.coalesce(F.col("rolling_ic") < floor, F.lit(False)))


def ic_weights(ic: DataFrame, n: int) -> DataFrame:
    """Weights proportional to the positive part of the rolling coefficient,
    known one date before use."""
    d = decay(ic, n, 0.0).withColumn(
        "_x", F.lag("rolling_ic").over(Window.partitionBy("factor").orderBy("date"))).where(F.col("_x").isNotNull())
    d = d.withColumn("_x", F.greatest("_x", F.lit(0.0)))
    s = d.groupBy("date").agg(F.sum("_x").alias("_s"))
    return d.join(s, "date").select("date", "factor", F.try_divide("_x", "_s").alias("weight"))


def prepare_data(features: DataFrame, labels: DataFrame, names: list[str], start=None, end=None) -> DataFrame:
    d = features.join(labels.select("date", "sym", "label"), ["date", "sym"])
    if start is not None:
        d = d.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        d = d.where(F.col("date") <= F.lit(end).cast("date"))
    return d.select("date", "sym", *names, "label").na.drop()


# ---- folds -----------------------------------------------------------------------


def time_folds(panel: DataFrame, train_length: int, test_length: int, n_splits: int, lookahead: int) -> DataFrame:
    """(date, fold, part). Bounds count back from the last date; ``lookahead``
    dates lie between the end of training and the start of the test."""
    if isinstance(lookahead, bool) or not isinstance(lookahead, int) or lookahead < 0:
        raise ValueError("lookahead must be a non-negative integer")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))  # one row per date
    d = panel.groupBy("date").agg(F.count("*").alias("_n")).select("date", F.row_number().over(w).alias("_r"))
    spans = []
    for k in range(n_splits):
        t0, t1 = k * test_length + 1, (k + 1) * test_length
        a = t1 + lookahead
        spans.append((k, "test", t0, t1))
        spans.append((k, "train", a + 1, a + train_length))
    s = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(p).alias("part"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                  for k, p, lo, hi in spans])
    return d.withColumn("_s", F.explode(s)).where(F.col("_r").between(F.col("_s.lo"), F.col("_s.hi"))).select(
        "date", "_s.fold", "_s.part")


# ---- attribution --------------------------------------------------------------------


def centrality(returns: DataFrame, factors: list[str], k: int | None = None) -> DataFrame:
    """Share of explained variance a factor carries, weighted by its absolute
    loadings in each leading component (Kinlaw, Kritzman, Turkington, 2012)."""
    wide = returns.groupBy("date").pivot("factor", factors).agg(F.first("ret")).na.drop()
    x = VectorAssembler(inputCols=factors, outputCol="x").transform(wide)
    model = PCA(k=k or len(factors), inputCol="x", outputCol="pc").fit(x)
    load = np.abs(model.pc.toArray())
    var = model.explainedVariance.toArray()
    score = (load / load.sum(axis=0) * var).sum(axis=1) / var.sum()
    return returns.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(factors, score)], "factor string, centrality double")


def _gram(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Sums and cross sums of the columns, one pass of ordinary aggregates."""
    aggs = [F.count("*").cast("double").alias("n")] + [F.sum(c).alias(f"s{i}") for i, c in enumerate(names)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"c{i}_{j}")
             for (i, a), (j, b) in itertools.combinations_with_replacement(enumerate(names), 2)]
    return rows.groupBy(*by).agg(*aggs)


def shapley(rows: DataFrame, features: list[str], target: str, by: str) -> DataFrame:
    """Exact contribution of each feature to R2 over all subsets, per group.
    Only the Gram sums of a group, one row, reach Python."""
    k = len(features)
    if k > MAX_SHAPLEY:
        raise ValueError(f"at most {MAX_SHAPLEY} features")
    g = _gram(rows.na.drop(subset=[*features, target]), [by], [*features, target])

    def r2(cov, subset):
        if not subset or cov[k, k] <= 0:
            return 0.0
        s = list(subset)
        b = np.linalg.lstsq(cov[np.ix_(s, s)], cov[s, k], rcond=None)[0]
        return float(b @ cov[s, k] / cov[k, k])

    def solve(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                n = row["n"]
                m = np.array([row[f"s{i}"] for i in range(k + 1)]) / n
                cov = np.zeros((k + 1, k + 1))
                for i in range(k + 1):
                    for j in range(i, k + 1):
                        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] / n - m[i] * m[j]
                val = {s: r2(cov, s) for z in range(k + 1) for s in itertools.combinations(range(k), z)}
                for i in range(k):
                    total = 0.0
                    for s in val:
                        if i not in s:
                            w = math.factorial(len(s)) * math.factorial(k - len(s) - 1) / math.factorial(k)
                            total += w * (val[tuple(sorted((*s, i)))] - val[s])
                    out.append((row[by], features[i], total, val[tuple(range(k))]))
            yield pd.DataFrame(out, columns=[by, "factor", "shapley", "r2"])

    t = dict(g.dtypes)[by]
    return g.mapInPandas(solve, f"{by} {t}, factor string, shapley double, r2 double")


def downside_score(panel: DataFrame) -> DataFrame:
    """A user-defined grouped aggregate over one symbol's bars: mean return
    over downside deviation."""

    @F.pandas_udf("double")
    def score(r: pd.Series) -> float:
        r = r.dropna()
        down = math.sqrt((np.minimum(r, 0) ** 2).mean()) if len(r) else 0.0
        return float(r.mean() / down) if down > 0 else None

    return panel.groupBy("sym").agg(score("ret").alias("score"))
