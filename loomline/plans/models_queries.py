"""Forecast models, clustering, text models."""

from pyspark.sql import functions as F

from loomline.operators import backtest as B
from loomline.operators import factors as E
from loomline.operators import models as M
from loomline.operators.panel import holds, top
from loomline.operators.ranking import correlation_of, tiles
from loomline.operators.risk import principal_components
from loomline.operators.text import frequent_lexicon, sentiment
from loomline.plans.factors_queries import _FEAT, NAMES, stored_features
from loomline.plans.registry import query, r, rd
from loomline.plans.risk_queries import CORR, RIDGE, returns
from loomline.plans.strategy_queries import report, stats_sql, wide


def engine(t, n_splits=5):
    return M.MLEngine(stored_features(t).na.drop(), NAMES, 104, 26, n_splits, 4)


def _rank_score(p):
    """Mean over deviation of the top-minus-bottom label of each date."""
    q = tiles(p, ["setting", "date"], [F.col("prediction"), F.col("sym")], 5, "q")
    d = q.groupBy("setting", "date").agg(
        (F.avg(F.when(F.col("q") == 5, F.col("label"))) - F.avg(F.when(F.col("q") == 1, F.col("label")))).alias("ret"))
    return d.groupBy("setting").agg(F.count("*").alias("n"), F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("score"))


@query("e08_train_predict")
def e08(t):
    return engine(t).train_predict("lightgbm", n_estimators=10, max_depth=3, learning_rate=0.1).withColumn("prediction", rd("prediction"))


@query("e09_auto_search")
def e09(t):
    grid = [{"model": "ridge", "reg": 0.1}, {"model": "random_forest", "n_estimators": 5, "max_depth": 3}, {"model": "xgboost", "n_estimators": 3}]
    found = M.auto_search(engine(t), grid, _rank_score, time_budget=3600)
    return found.select("setting", "n", rd("score").alias("score"), "tried")


@query("e10_selected_features")
def e10(t):
    e = engine(t)
    e.train_predict("random_forest", n_estimators=10)
    return e.importances().withColumn("importance", rd("importance"))


def _fit_sql(folds: int) -> str:
    """Least squares by normal equations for each fold; ``p`` has its test rows with predictions."""
    return f"""
{_FEAT}, f0 AS (SELECT * FROM feat WHERE mom IS NOT NULL AND ratio IS NOT NULL AND vol IS NOT NULL AND label IS NOT NULL),
d AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS r FROM (SELECT DISTINCT date FROM f0)),
f AS (SELECT k AS fold, 'test' AS part, k * 26 + 1 AS lo, (k + 1) * 26 AS hi FROM range(0, {folds}) g(k)
  UNION ALL SELECT k, 'train', (k + 1) * 26 + 5, (k + 1) * 26 + 108 FROM range(0, {folds}) g(k)),
j AS (SELECT f0.*, fold, part FROM f0 JOIN d USING (date) JOIN f ON r BETWEEN lo AND hi),
c AS (SELECT fold, avg(mom) AS m1, avg(ratio) AS m2, avg(vol) AS m3, avg(label) AS my, var_pop(mom) AS a, var_pop(ratio) AS b, var_pop(vol) AS c,
  covar_pop(mom, ratio) AS x, covar_pop(mom, vol) AS y, covar_pop(ratio, vol) AS z, covar_pop(mom, label) AS u, covar_pop(ratio, label) AS v,
  covar_pop(vol, label) AS w FROM j WHERE part = 'train' GROUP BY fold),
e AS (SELECT *, a * (b * c - z * z) - x * (x * c - y * z) + y * (x * z - b * y) AS det FROM c),
o AS (SELECT fold, m1, m2, m3, my, ((b * c - z * z) * u + (y * z - x * c) * v + (x * z - y * b) * w) / det AS b1,
  ((y * z - x * c) * u + (a * c - y * y) * v + (x * y - a * z) * w) / det AS b2, ((x * z - y * b) * u + (x * y - a * z) * v + (a * b - x * x) * w) / det AS b3 FROM e),
p AS (SELECT date, sym, CAST(fold AS INTEGER) AS fold, label, my + b1 * (mom - m1) + b2 * (ratio - m2) + b3 * (vol - m3) AS prediction
  FROM j JOIN o USING (fold) WHERE part = 'test')"""


@query("e17_linear_fit", f"""
WITH {_fit_sql(5)}
SELECT fold, count(*) AS n, {r('corr(prediction, label)')} AS corr, {r('sqrt(avg(power(prediction - label, 2)))', 4)} AS rmse FROM p GROUP BY fold""")
def e17_linear(t):
    return engine(t).train_predict("linear").groupBy("fold").agg(
        F.count("*").alias("n"), rd(correlation_of("prediction", "label")).alias("corr"),
        rd(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("label"), F.lit(2.0)))), 4).alias("rmse"))


@query("e08_predict_new_rows", f"""
WITH {_fit_sql(1)}, last AS (SELECT max(date) AS date FROM feat)
SELECT sym, {r('my + b1 * (mom - m1) + b2 * (ratio - m2) + b3 * (vol - m3)')} AS prediction FROM feat, o WHERE date = (SELECT date FROM last)""")
def e08_new(t):
    """Scores of the last date, whose labels are not known yet."""
    e = engine(t, 1)
    e.train_predict("linear")
    f = stored_features(t)
    last = f.agg(F.max("date")).scalar()
    return e.predict(f.where(F.col("date") == last).select("sym", *NAMES)).select("sym", rd("prediction").alias("prediction"))


@query("e17_linear_family")
def e17(t):
    e = engine(t)
    out = None
    for m, reg in (("linear", 0.0), ("ridge", 0.1), ("lasso", 0.01)):
        p = e.train_predict(m, reg=reg).withColumn("model", F.lit(m))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("model", "fold").agg(
        F.count("*").alias("n"), rd(correlation_of("prediction", "label")).alias("corr"),
        rd(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("label"), F.lit(2.0)))), 4).alias("rmse"))


@query("e18_forest_long_short")
def e18(t):
    p = engine(t).train_predict("random_forest", n_estimators=10)
    q = tiles(p, ["date"], [F.col("prediction"), F.col("sym")], 10, "q")
    w = q.where(F.col("q").isin(1, 10)).withColumn("side", F.when(F.col("q") == 10, 1.0).otherwise(-1.0))
    n = w.groupBy("date", "q").agg(F.count("*").alias("n"))
    return w.join(n, ["date", "q"]).select("date", "sym", rd(F.col("side") / F.col("n") / 2).alias("weight"), rd("label").alias("label"))


@query("b21_ml_rank")
def b21(t):
    p = engine(t).train_predict("random_forest", n_estimators=10)
    s = p.select("date", "sym", F.lit(True).alias("signal"), F.round("prediction", 9).alias("v"))
    return report(B.sim(s, wide(t), resample="M", position_limit=10, rank="v", name="ml_rank").report())


@query("b23_walk_forward", f"""
WITH {_fit_sql(3)}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(prediction, 9) DESC, sym) AS k FROM p),
s AS (SELECT CAST(fold AS VARCHAR) AS strategy, date, avg(label) AS ret FROM k WHERE k <= 10 GROUP BY 1, 2),
nav AS (SELECT *, 1e7::DOUBLE * exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM s)
{stats_sql()}""")
def b23(t):
    """Fit per fold, score its test dates, join the folds, report per fold."""
    p = engine(t, 3).train_predict("linear")
    k = top(p.select("date", "sym", "fold", F.round("prediction", 9).alias("v"), "label"), "v", 10)
    d = k.groupBy(F.col("fold").cast("string").alias("strategy"), "date").agg(F.avg("label").alias("ret"))
    return report(B.statistics(B.nav_of(d), 52))


def _components_sql(k: int, squarings: int = 18) -> str:
    """A component at a time: squaring the matrix again and again leaves its leading vector in every column; it is then
    taken out of the matrix."""
    parts = [f"""{CORR}, m1 AS (SELECT list(list_transform(v, lambda x, j: CASE WHEN j = i THEN x - {RIDGE} ELSE x END) ORDER BY i) AS m FROM rf),
tr AS (SELECT CAST(len(m) AS DOUBLE) AS n FROM m1)"""]
    product = "list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b)))"
    for c in range(1, k + 1):
        parts.append(f"""s{c} AS (SELECT 0 AS step, m FROM m{c} UNION ALL
  SELECT step + 1, list_transform(p, lambda a: list_transform(a, lambda b: b / d)) FROM (
    SELECT step, p, list_sum(list_transform(p, lambda a, i: a[i])) AS d FROM (SELECT step, {product} AS p FROM s{c} WHERE step < {squarings}))),
v{c} AS (SELECT list_transform(a, lambda x: x / sqrt(list_dot_product(a, a)) * sign(list_extract(list_sort(list_transform(a, lambda y: [abs(y), y]), 'DESC'), 1)[2])) AS v
  FROM (SELECT m[list_position(g, list_max(g))] AS a FROM (SELECT m, list_transform(m, lambda a, i: a[i]) AS g FROM s{c} WHERE step = {squarings}))),
l{c} AS (SELECT list_dot_product(v, list_transform(m, lambda a: list_dot_product(a, v))) AS value, v, m FROM m{c}, v{c})""")
        if c < k:
            parts.append(f"m{c + 1} AS (SELECT list_transform(m, lambda a, i: list_transform(a, lambda x, j: x - value * v[i] * v[j])) AS m FROM l{c})")
    rows = " UNION ALL ".join(
        f"SELECT CAST({c} AS INTEGER) AS component, nm.sym, {r('v[nm.i]', 5)} AS loading, {r('value / tr.n')} AS explained FROM l{c}, nm, tr" for c in range(1, k + 1))
    return f"WITH RECURSIVE {', '.join(parts)} {rows}"


@query("e19_pca_risk_factors", _components_sql(3))
def e19(t):
    return principal_components(returns(t), 3).withColumns({"loading": rd("loading", 5), "explained": rd("explained")})


@query("e20_asset_clusters")
def e20(t):
    p = returns(t).groupBy("sym").agg(
        F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("skew"), F.expr("percentile_approx(ret, 0.5)").alias("mid"))
    return M.cluster_assets(p, ["mean", "sd", "skew", "mid"], 5)


@query("e21_sentiment", """
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents),
c AS (SELECT word, count(*) AS c FROM w WHERE word <> '' GROUP BY word ORDER BY c DESC, word LIMIT 20),
x AS (SELECT word, CASE WHEN row_number() OVER (ORDER BY c DESC, word) % 2 = 1 THEN 1 ELSE -1 END AS score FROM c)
SELECT doc_id, CAST(sum(score) AS BIGINT) AS score, count(*) AS n_words FROM w JOIN x USING (word) GROUP BY doc_id""")
def e21(t):
    d = t.raw("documents").select("doc_id", "text")
    return sentiment(d, frequent_lexicon(d)).select("doc_id", "score", "n_words")


@query("e22_topics")
def e22(t):
    return M.topics(t.raw("documents"), 5, rounds=5).withColumn("weight", rd("weight"))


@query("e23_word_vectors")
def e23(t):
    w = M.tokens(t.raw("documents"))
    counts = M.word_counts(w)
    m = M.word_vectors(w, counts=counts)
    word = counts.where(F.length("word") >= 3).orderBy(F.desc("c"), "word").limit(1).first()["word"]
    return m.findSynonyms(word, 10).select(F.lit(word).alias("term"), F.col("word").alias("near"), rd("similarity", 4).alias("similarity"))
