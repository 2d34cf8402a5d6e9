import numpy as np
import pandas as pd
import pytest
from helpers import friday, panel
from pyspark.sql import functions as F

from loomline.operators import factors as E
from loomline.operators import pairs as P
from loomline.operators import risk as R
from loomline.operators.statistics import deflated_sharpe, t_tail, trend


@pytest.fixture(scope="module")
def rets(spark):
    rng = np.random.default_rng(0)
    rows = [(friday(i), s, float(rng.normal())) for i in range(60) for s in range(11) if (i + s) % 7]
    return spark.createDataFrame(rows, "date date, sym bigint, ret double").cache()


@pytest.mark.parametrize("block", [256, 3])
def test_covariance_blocks(rets, block):
    w = rets.toPandas().pivot(index="date", columns="sym", values="ret")
    got = {(x["a"], x["b"]): x for x in R.covariance(rets, block=block, dates_per_task=20, moments=True).collect()}
    assert len(got) == 66
    for (a, b), x in got.items():
        d = w[[a]].assign(y=w[b]).dropna()
        assert x["n"] == len(d) and x["cov"] == pytest.approx(np.cov(d[a], d["y"])[0, 1])
        assert x["var_a"] == pytest.approx(d[a].var()) and x["var_b"] == pytest.approx(d["y"].var())


def test_covariance_gives_pairs_where_they_are_made(spark):
    """Symbols are text, one pair has one date in common and one has none; no pair is shuffled."""
    rows = [(friday(i), s, float(i * k)) for s, k, days in (("a", 1, range(5)), ("b", 2, range(4, 9)), ("c", 3, range(6, 9))) for i in days]
    c = R.covariance(spark.createDataFrame(rows, "date date, sym string, ret double"), block=1)
    assert "Exchange" not in c._jdf.queryExecution().executedPlan().toString()
    got = {(x["a"], x["b"]): (x["n"], x["cov"]) for x in c.collect()}
    assert got == {("a", "a"): (5, 2.5), ("a", "b"): (1, None), ("b", "b"): (5, 10.0), ("b", "c"): (3, 6.0), ("c", "c"): (3, 9.0)}


@pytest.mark.parametrize("block", [256, 3])
def test_best_partners_over_blocks(rets, block):
    """One symbol equals another one, so that ties are decided; symbols without enough common dates have no partner."""
    few = rets.where("sym = 3 and date < '2020-03-01'").withColumn("sym", F.lit(77).cast("bigint"))
    twin = rets.where("sym = 2").withColumn("sym", F.lit(50).cast("bigint"))
    d = rets.unionByName(few).unionByName(twin).unionByName(twin.withColumn("sym", F.lit(49).cast("bigint")))
    d = d.unionByName(rets.where("sym = 1").withColumns({"sym": F.lit(90).cast("bigint"), "ret": F.lit(0.5)}))  # no variance
    w = d.toPandas().pivot(index="date", columns="sym", values="ret")
    want = {}
    for a in w:
        c = [(-round(w[a].corr(w[b]), 9), b) for b in w if a != b and (w[a].notna() & w[b].notna()).sum() >= 40 and w[b].std() > 0 and w[a].std() > 0]
        if c:
            want[a] = min(c)[1]
    assert 77 not in want and 90 not in want and want[2] == 49 and want[49] == 2
    got = P.best_partners(d, 40, block=block)
    assert {x["sym"]: x["partner"] for x in got.collect()} == want
    assert P.best_partners(d.limit(0), 40).count() == 0


def test_pairs_stay_in_their_tasks(spark, rets):
    """Blocks give a row a symbol each, not a row a pair."""
    def count(syms, others, weights, n, cov, var, other_var):
        return syms, n.shape[1] * np.ones(len(syms), "int64")

    rows = P.over_blocks(rets, count, "sym bigint, others long", block=3).collect()
    seen = {}
    for x in rows:
        seen[x["sym"]] = seen.get(x["sym"], 0) + x["others"]
    assert seen == {s: 11 for s in range(11)} and len(rows) <= 11 * 4


def test_blocks_are_not_sent_to_their_partners(rets):
    """Blocks are read where they are written: no shuffle of a copy for each partner block, none of pairs."""
    def count(syms, others, weights, n, cov, var, other_var):
        return syms, n.shape[1] * np.ones(len(syms), "int64")

    for d in (P.over_blocks(rets, count, "sym bigint, others long", block=3), R.covariance(rets, block=3)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "CartesianProduct" in plan


@pytest.mark.parametrize("block", [256, 2])
def test_contributions_against_pandas(spark, rets, block):
    share = {0: 0.3, 1: 0.2, 2: 0.15, 3: 0.15, 4: 0.2}
    w = spark.createDataFrame(list(share.items()), "sym bigint, weight double")
    c = rets.where("sym < 5").toPandas().pivot(index="date", columns="sym", values="ret").cov().to_numpy()
    x = np.array([share[s] for s in range(5)])
    want = x * (c @ x) / (x @ c @ x)
    got = {r["sym"]: r["contribution"] for r in P.risk_contribution(rets, w, block=block).collect()}
    assert [got[s] for s in range(5)] == pytest.approx(list(want))


def test_contributions_sum_to_one(spark, rets):
    w = spark.createDataFrame([(0, 0.3), (1, 0.2), (2, 0.15), (3, 0.15), (4, 0.2)], "sym bigint, weight double")
    assert P.risk_contribution(rets, w).agg(F.sum("contribution")).first()[0] == pytest.approx(1)


def test_solved_weights(rets):
    for f in (R.min_variance, R.max_diversification, R.equal_risk_contribution):
        w = {x["sym"]: x["weight"] for x in f(rets).collect()}
        assert sum(w.values()) == pytest.approx(1)
    m = rets.toPandas().pivot(index="date", columns="sym", values="ret").cov().to_numpy()
    x = np.array([w[i] for i in range(11)])
    share = x * (m @ x)
    assert share.std() / share.mean() < 0.2  # pairwise covariances, so close to equal


def test_var_and_cvar(spark):
    s = spark.createDataFrame([(friday(i), float(i) / 100) for i in range(-10, 11)], "date date, ret double")
    assert R.value_at_risk(s).first()["var"] == pytest.approx(0.09)
    assert R.conditional_var(s).first()["cvar"] == pytest.approx(0.095)


@pytest.mark.parametrize("bad", [None, -1, 1.5, True])
def test_fold_gap_must_be_a_number(spark, bad):
    with pytest.raises(ValueError):
        E.time_folds(panel(spark, {1: range(1, 30)}), 5, 3, 2, bad)


@pytest.mark.parametrize("gap", [0, 3])
def test_fold_gap(spark, gap):
    f = E.time_folds(panel(spark, {1: range(1, 31)}), 5, 3, 2, gap).toPandas()
    for k in (0, 1):
        test, train = (f[(f.fold == k) & (f.part == p)].date for p in ("test", "train"))
        assert len(test) == 3 and len(train) == 5
        assert (min(test) - max(train)).days == 7 * (gap + 1)


def test_labels_do_not_change_with_the_future(spark):
    a = {x["date"]: x["label"] for x in E.price_change(panel(spark, {1: [1, 2, 3, 4]}), 1).collect()}
    b = {x["date"]: x["label"] for x in E.price_change(panel(spark, {1: [1, 2, 3, 4, 9]}), 1).collect()}
    assert a[friday(3)] is None and all(b[d] == v for d, v in a.items() if v is not None)


def test_ic_perfect_and_ties(spark):
    rows = [(friday(0), s, "f", float(s), float(s * 2)) for s in range(6)] + [(friday(1), s, "f", 1.0, float(s)) for s in range(3)]
    d = spark.createDataFrame(rows, "date date, sym bigint, factor string, value double, label double")
    ic = {x["date"]: x["ic"] for x in E.ic_by_date(d).collect()}
    assert ic[friday(0)] == pytest.approx(1.0) and ic[friday(1)] is None


def test_shapley_adds_up(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=x @ [1.0, 0.5, 0.0] + rng.normal(size=200), g=1)
    s = E.shapley(spark.createDataFrame(pdf), ["a", "b", "c"], "y", "g").toPandas().set_index("factor")
    assert s.shapley.sum() == pytest.approx(s.r2.iloc[0]) and s.shapley["a"] > s.shapley["b"] > s.shapley["c"]
    with pytest.raises(ValueError):
        E.shapley(spark.createDataFrame(pdf), list("abcdefghijk"), "y", "g")


def test_t_tail_and_trend(spark):
    assert t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert t_tail(0.0, 5) == pytest.approx(1.0)
    d = spark.createDataFrame([("k", friday(i), 2.0 * i + (i % 2)) for i in range(10)], "k string, date date, v double")
    x = trend(d, "k", "v").first()
    assert x["slope"] == pytest.approx(2.0, abs=0.1) and x["p_value"] < 1e-6


def test_deflated_sharpe_in_range(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{k}", friday(i), float(rng.normal(0.01 * k, 0.1))) for k in range(4) for i in range(100)]
    d = deflated_sharpe(spark.createDataFrame(rows, "strategy string, date date, ret double")).toPandas()
    assert d.dsr.between(0, 1).all() and d.set_index("strategy").dsr["s3"] > d.set_index("strategy").dsr["s0"]


def test_limit_measures_keep_strategies_apart(spark):
    import datetime as dt

    from loomline.operators.risk import limit_measures

    d = dt.date(2024, 1, 5)
    w = spark.createDataFrame([("a", d, "x", 0.2), ("a", d, "x", 0.3), ("b", d, "y", 0.1)], "strategy string, date date, category string, weight double")
    nav = spark.createDataFrame([("a", d, 0.01, 1.01), ("b", d, -0.05, 0.95)], "strategy string, date date, ret double, nav double")
    got = {(r["strategy"], r["limit_name"]): round(r["measure"], 6) for r in limit_measures(w, nav).collect()}
    assert got == {
        ("a", "position"): 0.3, ("a", "sector"): 0.5, ("a", "daily_loss"): -0.01, ("a", "drawdown"): 0.0,
        ("b", "position"): 0.1, ("b", "sector"): 0.1, ("b", "daily_loss"): 0.05, ("b", "drawdown"): 0.0,
    }


@pytest.mark.parametrize("dates, symbols, ridge", [(60, 12, 1e-4), (60, 12, 1e-6), (20, 90, 1e-4)])
def test_solved_weights_meet_their_conditions(spark, dates, symbols, ridge):
    """On a full panel: C w constant, C w proportional to sigma, equal contributions; also with more symbols than dates."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(dates, symbols)) * rng.uniform(0.5, 3, symbols) + rng.normal(size=(dates, 1))
    rows = [(friday(i), f"s{j:03}", float(x[i, j])) for i in range(dates) for j in range(symbols)] + [(friday(i), "flat", 0.5) for i in range(dates)]
    d = spark.createDataFrame(rows, "date date, sym string, ret double")
    c = np.cov(x.T)
    c = c + ridge * np.diag(np.diag(c))

    def of(f):
        w = {r["sym"]: r["weight"] for r in f(d, ridge).collect()}
        assert "flat" not in w and sum(w.values()) == pytest.approx(1)
        return np.array([w[f"s{j:03}"] for j in range(symbols)])

    v = c @ of(R.min_variance)
    assert v == pytest.approx(np.full(symbols, v.mean()), rel=1e-5)
    v = c @ of(R.max_diversification) / np.sqrt(np.diag(c))
    assert v == pytest.approx(np.full(symbols, v.mean()), rel=1e-5)
    w = of(R.equal_risk_contribution)
    assert (w > 0).all()
    assert w * (c @ w) == pytest.approx(np.full(symbols, (w @ c @ w) / symbols), rel=1e-5)


def test_unsolved_weights_are_an_error(spark):
    rows = [(friday(i), f"s{j}", float((i * 7 + j * 3) % 5 - 2)) for i in range(12) for j in range(4)]
    d = spark.createDataFrame(rows, "date date, sym string, ret double")
    with pytest.raises(RuntimeError):
        R.equal_risk_contribution(d, rounds=1)
    assert R.equal_risk_contribution(d.limit(0)).count() == 0 and R.min_variance(d.limit(0)).count() == 0


def test_equal_risk_does_not_hang_on_rounded_values(spark, monkeypatch):
    """Over very many symbols the values that the line search compares are rounded; here the old one is always too small."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 12)) + rng.normal(size=(30, 1))
    d = spark.createDataFrame([(friday(i), j, float(x[i, j])) for i in range(30) for j in range(12)], "date date, sym bigint, ret double")
    sums = R._Panel.sums

    def rounded(self, of):
        return {k: np.r_[v[0] - 1e-7, v[1:]] if k == "f" else v for k, v in sums(self, of).items()}

    monkeypatch.setattr(R._Panel, "sums", rounded)
    w = R.equal_risk_contribution(d).toPandas().set_index("sym")["weight"].sort_index().to_numpy()
    c = np.cov(x.T)
    c[np.diag_indices(12)] *= 1 + R.RIDGE
    assert w * (c @ w) == pytest.approx(np.full(12, (w @ c @ w) / 12), rel=1e-5)


@pytest.mark.parametrize("dates, symbols", [(40, 9), (15, 60)])
def test_principal_components_against_numpy(spark, dates, symbols):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(dates, symbols)) + rng.normal(size=(dates, 2)) @ rng.normal(size=(2, symbols)) * 2
    rows = [(friday(i), j, float(x[i, j])) for i in range(dates) for j in range(symbols)]
    d = R.principal_components(spark.createDataFrame(rows, "date date, sym bigint, ret double"), 3).toPandas()
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    for c in (1, 2, 3):
        own = d[d.component == c].sort_values("sym")
        v = vectors[:, -c] * np.sign(vectors[np.argmax(np.abs(vectors[:, -c])), -c])
        assert own.loading.to_numpy() == pytest.approx(v, abs=1e-6)
        assert own.explained.to_numpy() == pytest.approx(np.full(symbols, values[-c] / symbols))
    assert R.principal_components(spark.createDataFrame(rows[:1], "date date, sym bigint, ret double"), 3).count() == 0
