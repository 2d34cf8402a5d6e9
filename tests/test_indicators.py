import math

import pytest
from helpers import friday, panel, values
from pyspark.sql import functions as F

from loomline.functions.indicators import indicator, indicators, names, output_columns
from loomline.operators.indicator_tables import adjust, prefix_product


def test_rsi_flat_up_down(spark):
    b = panel(spark, {1: [5] * 20, 2: range(1, 21), 3: range(40, 20, -1)})
    for kind in ("RSI", "RSI_SIMPLE"):
        last = {x["sym"]: x["r"] for x in indicator(b, kind, prefix="r", timeperiod=5).where(F.col("date") == "2020-05-15").collect()}
        assert last == {1: 50.0, 2: 100.0, 3: 0.0}


def test_rolling_needs_full_window(spark):
    b = panel(spark, {1: [1, 2, 3, 4]})
    assert values(indicator(b, "SMA", prefix="m", timeperiod=3), "m") == [None, None, 2.0, 3.0]
    assert values(indicator(panel(spark, {1: [1, 2]}), "SMA", prefix="m", timeperiod=3), "m") == [None, None]


def test_gap_counts_rows_not_days(spark):
    b = panel(spark, {1: [1, 2, None, 6]})
    assert values(indicator(b, "SMA", prefix="m", timeperiod=3), "m") == [None, None, 3.0]


def test_ema_starts_with_first_value(spark):
    v = values(indicator(panel(spark, {1: [10, 20, 30]}), "EMA", prefix="e", timeperiod=2), "e")
    assert v[0] is None and v[1] == pytest.approx(10 / 3 + 40 / 3) and v[2] == pytest.approx(v[1] / 3 + 20)


def test_both_period_names(spark):
    b = panel(spark, {1: range(1, 30)})
    d = indicators(b, [("RSI", "a", {"period": 7}), ("RSI", "b", {"timeperiod": 7})])
    assert d.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    with pytest.raises(TypeError):
        indicator(b, "RSI", length=3)
    with pytest.raises(KeyError):
        indicator(b, "NOPE")


def test_atr_first_bar_and_one_window_node(spark):
    b = panel(spark, {1: [10, 12, 11]}, high={1: [11, 13, 12]}, low={1: [9, 11, 10]})
    assert values(indicator(b, "ATR", prefix="a", timeperiod=2), "a") == [None, 2.5, 2.5]
    d = indicators(b, [("ATR", "a", {"timeperiod": 2}), ("ATR", "a", {"timeperiod": 2})])
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2  # previous close, then the mean


def test_bbands_and_stoch(spark):
    b = panel(spark, {1: [1, 2, 3, 4, 5]})
    x = indicator(b, "BBANDS", prefix="b", timeperiod=5).orderBy(F.desc("date")).first()
    assert x["b_middle"] == 3 and x["b_upper"] == pytest.approx(3 + 2 * math.sqrt(2))
    flat = indicator(panel(spark, {1: [2] * 12}), "STOCH", prefix="s")
    assert flat.where(F.col("s_k").isNotNull()).count() == 0


def test_regression_and_wma(spark):
    b = panel(spark, {1: [2, 4, 6, 8, 10]})
    d = indicators(b, [("LINEARREG_SLOPE", "s", {"timeperiod": 4}), ("TSF", "f", {"timeperiod": 4}), ("WMA", "w", {"timeperiod": 3})])
    x = d.orderBy(F.desc("date")).first()
    assert x["s"] == pytest.approx(2) and x["f"] == pytest.approx(12) and x["w"] == pytest.approx((6 + 16 + 30) / 6)


def test_registry_size():
    assert len(names()) >= 75 and sum(len(output_columns(n, {})) for n in names()) >= 95


def test_all_indicators_run(spark, tables):
    """No indicator may look ahead: cutting the future leaves the past as it was."""
    b = tables.bars("W").where(F.col("sym").isin(1, 2)).select("date", "sym", "open", "high", "low", "close", "volume").cache()
    specs = [(n, None, {}) for n in names()]
    cols = [c for n in names() for c in output_columns(n, {})]
    full = {(x["sym"], x["date"]): x for x in indicators(b, specs).where(F.col("date") <= "1998-06-30").collect()}
    cut = indicators(b.where(F.col("date") <= "1998-06-30"), specs).collect()
    assert len(cut) == len(full) > 200
    for x in cut:
        y = full[(x["sym"], x["date"])]
        for c in cols:
            assert (x[c] is None and y[c] is None) or x[c] == pytest.approx(y[c], rel=1e-9, abs=1e-9), c


def test_prefix_product_total_loss(spark):
    b = panel(spark, {1: [1, 1, 1, 1]}).withColumn("r", F.when(F.col("date") == "2020-01-17", -1.0).otherwise(0.1))
    v = values(prefix_product(b, "r", "nav"), "nav")
    assert v[1] == pytest.approx(1.21) and v[2:] == [0.0, 0.0]


def test_adjust_counts_back(spark):
    b = panel(spark, {1: [10, 10, 5, 5]})
    f = spark.sql("select 1L as sym, date'2020-01-17' as date, 0.5D as factor")
    assert values(adjust(b, f, ["close"]), "adj_close") == [5.0, 5.0, 5.0, 5.0]


def test_recursive_pass_takes_whole_symbols_of_many_batches(spark):
    """Symbols that lie across batches, that share one, and that are null; no group of its own for each."""
    import numpy as np
    import pandas as pd

    from loomline.functions.indicators import REGISTRY, indicators

    rng = np.random.default_rng(5)
    series = {s: list(rng.uniform(5, 9, n)) for s, n in ((1, 1), (2, 40), (3, 3), (4, 25), (5, 1))}
    p = panel(spark, series).withColumn("sym", F.when(F.col("sym") != 4, F.col("sym")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = indicators(p, [("RSI", "rsi", {}), ("MACD", "macd", {})])
        assert "InPandas" not in d._jdf.queryExecution().executedPlan().toString()
        got = {(r["sym"], r["date"]): (r["rsi"], r["macd_hist"]) for r in d.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(map(len, series.values()))
    for s, cs in series.items():
        g = pd.DataFrame({"close": cs})
        want = zip(REGISTRY["RSI"].fn(g, 14), REGISTRY["MACD"].fn(g, 12, 26, 9)[2])
        for i, w in enumerate(want):
            assert got[s if s != 4 else None, friday(i)] == tuple(None if np.isnan(x) else pytest.approx(x, abs=1e-12) for x in w)


def test_all_indicators_do_not_share_one_row(spark, tables):
    """Values per indicator as if all were columns of one row, by passes over narrow ones."""
    from loomline.functions.indicators import indicators, names, output_columns
    from loomline.plans.indicators_queries import x02b

    some = ["SMA", "AROON", "RSI", "BBANDS"]
    d = x02b(tables)
    assert "Union" in d._jdf.queryExecution().optimizedPlan().toString()
    got = {r["indicator"]: r["n_values"] for r in d.collect()}
    assert list(sorted(got)) == sorted(c for n in names() for c in output_columns(n, {}))
    b = indicators(tables.bars("W"), [(n, None, {}) for n in some])
    want = b.agg(*[F.count(c).alias(c) for n in some for c in output_columns(n, {})]).first().asDict()
    assert {k: got[k] for k in want} == want
