import datetime as dt

import pytest
from helpers import friday
from pyspark.sql import functions as F

from loomline.operators import backtest as B
from loomline.operators import indicator_tables as it

BARS = "date date, sym bigint, open double, high double, low double, close double, volume double, turnover double"


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(friday(i), s, 10.0 + i, 12.0 + i + s, 9.0 + i, 11.0 + i * s, 100.0, 1000.0 * (s + 1)) for i in range(30) for s in range(4)]
    return spark.createDataFrame(rows, BARS).cache()


@pytest.fixture(scope="module")
def universe(spark):
    return spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "sym bigint, category string")  # 3 has no category


def of(df):
    return {(x["category"], x["sym"]): x for x in df.collect()}


def test_treemap_counts_the_range_only(bars, universe):
    m = of(B.treemap(bars, universe, str(friday(10)), str(friday(20))))
    assert m[("A", 1)]["area"] == 11 * 2000.0 and m[("A", 1)]["item"] == pytest.approx(31 / 21 - 1)
    assert m[("A", None)]["area"] == 11 * 3000.0 and m[(None, None)]["n"] == 3
    share = of(B.treemap(bars, universe, str(friday(10)), str(friday(20)), item="turnover_ratio"))
    assert share[("B", 2)]["item"] == pytest.approx(0.3)  # of all turnover, symbols without a category included


def test_treemap_of_a_column_clips_symbols_and_keeps_nulls(bars, universe):
    pe = F.when(F.col("sym") == 0, F.lit(None)).when((F.col("sym") == 1) & (F.col("date") <= friday(12).isoformat()), 700.0).when(F.col("sym") == 2, -5.0)
    m = of(B.treemap(bars.withColumn("pe", pe), universe, str(friday(10)), str(friday(20)), area="close", item="pe", clip=(0, 50)))
    assert m[("A", 0)]["item"] is None and m[("A", 1)]["item"] == 50 and m[("B", 2)]["item"] == 0
    assert m[("A", None)]["item"] == 50 and m[("A", 1)]["area"] == 31
    assert B.treemap(bars, universe, "2050-01-01").count() == 0


def test_candles_of_a_symbol(spark, bars):
    split = spark.createDataFrame([(friday(10), 2, 0.5)], "date date, sym bigint, factor double")
    c = it.candles(bars, [("SMA", "ma", {"timeperiod": 2})], [], symbol=2, recent_days=60, factors=split, resample="M").orderBy("date").collect()
    f = {friday(i): (0.5 if i < 10 else 1.0) for i in range(30)}
    months = {}
    for i in range(30):
        d = friday(i)
        months.setdefault((d.year, d.month), []).append(i)
    want = []
    for m, idx in months.items():
        want.append((idx, f[friday(idx[0])] * (10.0 + idx[0]), max(f[friday(i)] * (14.0 + i) for i in idx), f[friday(idx[-1])] * (11.0 + 2 * idx[-1])))
    last = c[-1]["date"]
    assert all(x["sym"] == 2 and (last - x["date"]).days < 60 for x in c) and len(c) == 2
    for x, w, before in zip(c, want[-2:], want[-3:-1]):
        assert (x["open"], x["high"], x["close"]) == pytest.approx(w[1:])
        assert x["ma"] == pytest.approx((w[3] + before[3]) / 2)  # history before the cut counts
        assert x["volume"] == 100.0 * len(w[0])


def test_river_of_a_symbol(spark, bars):
    s = spark.createDataFrame([(2, dt.date(1990, 1, 1), 10.0, 5.0, 100.0), (1, dt.date(1990, 1, 1), 1.0, 1.0, 1.0)], "sym bigint, available date, net double, shares double, equity double")
    v = it.river_of(bars, s, symbol=2, start=str(friday(5)), end=str(friday(9)), mode="pe", split_range=4)
    rows = v.collect()
    assert len(rows) == 5 * 5 and {x["sym"] for x in rows} == {2}
    low, high = (11.0 + 10) / 2, (11.0 + 18) / 2  # two earned a share
    for x in rows:
        assert x["multiple"] == pytest.approx(low + (high - low) * x["band"] / 4) and x["price"] == pytest.approx(2 * x["multiple"])
    pb = it.river_of(bars, s, symbol=2, mode="pb", split_range=1).where("band = 0").first()
    assert pb["price"] == pytest.approx(11.0)  # the lowest close, at 20 of book a share
    with pytest.raises(KeyError):
        it.river_of(bars, s, mode="ps")
