import datetime as dt
import random

import pytest
from helpers import friday, panel, values
from pyspark.sql import functions as F

from loomline.operators import backtest as B
from loomline.operators import panel as P


def test_bars_open_close_ties(spark):
    t = spark.createDataFrame([(1, dt.date(2020, 1, 2), 5.0, 1.0, 5.0, 9), (1, dt.date(2020, 1, 2), 4.0, 1.0, 4.0, 3), (1, dt.date(2020, 1, 6), 7.0, 2.0, 14.0, 1)],
                              "sym bigint, date date, price double, qty double, amount double, seq bigint")
    m = P.bars_from_ticks(t, "M").collect()[0]
    assert (m["open"], m["high"], m["low"], m["close"], m["volume"]) == (4.0, 7.0, 4.0, 7.0, 4.0)
    plan = P.bars_from_ticks(t, "D")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    plan = P.bars_from_ticks(t, "W")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_min_by" in plan


def test_bars_order_by_all_columns(spark):
    """Rows that agree in order and line still have one order, by part."""
    rows = [(1, dt.date(2020, 1, 2), float(p), 1.0, float(p), (7, 1, part)) for part, p in ((5001, 3), (904, 1), (4096 + 904, 2))]
    t = spark.createDataFrame(rows, "sym bigint, date date, price double, qty double, amount double, seq struct<a:bigint,b:int,c:bigint>")
    m = P.bars_from_ticks(t.where("price > 1"), "W").first()
    assert (m["open"], m["close"]) == (2.0, 3.0)
    m = P.bars_from_ticks(t, "D").first()
    assert (m["open"], m["close"]) == (1.0, 3.0)


def test_bars_of_trade_rows_are_hash_aggregates(spark, tables):
    for freq in ("D", "W", "M"):
        plan = tables.bars(freq)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2 and plan.count("Exchange") == 1


def test_trade_rows_are_ordered_by_one_long_where_it_fits(spark, tables, tmp_path):
    """Small keys are packed; large and negative ones keep the decimal. Bars are the same."""
    from loomline.sources.tables import Tables

    assert dict(tables.ticks().dtypes)["seq"] == "bigint"
    keys = [(1, 1, 2), (0, 9, 9), (1, 1, 1), (1, 0, 5), (2, 0, 0), (None, 3, 1), (2, None, 4)]
    for name, add in (("small", 0), ("large", 2**60), ("negative", -5)):
        rows = [(None if o is None else o + add, line, p, 7, dt.datetime(2020, 1, 2 + i % 2), float(i + 1), 1.0) for i, (o, line, p) in enumerate(keys)]
        spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate timestamp, l_extendedprice double, l_quantity double").write.parquet(
            f"{tmp_path}/{name}/lineitem.parquet")
        t = Tables(spark, f"{tmp_path}/{name}")
        assert dict(t.ticks().dtypes)["seq"] == ("bigint" if name == "small" else "decimal(36,0)")
        want = sorted((r[4], r[0] or 0, r[1] or 0, r[2], r[5]) for r in rows)
        m = t.bars("W").first()
        assert (m["open"], m["close"]) == (want[0][4], want[-1][4])


def test_trade_order_is_that_of_its_columns(spark):
    from loomline.sources.tables import trade_order

    big, small = [-(2**63), -5, 0, 1, 7, 2**63 - 1], [-(2**31), -1, 0, 3, 2**31 - 1]
    rows = [(o, line, p) for o in big for line in small for p in (0, 1, 10**7 - 2)]
    keys = spark.createDataFrame(rows, "o bigint, l int, p bigint").select("o", "l", "p", trade_order("o", "l", "p").alias("k"))
    got = sorted(keys.collect(), key=lambda r: r["k"])
    assert [(r["o"], r["l"], r["p"]) for r in got] == sorted(rows) and len({r["k"] for r in got}) == len(rows)
    t = keys.select(F.lit(1).alias("sym"), F.lit("2024-01-05").cast("date").alias("date"), F.col("p").cast("double").alias("price"), F.lit(1.0).alias("qty"), F.lit(1.0).alias("amount"), F.col("k").alias("seq"))
    m = P.bars_from_ticks(t, "M").first()
    assert (m["open"], m["close"]) == (0.0, float(10**7 - 2))


def test_top_uses_group_limit_and_ties_by_sym(spark):
    b = panel(spark, {3: [1], 1: [1], 2: [1]})
    k = P.top(b, "close", 2)
    assert values(k, "sym", "sym") == [1, 2]
    assert "WindowGroupLimit" in k._jdf.queryExecution().executedPlan().toString()


def test_week_key(spark):
    from loomline.functions.calendar import period_key

    d = spark.sql("select date'2020-01-03' as d union all select date'2020-01-04'")
    assert values(d.select("d", period_key("d", "W").alias("w")), "w", "d") == [dt.date(2020, 1, 3), dt.date(2020, 1, 10)]
    with pytest.raises(ValueError):
        period_key("d", "X")


def test_reporting_lag_boundary(spark):
    q = dt.date(2020, 3, 31)
    days = [(q + dt.timedelta(days=k), 1) for k in (44, 45, 46)]
    left = spark.createDataFrame(days, "date date, sym bigint")
    f = spark.createDataFrame([(1, q + dt.timedelta(days=45), 7.0)], "sym bigint, available date, net double")
    assert values(P.as_of(left, f, ["net"], "available"), "net") == [None, 7.0, 7.0]


def test_hold_until_exit_wins(spark):
    b = panel(spark, {1: [1, 1, 1, 1]})
    b = b.withColumn("entry", F.col("date").isin(friday(0), friday(2))).withColumn("exit", F.col("date").isin(friday(1), friday(2)))
    assert values(P.hold_until(b), "held") == [True, False, False, False]


def brute_slots(rows, n):
    held, spells = {}, []
    for day in sorted({r[0] for r in rows}):
        today = [r for r in rows if r[0] == day]
        for _, s, _, x, _ in sorted(today, key=lambda r: r[1]):
            if x and s in held:
                spells.append((s, held.pop(s), day))
        for _, s, e, x, v in sorted(today, key=lambda r: (-r[4], r[1])):
            if e and not x and s not in held and len(held) < n:
                held[s] = day
    return sorted(spells + [(s, d, None) for s, d in held.items()], key=str)


@pytest.mark.parametrize("seed", range(4))
def test_slots_match_plain_fold(spark, seed):
    rnd = random.Random(seed)
    rows = [(friday(i), s, rnd.random() < 0.4, rnd.random() < 0.3, float(rnd.randint(0, 5))) for i in range(25) for s in range(12)]
    d = spark.createDataFrame([("k", *r) for r in rows], "strategy string, date date, sym bigint, entry boolean, exit boolean, rank_value double")
    got = [(x["sym"], x["entry_date"], x["exit_date"]) for x in P.hold_until_slots(d, 3, exit_="exit").collect()]
    assert sorted(got, key=str) == brute_slots(rows, 3)


def signals(spark, b, syms):
    return b.select("date", "sym", F.col("sym").isin(*syms).alias("signal"))


def test_nav_without_cost_is_the_price_path(spark):
    b = panel(spark, {1: [10, 11, 12, 9, 18, 20], 2: [5] * 6})
    r = B.sim(signals(spark, b, [1]), b, resample="W", trade_at_price="close", fee_ratio=0, tax_ratio=0, initial_capital=1.0)
    assert values(r.nav, "nav") == pytest.approx([1, 12 / 11, 9 / 11, 18 / 11, 20 / 11])
    s = r.report().first()
    assert s["total_return"] == pytest.approx(20 / 11 - 1) and s["max_drawdown"] == pytest.approx(9 / 12 - 1)


def test_first_rebalance_pays_on_its_own_date(spark):
    b = panel(spark, {1: [10] * 5})
    r = B.sim(signals(spark, b, [1]), b, resample="W", trade_at_price="close", fee_ratio=0.01, tax_ratio=0.02, initial_capital=1.0)
    n = r.nav.orderBy("date").collect()
    assert n[0]["cost"] == pytest.approx(0.01) and all(x["cost"] == 0 for x in n[1:])


def test_no_look_ahead(spark):
    closes = {1: [10, 11, 12, 9, 18, 20, 21, 5], 2: [7, 6, 8, 9, 7, 9, 3, 30]}
    def run(k):
        b = panel(spark, {s: c[:k] for s, c in closes.items()})
        mom = b.withColumn("signal", F.coalesce(F.col("close") > F.lag("close").over(P.by_sym()), F.lit(False)))
        return {x["date"]: x["nav"] for x in B.sim(mom.select("date", "sym", "signal"), b, resample="W").nav.collect()}
    short, long = run(6), run(8)
    assert all(long[d] == pytest.approx(v) for d, v in short.items())


def test_sweep_row_equals_single_run(spark, tables):
    b = tables.bars("W").cache()
    from loomline.plans.strategy_queries import sweep_signals

    s = sweep_signals(tables)
    many = {x["strategy"]: x for x in B.sim(s, b, position_limit=3).report().collect()}
    one = B.sim(s.where(F.col("strategy") == "MA20"), b, position_limit=3).report().first()
    assert many["MA20"]["n"] == one["n"] and many["MA20"]["sharpe"] == pytest.approx(one["sharpe"])


def test_trades_and_excursions(spark):
    b = panel(spark, {1: [10, 10, 8, 12, 12]}, high={1: [10, 10, 9, 13, 12]}, low={1: [10, 10, 7, 11, 12]})
    t = B.sim(signals(spark, b, [1]), b, resample="W", trade_at_price="close").get_trades().collect()
    assert len(t) == 1
    assert t[0]["entry_date"] == friday(1) and t[0]["exit_date"] is None and t[0]["days"] == 21
    assert t[0]["ret"] == pytest.approx(0.2) and t[0]["mdd"] == pytest.approx(-0.2)
    assert t[0]["mae"] == pytest.approx(-0.3) and t[0]["mfe"] == pytest.approx(0.3)


def test_stop_loss_is_inclusive(spark):
    d = spark.createDataFrame([("a", 1, 0, friday(i), px, 10.0) for i, px in enumerate([10.0, 9.0, 12.0])],
                              "strategy string, sym bigint, spell int, date date, px double, entry_px double")
    assert B.stop_loss(d, 0.10).count() == 2 and B.stop_loss(d, 0.11).count() == 3


def test_hard_stop_waits_for_rebalance(spark):
    nav = spark.createDataFrame([("a", friday(i), r) for i, r in enumerate([0.0, -0.10, 0.5, 0.5])], "strategy string, date date, ret double")
    reb = spark.createDataFrame([(friday(3),)], "date date")
    d = B.portfolio_hard_stop(nav, reb)
    assert values(d, "stopped") == [False, False, True, False] and values(d, "nav") == pytest.approx([1, 0.9, 0.9, 0.9])


def test_net_reward_uses_same_day_cost(spark):
    d = panel(spark, {1: [1, 1, 1]}).withColumn("position", F.lit(1.0)).withColumn("ret", F.lit(0.1)).withColumn(
        "cost", F.when(F.col("date") == friday(1), 0.05).otherwise(0.0))
    assert values(B.net_rewards(d), "reward") == pytest.approx([0.0, 0.05, 0.1])


def test_flat_sharpe_is_null(spark):
    s = spark.createDataFrame([("a", friday(i), 0.0) for i in range(4)], "strategy string, date date, ret double")
    assert B.statistics(B.nav_of(s), 52).first()["sharpe"] is None


def test_caps_leave_cash(spark):
    w = spark.createDataFrame([(friday(0), s, "x", 0.25) for s in range(4)], "date date, sym bigint, category string, weight double")
    c = B.cap_weights(w, 0.10, 0.30).agg(F.sum("capped")).first()[0]
    assert c == pytest.approx(0.30)


def test_order_triggers(spark):
    bars = panel(spark, {1: [10, 9, 8, 12, 7]}, high={1: [11, 10, 9, 13, 8]}, low={1: [9, 8, 7, 11, 6]})
    rows = [(1, 1, friday(0), "Buy", "Market", None), (2, 1, friday(0), "Buy", "Limit", 7.5), (3, 1, friday(0), "Sell", "Limit", 12.5),
            (4, 1, friday(0), "Sell", "StopLoss", 6.0), (5, 1, friday(0), "Buy", "Limit", 1.0), (6, 9, friday(0), "Buy", "Market", None)]
    o = spark.createDataFrame(rows, "order_id bigint, sym bigint, date date, side string, type string, limit_price double")
    got = {x["order_id"]: x["trigger_date"] for x in B.trigger_dates(o, bars).collect()}
    assert got == {1: friday(1), 2: friday(2), 3: friday(3), 4: friday(4), 5: None, 6: None}


@pytest.mark.parametrize("fan, freq", [(2, "W"), (3, "D"), (32, "W"), (4, "M")])
def test_order_triggers_against_all_bars(spark, monkeypatch, fan, freq):
    """Gaps in the bars, orders before, between and after them, a symbol with most orders."""
    monkeypatch.setattr(B, "FAN", fan)
    r = random.Random(fan)
    step = {"W": 7, "D": 1, "M": 31}[freq]
    days = [dt.date(2020, 1, 3) + dt.timedelta(days=step * i) for i in range(60)]
    if freq == "M":
        days = sorted({(d.replace(day=1) + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1) for d in days})
    bars = [(d, s, float(low), low + r.choice([0.0, 1.0, 5.0])) for s in (1, 2, 3) for d in days if r.random() < 0.7 for low in [r.randrange(20)]]
    orders = [(i, r.choice([1, 1, 1, 1, 2, 3, 4]), days[0] + dt.timedelta(days=r.randrange(-40, 60 * step + 40)), r.choice(["Buy", "Sell"]),
               r.choice(["Market", "Limit", "StopLoss"]), float(r.randrange(-3, 27))) for i in range(400)]

    def fits(o, b):
        _, s, d, side, kind, price = o
        below = (kind == "Limit") == (side == "Buy")
        return b[1] == s and b[0] > d and (kind == "Market" or (b[2] <= price if below else b[3] >= price))

    o = spark.createDataFrame(orders, "order_id bigint, sym bigint, date date, side string, type string, limit_price double")
    b = spark.createDataFrame(bars, "date date, sym bigint, low double, high double")
    got = {x["order_id"]: x["trigger_date"] for x in B.trigger_dates(o, b, freq).collect()}
    assert got == {o[0]: min((x[0] for x in bars if fits(o, x)), default=None) for o in orders}
    assert {x["trigger_date"] for x in B.trigger_dates(o, b.limit(0), freq).collect()} == {None}


def test_holdings_average_cost(spark):
    f = spark.createDataFrame([(1, friday(0), "Buy", 10.0, 2.0), (1, friday(1), "Buy", 10.0, 4.0), (1, friday(2), "Sell", 5.0, 5.0)],
                              "sym bigint, date date, side string, qty double, price double")
    x = B.latest_holdings(f).first()
    assert (x["quantity"], x["avg_cost"], x["realised_total"]) == (15.0, 3.0, 10.0)


def test_rebalance_threshold(spark):
    cur = spark.createDataFrame([(friday(0), 1, 0.5), (friday(0), 2, 0.5)], "date date, sym bigint, weight double")
    tgt = spark.createDataFrame([(friday(0), 1, 0.52), (friday(0), 3, 0.48)], "date date, sym bigint, weight double")
    got = {x["sym"]: (round(x["delta"], 6), x["side"]) for x in P.rebalance_orders(cur, tgt).collect()}
    assert got == {2: (-0.5, "Sell"), 3: (0.48, "Buy")}
