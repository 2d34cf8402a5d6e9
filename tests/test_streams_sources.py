import datetime as dt
import itertools

import pytest
from conftest import SF
from helpers import assert_equal
from pyspark.sql import functions as F

from loomline.operators import work as W
from loomline.session import new_path
from loomline.sources import store
from loomline.sources.catalog import Catalog
from loomline.streaming import monitor as S


@pytest.fixture(scope="module")
def split_events(spark):
    """The events in time order over three files: several micro-batches."""
    path = new_path(spark, "events")
    e = spark.read.parquet(f"{SF}/events.parquet")
    cut = e.approxQuantile("event_id", [0.33, 0.66], 0.0)
    for i, (lo, hi) in enumerate([(-1, cut[0]), (cut[0], cut[1]), (cut[1], 1e18)]):
        e.where((F.col("event_id") > lo) & (F.col("event_id") <= hi)).coalesce(1).write.parquet(f"{path}/tmp{i}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    for i in range(3):
        f = [x.getPath() for x in fs.listStatus(hadoop.Path(f"{path}/tmp{i}")) if x.getPath().getName().endswith(".parquet")][0]
        fs.mkdirs(hadoop.Path(f"{path}/in"))
        fs.rename(f, hadoop.Path(f"{path}/in/events{i}.parquet"))
    return f"{path}/in"


def test_loss_stop_over_batches(spark, split_events):
    one = S.drain(S.daily_loss_stop(S.feed(spark, SF)), "a").toPandas()
    many = S.drain(S.daily_loss_stop(S.feed(spark, split_events, 1)), "b").toPandas()
    assert len(one) > 100
    assert_equal(many, one)


def test_fold_over_batches(spark, split_events):
    def run(root, n):
        c = F.col("event_type")
        log = S.raw_feed(spark, root, n).select(
            F.col("user_id").alias("item"), "ts", "event_id", F.when(c == "click", "start").when(c == "purchase", "close").otherwise("reopen").alias("kind"))
        return S.latest(S.drain(W.fold_state(log), "fold", "update"), ["item"]).toPandas()

    assert_equal(run(split_events, 1), run(SF, None))


def test_latch_resets_next_day(spark):
    t = dt.datetime
    rows = [(1, t(2024, 1, 1, 9, 0), 1, "view", 100.0, ""), (2, t(2024, 1, 1, 9, 5), 1, "view", 97.0, ""), (3, t(2024, 1, 1, 9, 9), 1, "view", 120.0, ""),
            (4, t(2024, 1, 2, 9, 0), 1, "view", 50.0, ""), (5, t(2024, 1, 9, 9, 0), 2, "view", 1.0, "")]
    root = new_path(spark, "latch")
    spark.createDataFrame(rows, S.EVENT_SCHEMA).coalesce(1).write.parquet(root)
    feed = S.feed_columns(spark.readStream.schema(S.EVENT_SCHEMA).parquet(root))
    d = S.drain(S.daily_loss_stop(feed), "latch").where(F.col("sym") == 1).orderBy("minute").collect()
    assert [x["stopped"] for x in d] == [False, True, True, False]


def test_loss_stop_of_days_that_open_at_zero(spark):
    t = dt.datetime
    price = [(1, 0.0), (1, 5.0), (1, 0.0), (2, 0.0), (2, -1.0), (2, 3.0), (3, -4.0), (3, -3.0), (3, -5.0)]
    rows = [(i, t(2024, 1, s, 9, i), 1, "view", p, "") for i, (s, p) in enumerate(price)] + [(99, t(2024, 1, 9, 9, 0), 2, "view", 1.0, "")]
    root = new_path(spark, "zero")
    spark.createDataFrame(rows, S.EVENT_SCHEMA).coalesce(1).write.parquet(root)
    feed = S.feed_columns(spark.readStream.schema(S.EVENT_SCHEMA).parquet(root))
    d = S.drain(S.daily_loss_stop(feed), "zero").where(F.col("sym") == 1).orderBy("minute").collect()
    # in SQL 0 / 0 is no number, and any other price over zero is infinite
    assert [str(x["change"]) for x in d] == ["nan", "inf", "nan", "nan", "-inf", "inf", "0.0", "-0.25", "0.25"]
    assert [x["stopped"] for x in d] == [False, False, False, False, True, True, False, True, True]


def test_rerun_changes_nothing(spark):
    path = new_path(spark, "again")
    n = S.drain(S.feed(spark, SF), "again", path=path).count()
    assert S.drain(S.feed(spark, SF), "again", path=path).count() == n > 0


def test_interval_codes():
    assert S.trigger_of("1m") == {"processingTime": "1 minutes"} and S.trigger_of(None) == {"availableNow": True}


# ---- sources ---------------------------------------------------------------


def test_universe_scope(tables):
    c = Catalog(tables)
    with c.universe(market="ASIA"):
        scoped = c.get("price:close").select("sym").distinct().count()
        with c.universe(symbols=[1, 2]):
            d = c.get("price:close")
            assert "l_suppkey" in d._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:200]
            assert d.select("sym").distinct().count() == 2
    assert scoped == c.symbols(market="ASIA").count()
    assert c.symbols().count() == tables.n_symbols
    with pytest.raises(KeyError):
        c.get("price:nothing")


def test_alias_of_the_book_ratio(tables):
    assert Catalog(tables).split_key("price_earning_ratio:pb") == ("price_book_ratio", "pb")


def test_storage_hit_and_refresh(spark, tables):
    c = Catalog(tables)
    path = c.set_storage()
    n = c.get("price:close").count()
    spark.sql("select date'2020-01-03' as date, 1L as sym, 1D as open, 1D as high, 1D as low, 1D as close, 1D as volume, 1D as turnover, 1D as vwap, 2020 as year").write.mode(
        "overwrite").partitionBy("year").parquet(f"{path}/price")
    assert c.get("price:close").count() == 1  # a hit reads the store
    assert c.get("price:close", force_download=True).count() == n


def test_nightly_write_is_idempotent(spark, tables):
    path = new_path(spark, "nightly")
    nav = tables.bars("M").groupBy("date").agg(F.avg("close").alias("nav")).withColumn("strategy", F.lit("a"))
    for _ in range(2):
        store.write_nightly(nav, path)
    last = nav.where(F.col("date") == nav.agg(F.max("date")).scalar())
    store.write_nightly(last, path)
    assert store.read(spark, path).count() == nav.count()


def test_column_pruning_reaches_the_scan(spark, tables):
    spark.catalog.clearCache()
    d = Catalog(tables).get("price:high")
    plan = d._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "l_tax" not in schema and "l_orderkey" not in schema


def test_panel_algebra(tables):
    from loomline.api import Data

    data = Data(tables)
    close = data.get("price:close")
    x = ((close > close.average(5)) & (close * 2 > close.average(5))).df()
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1
    assert close[3].df().select("sym").distinct().count() == 1
    assert (-close).df().agg(F.max("value")).first()[0] < 0
    m = data.indicator("MACD")
    assert len(m) == 3 and data.indicator("rsi", period=5).df().count() == close.df().count()
    per_date = (close > 0).sum(axis=1).agg(F.sum("value")).first()[0]
    assert per_date == close.df().count()
    held = (close > close.average(5)).hold_until(close < close.average(5), nstocks_limit=2, rank=-close)
    assert held.sum(axis=1).agg(F.max("value")).first()[0] <= 2


_ID = itertools.count()


class _Value:
    v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    put = update

    def clear(self):
        self.v = None


class _Handle:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.timers = set()

    def getListState(self, name, schema):
        return _Value()

    getValueState = getListState

    def registerTimer(self, ms):
        self.timers.add(ms)


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _ticks(rows):
    import pandas as pd

    return pd.DataFrame([(int(pd.Timestamp(2024, 1, d, h, m, tz="UTC").timestamp()) * 1_000_000 + next(_ID), next(_ID), p) for d, h, m, p in rows],
                        columns=["us", "event_id", "price"])


def _run(monitor, chunks, watermark):
    import pandas as pd

    clock = _Clock(int(pd.Timestamp(2024, 1, *watermark, tz="UTC").timestamp() * 1000) if watermark else 0)
    out = list(monitor.handleInputRows((1,), iter(chunks), clock))
    while due := {t for t in monitor.handle.timers if t <= clock.ms}:
        monitor.handle.timers -= due
        out += list(monitor.handleExpiredTimer((1,), clock, None))
    return pd.concat(out, ignore_index=True) if out else None


def test_daily_loss_latches_until_the_next_day():
    p = S.DailyLossStop(0.02)
    p.init(_Handle())
    # Chunks of one minute are folded together, minutes may come in any order; nothing is judged before its time.
    assert _run(p, [_ticks([(2, 2, 0, 98.0), (2, 1, 0, 100.0)]), _ticks([(2, 1, 0, 99.0), (2, 3, 0, 101.0)])], None) is None
    out = _run(p, [_ticks([(2, 4, 0, 101.0)])], (2, 3, 1))
    assert out["stopped"].tolist() == [False, True, True] and not out["late"].any()
    out = _run(p, [_ticks([(2, 3, 0, 1.0), (3, 1, 0, 10.0)])], (2, 3, 1))
    assert out["late"].tolist() == [True] and out["price"].tolist() == [1.0]
    assert _run(p, [], (3, 1, 1))["stopped"].tolist() == [True, False]
    assert _run(p, [_ticks([(3, 2, 0, 9.7)])], (3, 1, 1)) is None
    out = _run(p, [], (3, 2, 1))
    assert out["stopped"].tolist() == [True] and out["change"].iloc[0] == pytest.approx(-0.03)
    assert p.waiting.v is None


def test_drawdown_and_exposure_of_folded_minutes():
    d, e = S.DrawdownMonitor(0.15), S.ExposureLimit(30.0)
    rows = [[_ticks([(1, 1, 0, 10.0), (1, 1, 0, 20.0)]), _ticks([(1, 1, 0, 5.0), (1, 2, 0, 18.0)])], [_ticks([(1, 1, 0, 99.0)])]]
    d.init(_Handle())
    e.init(_Handle())
    assert _run(d, rows[0], None) is None
    out, more = _run(d, [], (1, 3)), _run(d, rows[1], (1, 3))
    assert out["peak"].tolist() == [20.0, 20.0] and out["breach"].tolist() == [True, False] and more["late"].tolist() == [True]
    assert _run(e, rows[0], None) is None
    out = _run(e, [], (1, 3))
    assert out["exposure"].tolist() == [35.0, 18.0] and out["n"].tolist() == [3, 1] and out["over"].tolist() == [True, False]


def test_universe_of_many_names(spark, tables):
    from loomline.sources.catalog import Catalog

    c = Catalog(tables)
    c._builders["named"] = (lambda: tables.bars("W").withColumn("sym", F.concat(F.lit("s"), F.col("sym").cast("string"))), ("close",))
    with c.universe(symbols=[f"s{i}" for i in range(3, 400)]):
        assert {r["sym"] for r in c.get("named:close").select("sym").distinct().collect()} == {f"s{i}" for i in range(3, 10)}
    with c.universe(symbols=list(range(3, 400))):
        assert {r["sym"] for r in c.get("price:close").select("sym").distinct().collect()} == set(range(3, 10))


def test_slot_limited_panel_has_every_cell(spark, tables):
    from loomline.api import Data

    data = Data(tables)
    close = data.get("price:close")
    held = (close > close.average(5)).hold_until(close < close.average(5), nstocks_limit=2, rank=close)
    rows = held.df("v").collect()
    assert len(rows) == close.df("v").count() and len({(r["date"], r["sym"]) for r in rows}) == len(rows)
    assert 0 < sum(bool(r["v"]) for r in rows) < len(rows)


def test_header_lines(spark, tmp_path):
    from loomline.sources import workspace

    p = tmp_path / "epics" / "pay"
    p.mkdir(parents=True)
    (p / "001.md").write_text("---\nname: a: b\nstate:open\nname: last\nno colon\n : x\n---\nBody: text")
    r = workspace.scan(spark, str(tmp_path)).first()
    assert (r["kind"], r["epic"], r["id"], r["attrs"], r["body"]) == ("epics", "pay", "001", {"name": "last", "state": "open"}, "Body: text")


def test_symbols_of_one_key_do_not_mix(spark, monkeypatch):
    """Two symbols in one key, over several timers: each has its own minutes, peak and day."""
    import pandas as pd

    def ticks(rows):
        return pd.concat([_ticks([r[1:]]).assign(sym=r[0]) for r in rows], ignore_index=True)

    d, s = S.DrawdownMonitor(0.15), S.DailyLossStop(0.02)
    rows = [[(7, 2, 1, 0, 10.0), (8, 2, 1, 0, 40.0)], [(7, 2, 2, 0, 8.0), (8, 2, 2, 0, 39.9)], [(8, 2, 3, 0, 50.0)], [(7, 2, 4, 0, 9.0)]]
    for m in (d, s):
        m.init(_Handle())
    found = {m: pd.concat([_run(m, [ticks(r)], None if i == 0 else (2, i, 1)) for i, r in enumerate(rows) if i] + [_run(m, [], (2, 4, 1))]) for m in (d, s)
             if _run(m, [ticks(rows[0])], None) is None}
    peaks = found[d].sort_values(["sym", "minute"])
    assert peaks["sym"].tolist() == [7, 7, 7, 8, 8, 8] and peaks["peak"].tolist() == [10.0, 10.0, 10.0, 40.0, 40.0, 50.0]
    assert peaks["breach"].tolist() == [False, True, False, False, False, False]
    assert found[s].sort_values(["sym", "minute"])["stopped"].tolist() == [False, True, True, False, False, False]


def test_monitor_state_is_keyed_by_groups_of_symbols(spark, tmp_path):
    d = S.drawdown_monitor(S.feed(spark, SF))
    assert "key" in d._jdf.queryExecution().analyzed().toString().split("TransformWithState")[1].splitlines()[0]
