"""Live monitors on Structured Streaming.

Monitors fold chunks of ticks into minutes and judge a minute once its timer
has fired; ticks that come later are given out as such. Results go to parquet under the shared folder; every sink can repeat a batch
without changing its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loomline.operators.work import event_order
from loomline.session import new_path
from loomline.sources.tables import feed_columns

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "1 hour"


def feed(spark: SparkSession, root: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events files as a stream of ticks with a zoned time column."""
    return feed_columns(raw_feed(spark, root, files_per_trigger))


def raw_feed(spark: SparkSession, root: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(files_per_trigger))
    return r.parquet(root)


@contextmanager
def _state_settings(spark: SparkSession):
    """RocksDB state; in local mode as many state partitions as cores. A
    stream keeps the partition count it was first started with."""
    keep = {}
    want = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if spark.sparkContext.master.startswith("local"):
        want["spark.sql.shuffle.partitions"] = str(spark.sparkContext.defaultParallelism)
    for k, v in want.items():
        keep[k] = spark.conf.get(k, None)
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trigger_of(interval: str | None) -> dict:
    """``1m`` style codes; none means: process what has arrived, then end."""
    if interval is None:
        return {"availableNow": True}
    unit = {"s": "seconds", "m": "minutes", "h": "hours"}[interval[-1]]
    return {"processingTime": f"{int(interval[:-1])} {unit}"}


def start(df: DataFrame, path: str, mode: str = "append", interval: str | None = None,
          each: Callable[[DataFrame, int], None] | None = None):
    """Start a query that writes to ``path`` or calls ``each`` per micro-batch."""
    spark = df.sparkSession
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_stream").trigger(**trigger_of(interval))
    with _state_settings(spark):
        if each is not None:
            return w.foreachBatch(each).start()
        if mode == "append":
            return w.format("parquet").option("path", f"{path}/rows").start()
        return w.foreachBatch(batch_writer(f"{path}/rows")).start()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch owns one folder; a repeated batch replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drain(df: DataFrame, label: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process what has arrived, then end, and read the result."""
    path = path or new_path(df.sparkSession, label)
    q = start(df, path, mode)
    q.awaitTermination()
    return df.sparkSession.read.schema(_with_batch(df, mode)).parquet(f"{path}/rows")


def closing_rows(spark: SparkSession, root: str, path: str) -> DataFrame:
    """A stream with one row, later than all events by more than the lateness: once the watermark has passed it, timers of
    the last minutes fire in the same run."""
    none = spark.createDataFrame([], EVENT_SCHEMA)
    final = spark.read.parquet(f"{root.rstrip('/')}/events.parquet").agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    blank = {c: F.lit(None).cast(t).alias(c) for c, t in none.dtypes if c != "ts"}
    final.where("ts IS NOT NULL").select(*(blank.get(c, F.col("ts")) for c in none.columns)).write.parquet(path)
    return spark.readStream.schema(EVENT_SCHEMA).parquet(path)


def drain_closed(build: Callable[[DataFrame], DataFrame], spark: SparkSession, root: str, label: str) -> DataFrame:
    """``drain`` for a feed that has ended and is read in one batch: a closing row is read with it, so the last minutes
    are emitted too. Late rows, if ``build`` gives any, go to a side table and are not returned."""
    path = new_path(spark, label)
    rows = build(feed_columns(raw_feed(spark, root).unionByName(closing_rows(spark, root, f"{path}/_end"))))
    start(rows, path, each=two_tables(path)).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows").drop("late")


def two_tables(path: str) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: results to ``rows``, late rows to ``late``, each in a folder of the batch id, so that a repeated
    batch replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if "late" not in batch.columns:
            batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
            return
        batch.persist()
        batch.where("NOT late").write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        batch.where("late").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        batch.unpersist()

    return write


def split_late(ticks: DataFrame, lateness: str = LATENESS, arrival: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """Ticks in time and late ones, by their number of arrival: late is what is
    older than the newest tick of earlier arrivals by more than the lateness.
    A sink that writes both keeps the late rows in a side table."""
    newest = ticks.groupBy(arrival).agg(F.max("ts").alias("_newest"))
    before = Window.orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)  # one row an arrival
    seen = newest.select(arrival, F.max("_newest").over(before).alias("_seen"))
    d = ticks.join(seen, arrival)
    late = F.coalesce(F.col("ts") < F.col("_seen") - F.expr(f"INTERVAL {lateness}"), F.lit(False))
    return d.where(~late).drop("_seen"), d.where(late).drop("_seen")


def _with_batch(df: DataFrame, mode: str) -> str:
    cols = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return cols if mode == "append" else cols + ", batch bigint"


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Final value per key of an update-mode result: the highest batch wins."""
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"]).drop("batch")


# ---- minute table and window monitors --------------------------------------


def minutes(ticks: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(sym, minute, open, high, low, close, n): works on streams and tables."""
    d = ticks.withColumn("_o", event_order("ts", "event_id"))
    if ticks.isStreaming:
        d = d.withWatermark("ts", lateness)
    g = d.groupBy("sym", F.window("ts", "1 minute").alias("w")).agg(
        F.min_by("price", "_o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "_o").alias("close"), F.count("*").alias("n"))
    return g.select("sym", F.col("w.start").alias("minute"), "w", "open", "high", "low", "close", "n")


def alerts(ticks: DataFrame, limit: float, lateness: str = LATENESS) -> DataFrame:
    """One alert per symbol and hour."""
    b = ticks.where(F.col("price") > limit).withWatermark("ts", lateness)
    return b.withColumn("hour", F.date_trunc("hour", "ts")).dropDuplicatesWithinWatermark(["sym", "hour"]).select("sym", "hour")


def marked(ticks: DataFrame, holdings: DataFrame) -> DataFrame:
    """Ticks against static holdings."""
    return ticks.join(holdings.select("sym", "quantity", "avg_cost"), "sym").select(
        "event_id", "sym", "price", (F.col("quantity") * F.col("price")).alias("market_value"),
        (F.col("quantity") * (F.col("price") - F.col("avg_cost"))).alias("pnl"))


def order_status(updates: DataFrame) -> DataFrame:
    """Latest status and filled quantity per order."""
    return updates.groupBy("order_id").agg(
        F.max_by("status", "seq").alias("status"), F.sum("filled").alias("filled_quantity"), F.count("*").alias("n_updates"))


# ---- minute monitors with late rows ------------------------------------------------

_MINUTE = "sym bigint, minute bigint, first_us bigint, first_id bigint, open double, last_us bigint, last_id bigint, close double, high double, total double, n bigint"
_COLUMNS = [c.split()[0] for c in _MINUTE.split(", ")]
_PER_MINUTE = 60_000_000
#: Keys of a monitor's state, with the symbols dealt by hash: calls for state and timers cost more than rows do.
KEYS = 1024


class MinuteMonitor(StatefulProcessor):
    """Ticks of the symbols of a key become minutes, and a minute is judged once.

    Minutes that the watermark has not passed wait as one row each; chunks of
    ticks are folded into them as they come. A timer at the end of the earliest
    one fires when the watermark passes it; then all that have ended are judged
    in their order. A tick of an ended minute is late: it is emitted as it is,
    marked, and changes nothing. Rows without ``sym`` are of the symbol that is
    the key.
    """

    OUT = ""  # columns of a judged minute, beside sym and minute
    KEPT: str | None = None  # what is kept of a symbol, beside sym

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _MINUTE)
        self.kept = handle.getListState("kept", f"sym bigint, {self.KEPT}") if self.KEPT else None

    @staticmethod
    def _read(state, columns: list[str]) -> pd.DataFrame:
        return pd.DataFrame([tuple(x) for x in state.get()] if state.exists() else [], columns=columns)

    @staticmethod
    def _write(state, rows: pd.DataFrame) -> None:
        state.put(list(rows.itertuples(index=False, name=None)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended = timerValues.getCurrentWatermarkInMs() * 1000
        found = [self._read(self.waiting, _COLUMNS)]
        earliest = found[0]["minute"].min() if len(found[0]) else None
        for g in rows:
            g = g[g["price"].notna()]
            g = g.assign(event_id=g["event_id"].fillna(-1).astype("int64"), us=g["us"].astype("int64"))
            if "sym" not in g:
                g = g.assign(sym=key[0])
            m = g["us"] // _PER_MINUTE
            late = (m + 1) * _PER_MINUTE <= ended
            if late.any():
                x = g[late]
                yield self._frame(x["sym"], m[late], {**self.late_values(x), "late": True})
            g, m = g[~late], m[~late]
            found.append(self._folded(pd.DataFrame(dict(zip(_COLUMNS, (
                g["sym"], m, g["us"], g["event_id"], g["price"], g["us"], g["event_id"], g["price"], g["price"], g["price"], 1), strict=True)))))
        found = [x for x in found if len(x)]
        if found:
            minutes = self._folded(pd.concat(found, ignore_index=True))
            self._write(self.waiting, minutes)
            if earliest is None or minutes["minute"].min() < earliest:
                self._wake(minutes["minute"].min())

    @staticmethod
    def _folded(x: pd.DataFrame) -> pd.DataFrame:
        """One row a symbol and minute, by both."""
        by = ["sym", "minute"]
        first = x.sort_values(["first_us", "first_id", "open"]).groupby(by)[["first_us", "first_id", "open"]].first()
        last = x.sort_values(["last_us", "last_id", "close"]).groupby(by)[["last_us", "last_id", "close"]].last()
        return pd.concat([first, last, x.groupby(by).agg({"high": "max", "total": "sum", "n": "sum"})], axis=1).reset_index()

    def _wake(self, minute: int) -> None:
        self.handle.registerTimer((int(minute) + 1) * 60_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = timerValues.getCurrentWatermarkInMs() * 1000
        rows = self._read(self.waiting, _COLUMNS)
        over = (rows["minute"] + 1) * _PER_MINUTE <= ended
        done, rest = rows[over].reset_index(drop=True), rows[~over]
        if done.empty:
            return
        if len(rest):
            self._write(self.waiting, rest)
            self._wake(rest["minute"].min())
        else:
            self.waiting.clear()
        kept = self._read(self.kept, ["sym", *(c.split()[0] for c in self.KEPT.split(", "))]).set_index("sym") if self.KEPT else None
        values = self.judge(done, kept.reindex(done["sym"]).reset_index(drop=True) if self.KEPT else None)
        if self.KEPT:
            new = pd.DataFrame({c: values.get(c, done.get(c)) for c in kept.columns} | {"sym": done["sym"]}).groupby("sym").last()
            old = kept[~kept.index.isin(new.index)].astype(new.dtypes.to_dict())
            self._write(self.kept, (pd.concat([old, new]) if len(old) else new).reset_index())
        outs = [c.split()[0] for c in self.OUT.split(", ")]
        yield self._frame(done["sym"], done["minute"], {**{c: values[c] for c in outs}, "late": False})

    def _frame(self, sym, minute, values: dict) -> pd.DataFrame:
        return pd.DataFrame({"sym": sym.to_numpy(), "minute": pd.to_datetime(minute.to_numpy() * 60, unit="s", utc=True), **{
            k: v.to_numpy() if isinstance(v, pd.Series) else v for k, v in values.items()}})

    def judge(self, g: pd.DataFrame, kept: pd.DataFrame | None) -> dict:
        """The columns of OUT and KEPT for minutes by symbol and time; ``kept`` has what is kept of each row's symbol."""
        raise NotImplementedError

    def late_values(self, x: pd.DataFrame) -> dict:
        raise NotImplementedError

    def close(self) -> None:
        pass


class DailyLossStop(MinuteMonitor):
    """Loss from the day's open of at least ``limit`` stops the symbol until the next day."""

    OUT, KEPT = "price double, change double, stopped boolean", "day int, base double, stopped boolean"

    def __init__(self, limit: float = 0.02):
        self.limit = limit

    def judge(self, g: pd.DataFrame, kept: pd.DataFrame | None) -> dict:
        days = g["minute"] // 1440
        by, same = [g["sym"], days], days == kept["day"]
        base = g["open"].groupby(by).transform("first").where(~same, kept["base"].astype(float))
        change = g["close"] / base - 1  # infinite or no number on a day that opened at zero, as in SQL
        hit = (change <= -self.limit).astype(int).groupby(by).cummax().astype(bool) | (same & (kept["stopped"] == True))  # noqa: E712
        return {"price": g["close"], "change": change, "stopped": hit, "day": days, "base": base}

    def late_values(self, x: pd.DataFrame) -> dict:
        return {"price": x["price"], "change": float("nan"), "stopped": False}


class DrawdownMonitor(MinuteMonitor):
    """Fall from the running peak; minutes at or beyond the limit are breaches."""

    OUT, KEPT = "peak double, drawdown double, breach boolean", "peak double"

    def __init__(self, limit: float = 0.15):
        self.limit = limit

    def judge(self, g: pd.DataFrame, kept: pd.DataFrame | None) -> dict:
        run = g["high"].groupby(g["sym"]).cummax().clip(lower=kept["peak"].astype(float).fillna(float("-inf")))
        dd = g["close"] / run - 1
        return {"peak": run, "drawdown": dd, "breach": dd <= -self.limit}

    def late_values(self, x: pd.DataFrame) -> dict:
        return {"peak": x["price"], "drawdown": float("nan"), "breach": False}


class ExposureLimit(MinuteMonitor):
    """A minute's total and number of ticks, and whether the total is over the limit."""

    OUT = "exposure double, n bigint, over boolean"

    def __init__(self, limit: float):
        self.limit = limit

    def judge(self, g: pd.DataFrame, kept: pd.DataFrame | None) -> dict:
        return {"exposure": g["total"], "n": g["n"], "over": g["total"] > self.limit}

    def late_values(self, x: pd.DataFrame) -> dict:
        return {"exposure": x["price"], "n": 1, "over": False}


def monitored(ticks: DataFrame, monitor: MinuteMonitor, lateness: str = LATENESS) -> DataFrame:
    """``(sym, minute, ..., late)`` of a stream of ticks. Rows without a symbol or a price are no ticks."""
    # The processor itself sees late rows: the column it reads is not the one that carries the watermark, by which Spark drops them.
    # Rows without a symbol get a key, as the grouping mixes keys with null ones, but no price.
    known = F.col("sym").isNotNull()
    d = ticks.withWatermark("ts", lateness).select(
        F.pmod(F.xxhash64("sym"), F.lit(KEYS)).alias("key"), F.coalesce("sym", F.lit(-1)).alias("sym"), F.unix_micros("ts").alias("us"), "event_id",
        F.when(known, F.col("price")).alias("price"))
    return d.groupBy("key").transformWithStateInPandas(
        statefulProcessor=monitor, outputStructType=f"sym bigint, minute timestamp, {monitor.OUT}, late boolean", outputMode="Append", timeMode="EventTime")


def _judged(rows: DataFrame, column: str) -> DataFrame:
    """A judged minute always has a value, late rows have none: on the way from pandas NaN became null."""
    return rows.withColumn(column, F.when(~F.col("late"), F.coalesce(column, F.lit(float("nan")))))


def daily_loss_stop(ticks: DataFrame, limit: float = 0.02, lateness: str = LATENESS) -> DataFrame:
    return _judged(monitored(ticks, DailyLossStop(limit), lateness), "change")


def drawdown_monitor(ticks: DataFrame, limit: float = 0.15, lateness: str = LATENESS) -> DataFrame:
    return _judged(monitored(ticks, DrawdownMonitor(limit), lateness), "drawdown")


def limit_monitor(ticks: DataFrame, limit: float, lateness: str = LATENESS) -> DataFrame:
    return monitored(ticks, ExposureLimit(limit), lateness)


def emit_orders(path: str, make_orders: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: turn rows into orders and log them once per batch id."""
    write = batch_writer(path)

    def run(batch: DataFrame, batch_id: int) -> None:
        write(make_orders(batch), batch_id)

    return run
