"""Streams over the events feed, each equal to its batch twin."""

from pyspark.sql import functions as F

from loomline.operators import backtest as B
from loomline.operators import work as W
from loomline.plans.registry import query, r, rd
from loomline.plans.strategy_queries import _HOLD
from loomline.plans.work_queries import _FOLD
from loomline.session import new_path
from loomline.streaming import monitor as S

_MIN = f"""
mi AS (SELECT sym, date_trunc('minute', ts) AS minute, first(price ORDER BY ts, event_id) AS open, max(price) AS high,
  last(price ORDER BY ts, event_id) AS close FROM feed GROUP BY 1, 2)"""


def naive(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("x10_minute_monitor", f"""
WITH g AS (SELECT sym, date_trunc('minute', ts) AS minute, sum(price) AS exposure, count(*) AS n FROM feed GROUP BY 1, 2)
SELECT sym, minute, {r('exposure')} AS exposure, n FROM g WHERE exposure > 50""")
def x10(t):
    d = S.drain_closed(lambda d: S.limit_monitor(d, 50.0), t.spark, t.root, "monitor").where("over")
    return d.select("sym", naive("minute"), rd("exposure").alias("exposure"), "n")


@query("x11_daily_loss_stop", f"""
WITH {_MIN}, o AS (SELECT *, first_value(open) OVER w AS day_open FROM mi WINDOW w AS (PARTITION BY sym, CAST(minute AS DATE) ORDER BY minute)),
b AS (SELECT *, close / day_open - 1 AS change FROM o)
SELECT sym, minute, close AS price, {r('change')} AS change,
  bool_or(change <= -0.02) OVER (PARTITION BY sym, CAST(minute AS DATE) ORDER BY minute ROWS UNBOUNDED PRECEDING) AS stopped FROM b""")
def x11(t):
    d = S.drain_closed(lambda d: S.daily_loss_stop(d, 0.02), t.spark, t.root, "loss-stop")
    return d.select("sym", naive("minute"), "price", rd("change").alias("change"), "stopped")


_LATE = """
la AS (SELECT event_id, sym, price, event_id >= (SELECT max(event_id) // 2 FROM feed) AS second,
  CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL 3 HOUR ELSE ts END AS ts FROM feed),
lw AS (SELECT *, date_trunc('minute', ts) AS minute, second AND epoch_ms(CAST(date_trunc('minute', ts) + INTERVAL 1 MINUTE AS TIMESTAMP))
  <= (SELECT epoch_ms(max(ts)) FROM la WHERE NOT second) - 3600000 AS late FROM la)"""


@query("x11_late_rows_of_a_stop", f"""
WITH {_LATE}, mi AS (SELECT sym, minute, first(price ORDER BY ts, event_id) AS open, last(price ORDER BY ts, event_id) AS close FROM lw WHERE NOT late GROUP BY 1, 2),
o AS (SELECT *, first_value(open) OVER (PARTITION BY sym, CAST(minute AS DATE) ORDER BY minute) AS day_open FROM mi), b AS (SELECT *, close / day_open - 1 AS change FROM o)
SELECT sym, minute, close AS price, {r('change')} AS change,
  bool_or(change <= -0.02) OVER (PARTITION BY sym, CAST(minute AS DATE) ORDER BY minute ROWS UNBOUNDED PRECEDING) AS stopped, false AS late FROM b
UNION ALL SELECT sym, minute, price, NULL, false, true FROM lw WHERE late""")
def x11_late(t):
    """Two arrivals of the feed; every 50th event is three hours behind. Late ones reach the side table, stops are those of the others."""
    path = new_path(t.spark, "late-stop")
    e = t.raw("events").withColumn("ts", F.when(F.col("event_id") % 50 == 0, F.col("ts") - F.expr("INTERVAL 3 HOURS")).otherwise(F.col("ts")))
    half = F.col("event_id") < F.floor(e.agg(F.max("event_id")).scalar() / 2)
    e.limit(0).write.parquet(f"{path}/in")
    feed = t.spark.readStream.schema(S.EVENT_SCHEMA).parquet(f"{path}/in")
    rows = S.daily_loss_stop(S.feed_columns(feed), 0.02)
    for part in (e.where(half), e.where(~half)):
        part.write.mode("append").parquet(f"{path}/in")
        S.start(rows, path, each=S.two_tables(path)).awaitTermination()
    S.closing_rows(t.spark, t.root, f"{path}/end")
    t.spark.read.schema(S.EVENT_SCHEMA).parquet(f"{path}/end").write.mode("append").parquet(f"{path}/in")
    S.start(rows, path, each=S.two_tables(path)).awaitTermination()
    both = t.spark.read.schema(rows.schema).parquet(f"{path}/rows").unionByName(t.spark.read.schema(rows.schema).parquet(f"{path}/late"))
    change = F.when(~F.col("late"), rd("change"))
    return both.where("sym IS NOT NULL").select("sym", naive("minute"), "price", change.alias("change"), "stopped", "late")


@query("x12_drawdown_monitor", f"""
WITH {_MIN}, p AS (SELECT *, max(high) OVER (PARTITION BY sym ORDER BY minute ROWS UNBOUNDED PRECEDING) AS peak FROM mi)
SELECT sym, minute, peak, {r('close / peak - 1')} AS drawdown, close / peak - 1 <= -0.15 AS breach FROM p""")
def x12(t):
    d = S.drain_closed(lambda d: S.drawdown_monitor(d, 0.15), t.spark, t.root, "drawdown")
    return d.select("sym", naive("minute"), "peak", rd("drawdown").alias("drawdown"), "breach")


@query("x10_late_rows", """
WITH a AS (SELECT *, event_id // 500 AS arrival, CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL 3 HOUR ELSE ts END AS t0 FROM feed),
s AS (SELECT arrival, max(max(t0)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a GROUP BY arrival)
SELECT event_id, sym, t0 AS ts, coalesce(t0 < seen - INTERVAL 1 HOUR, false) AS late FROM a JOIN s USING (arrival)""")
def x10_late(t):
    """Every 50th event arrives three hours behind; arrivals of 500 events."""
    d = t.events().withColumn("arrival", F.floor(F.col("event_id") / 500)).withColumn(
        "ts", F.when(F.col("event_id") % 50 == 0, F.col("ts") - F.expr("INTERVAL 3 HOURS")).otherwise(F.col("ts")))
    on_time, late = S.split_late(d)
    both = on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.select("event_id", "sym", naive("ts"), "late")


@query("x13_alerts", "SELECT DISTINCT sym, date_trunc('hour', ts) AS hour FROM feed WHERE price > 100")
def x13(t):
    return S.drain(S.alerts(S.feed(t.spark, t.root), 100.0), "alerts").select("sym", naive("hour"))


@query("x14_scheduled_run", f"""
SELECT event_type, count(*) AS n, {r('sum(price)', 4)} AS total FROM feed GROUP BY 1""")
def x14(t):
    """Two scheduled runs on one checkpoint: the second finds nothing new."""
    path = new_path(t.spark, "scheduled")
    S.drain(S.feed(t.spark, t.root), "scheduled", path=path)
    d = S.drain(S.feed(t.spark, t.root), "scheduled", path=path)
    return d.groupBy("event_type").agg(F.count("*").alias("n"), rd(F.sum("price"), 4).alias("total"))


_UPD = """
u AS (SELECT user_id AS order_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'Filled' WHEN 'error' THEN 'Rejected' ELSE 'Working' END AS status,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS filled FROM events)
SELECT order_id, arg_max(status, seq) AS status, CAST(sum(filled) AS BIGINT) AS filled_quantity, count(*) AS n_updates FROM u GROUP BY 1"""


def _updates(e):
    c = F.col("event_type")
    return e.select(F.col("user_id").alias("order_id"), F.col("event_id").alias("seq"),
                    F.when(c == "purchase", "Filled").when(c == "error", "Rejected").otherwise("Working").alias("status"),
                    F.when(c == "purchase", 1).otherwise(0).alias("filled"))


@query("x15_order_status", f"WITH {_UPD}")
def x15(t):
    return S.order_status(_updates(t.raw("events")))


@query("x15_order_status_stream", f"WITH {_UPD}")
def x15b(t):
    d = S.drain(S.order_status(_updates(S.raw_feed(t.spark, t.root))), "status", "update")
    return S.latest(d, ["order_id"])


@query("x16_live_positions", f"""
WITH {_HOLD} SELECT event_id, f.sym, f.price, {r('quantity * f.price', 3)} AS market_value, {r('quantity * (f.price - avg_cost)', 3)} AS pnl
FROM feed f JOIN hl USING (sym)""")
def x16(t):
    d = S.drain(S.marked(S.feed(t.spark, t.root), B.latest_holdings(t.orders())), "live")
    return d.select("event_id", "sym", "price", rd("market_value", 3).alias("market_value"), rd("pnl", 3).alias("pnl"))


@query("x17_execution_log", """
SELECT event_id AS order_id, user_id AS sym, CASE WHEN value > 50 THEN 'Sell' ELSE 'Buy' END AS side FROM events WHERE event_type = 'purchase'""")
def x17(t):
    path = new_path(t.spark, "executions")
    orders = S.emit_orders(f"{path}/rows", lambda b: b.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("order_id"), "sym", F.when(F.col("price") > 50, "Sell").otherwise("Buy").alias("side")))
    S.start(S.feed(t.spark, t.root), path, each=orders).awaitTermination()
    return t.spark.read.parquet(f"{path}/rows").select("order_id", "sym", "side")


@query("x04_user_callback", f"SELECT event_type, count(*) AS n, {r('max(price)')} AS top_price FROM feed GROUP BY 1")
def x04(t):
    """A user function per micro-batch; partial results are merged on read."""
    path = new_path(t.spark, "callback")

    def on_batch(batch, batch_id):
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.max("price").alias("p")).write.mode("overwrite").parquet(
            f"{path}/rows/batch={batch_id}")

    S.start(S.feed(t.spark, t.root), path, each=on_batch).awaitTermination()
    return t.spark.read.parquet(f"{path}/rows").groupBy("event_type").agg(F.sum("n").alias("n"), rd(F.max("p")).alias("top_price"))


@query("l01_state_fold_stream", f"WITH {_FOLD} SELECT item, state, n_events FROM fold")
def l01_stream(t):
    c = F.col("event_type")
    log = S.raw_feed(t.spark, t.root).select(
        F.col("user_id").alias("item"), "ts", "event_id", F.when(c == "signup", "create").when(c == "click", "start")
        .when(c == "view", "sync").when(c == "purchase", "close").otherwise("reopen").alias("kind"))
    return S.latest(S.drain(W.fold_state(log), "fold", "update"), ["item"]).select("item", "state", "n_events")
