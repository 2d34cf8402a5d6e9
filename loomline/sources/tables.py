"""Panels and work tables derived from the parquet tables.

``Tables`` maps the driver tables onto the shapes the operators expect:
trade rows, bars, universe, fundamentals, orders, work items, logs. Every
method returns a lazy DataFrame.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.calendar import period_key, quarter_end, visible_from
from loomline.operators.panel import bars_from_ticks, carry_forward
from loomline.session import written

BUY_FLAGS = ("N", "A")


def trade_order(order: str, line: str, part: str) -> Column:
    """Order, line and part in one decimal, in this order. A fixed-width key keeps bars in a hash aggregate, where a struct
    would have every trade row sorted. Orders are any 64-bit and lines any 32-bit number; part numbers count up to ten
    million, so that only rows of one order, line and larger part stay tied."""
    of_order, of_line = (F.coalesce(F.col(c), F.lit(0)) for c in (order, line))
    big = of_order.cast("decimal(19,0)") * F.lit(5 * 10**9).cast("decimal(10,0)") + of_line.cast("decimal(10,0)")
    last = F.greatest(F.lit(0), F.least(F.coalesce(F.col(part), F.lit(0)), F.lit(10**7 - 1))).cast("decimal(7,0)")
    return (big.cast("decimal(29,0)") * F.lit(10**7).cast("decimal(8,0)") + last).cast("decimal(36,0)")


def packed_order(keys: tuple[str, ...], bits: list[int]) -> Column:
    """Keys of known numbers of bits in one long, in this order."""
    out = F.lit(0).cast("bigint")
    for c, n in zip(keys, bits, strict=True):
        out = F.shiftleft(out, n).bitwiseOR(F.coalesce(F.col(c).cast("bigint"), F.lit(0)))
    return out


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._stored: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    # ---- market panels -------------------------------------------------

    def ticks(self) -> DataFrame:
        """Trade rows. ``seq`` orders the rows of one day by order, line and part: bits of a long, or see ``trade_order``."""
        li, keys = self.raw("lineitem"), ("l_orderkey", "l_linenumber", "l_partkey")
        return li.select(
            F.col("l_suppkey").alias("sym"),
            F.to_date("l_shipdate").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("amount"),
            (trade_order(*keys) if self.seq_bits is None else packed_order(keys, self._key_bits)).alias("seq"),
        )

    @cached_property
    def _key_bits(self) -> list[int] | None:
        """Bits of the largest order, line and part number; none if one is negative."""
        keys = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("l_orderkey", "l_linenumber", "l_partkey")]
        least, *largest = self.raw("lineitem").agg(F.min(F.least(*keys)), *[F.max(k) for k in keys]).first()
        return None if least is not None and least < 0 else [int(k or 0).bit_length() for k in largest]

    @cached_property
    def seq_bits(self) -> int | None:
        """Bits of ``seq`` where day and ``seq`` fit in one long, else none."""
        bits = self._key_bits
        return sum(bits) if bits is not None and sum(bits) <= 57 else None

    def bars(self, freq: str = "W", start: str | None = None, end: str | None = None) -> DataFrame:
        """Bars that end within a closed range of dates. The range, widened to
        whole periods, reaches the scan of the trade rows."""
        rows = self.ticks()
        if start:
            rows = rows.where(F.col("date") >= F.date_sub(F.lit(start).cast("date"), 31))
        if end:
            rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
        b = bars_from_ticks(rows, freq, self.seq_bits)
        return b.where(F.col("date").between(start or "0001-01-01", end or "9999-12-31")) if start or end else b

    def last_date(self, freq: str = "W"):
        """End of the last period, from one column of the trade rows."""
        return self.raw("lineitem").agg(F.max(F.to_date("l_shipdate")).alias("date")).select(period_key("date", freq)).scalar()

    def stored(self, freq: str = "W") -> DataFrame:
        """Bars written once under the shared folder, for jobs that read them
        several times: the trade rows are scanned once."""
        return self.once(f"bars-{freq}", lambda: self.bars(freq))

    def stored_tasks(self) -> DataFrame:
        return self.once("tasks", self.tasks)

    def once(self, name: str, build) -> DataFrame:
        """A frame written at its first use, under a name."""
        if name not in self._stored:
            self._stored[name] = written(build(), name)
        return self._stored[name]

    def dense(self) -> DataFrame:
        """Weekly close with gaps carried forward, ``filled`` marks them."""
        return carry_forward(self.bars("W").select("date", "sym", "open", "close"), 7)

    @cached_property
    def n_symbols(self) -> int:
        """Width of a cross-section; a footer count of the dimension table."""
        return self.raw("supplier").count()

    def universe(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(
                F.col("s_suppkey").alias("sym"),
                F.col("n_name").alias("category"),
                F.col("r_name").alias("market"),
            )
        )

    def fundamentals(self) -> DataFrame:
        """One row per symbol and quarter; cost is quantity at the part's price."""
        gross, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
        li = self.raw("lineitem").join(self.raw("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"), "left")
        q = (
            li.groupBy(
                F.col("l_suppkey").alias("sym"),
                quarter_end(F.to_date("l_shipdate")).alias("quarter"),
            )
            .agg(
                F.sum(gross * (1 - disc)).alias("revenue"),
                F.sum(F.col("l_quantity") * F.col("p_retailprice")).alias("cost"),
                F.sum(gross * tax).alias("tax"),
                F.count("*").alias("n_lines"),
            )
        )
        sup = self.raw("supplier").select(
            F.col("s_suppkey").alias("sym"), (F.lit(10000.0) + F.abs("s_acctbal")).alias("equity")
        )
        run = Window.partitionBy("sym").orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
        return (
            q.join(sup, "sym")
            .withColumn("shares", F.lit(1000.0) + F.sum("n_lines").over(run))
            .select(
                "sym", "quarter", "revenue", "cost", "tax",
                (F.col("revenue") - F.col("cost") - F.col("tax")).alias("net"),
                "equity", "shares",
                visible_from(F.col("quarter")).alias("available"),
            )
        )

    def adjust_factors(self) -> DataFrame:
        """Split factor 0.5 at the first bar of a year where sym % 5 = 0."""
        b = self.bars("W").where(F.col("sym") % 5 == 0)
        return b.groupBy("sym", F.year("date").alias("year")).agg(F.min("date").alias("date")).select(
            "sym", "date", F.lit(0.5).alias("factor")
        )

    def orders(self) -> DataFrame:
        """Orders taken from trade rows: side, type and limit price."""
        li = self.lines()
        price = F.col("l_extendedprice") / F.col("l_quantity")
        kind = F.col("l_linenumber") % 3
        return li.select(
            (F.col("l_orderkey") * 100 + F.col("line")).alias("order_id"),
            F.col("l_suppkey").alias("sym"),
            F.to_date("l_shipdate").alias("date"),
            F.when(F.col("l_returnflag").isin(*BUY_FLAGS), "Buy").otherwise("Sell").alias("side"),
            F.when(kind == 0, "Market").when(kind == 1, "Limit").otherwise("StopLoss").alias("type"),
            F.col("l_quantity").alias("qty"),
            price.alias("price"),
            (price * (1 + F.col("l_discount") - 0.05)).alias("limit_price"),
        )

    # ---- work items ----------------------------------------------------

    def epics(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.when(F.col("o_orderstatus") == "F", "closed")
            .when(F.col("o_orderstatus") == "P", "in_progress")
            .otherwise("open").alias("state"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
            F.to_date("o_orderdate").alias("created"),
            F.col("o_custkey").alias("owner"),
            F.col("o_totalprice").alias("size"),
        )

    def lines(self) -> DataFrame:
        """Line items with ``line``, their number within the order by the total
        order of the rows: (order, line number) alone repeats. An order has a
        bounded number of lines, and the window sorts by order only."""
        rows = Window.partitionBy("l_orderkey").orderBy(
            F.to_date("l_shipdate"), "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_suppkey", "l_discount", "l_tax", "l_returnflag")
        return self.raw("lineitem").withColumn("line", F.row_number().over(rows))

    def tasks(self) -> DataFrame:
        """Tasks of an epic, one per line of the order."""
        flag = F.col("l_returnflag")
        chained = (F.col("line") > 1) & (F.col("line") % 3 != 0)
        return self.lines().select(
            (F.col("l_orderkey") * 100 + F.col("line")).alias("id"),
            F.col("l_orderkey").alias("epic_id"),
            F.col("line").alias("seq"),
            F.when(F.col("l_linestatus") == "F", "closed").when(flag == "R", "in_progress").otherwise("open").alias("state"),
            F.col("l_quantity").alias("effort"),
            (F.col("line") % 3 == 0).alias("parallel"),
            F.array(F.concat(F.lit("epic:"), F.col("l_orderkey").cast("string")), F.concat(F.lit("task:"), flag)).alias("labels"),
            F.to_date("l_shipdate").alias("due"),
            F.when(chained, F.array(F.col("l_orderkey") * 100 + F.col("line") - 1)).otherwise(F.array().cast("array<bigint>")).alias("depends_on"),
        )

    def deps(self) -> DataFrame:
        """Edges (id, dep_id); the dep may be unknown."""
        return self.tasks().select("id", "epic_id", F.explode("depends_on").alias("dep_id"))

    def item_log(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("user_id").alias("item"),
            "ts",
            "event_id",
            F.when(F.col("event_type") == "signup", "create")
            .when(F.col("event_type") == "click", "start")
            .when(F.col("event_type") == "view", "sync")
            .when(F.col("event_type") == "purchase", "close")
            .otherwise("reopen").alias("kind"),
            "value",
        )

    def remote_items(self) -> DataFrame:
        e = self.epics().where(F.col("id") % 11 != 0)
        return e.withColumn(
            "priority", F.when(F.col("id") % 7 == 0, F.col("priority") % 5 + 1).otherwise(F.col("priority"))
        )

    def last_sync(self) -> DataFrame:
        return self.epics().withColumn(
            "priority", F.when(F.col("id") % 13 == 0, F.col("priority") % 5 + 1).otherwise(F.col("priority"))
        )

    def comments(self) -> DataFrame:
        c = self.raw("conversations")
        return c.select(
            F.col("conv_id").alias("item"), F.col("turn"), F.col("role").alias("actor"),
            (F.col("conv_id") % 10).alias("file"), "text",
        )

    def events(self) -> DataFrame:
        """Ticks of the live feed with a zoned time column."""
        return feed_columns(self.raw("events"))


def feed_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("sym"),
        F.col("value").alias("price"),
        "event_type",
    )
