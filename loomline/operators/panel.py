"""Long-panel building blocks: bars, resampling, alignment, selection.

A panel has the columns ``date`` and ``sym`` plus value columns. Windows over
one symbol run on bars only: their length is bounded by the number of periods
in the calendar, however many trade rows a symbol has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.calendar import period_key


def by_sym():
    return Window.partitionBy("sym").orderBy("date")


def to_here():
    return by_sym().rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int):
    return by_sym().rowsBetween(-(n - 1), 0)


# ---- bars and resampling ----------------------------------------------


def bars_from_ticks(ticks: DataFrame, freq: str = "D", seq_bits: int | None = None) -> DataFrame:
    """OHLCV per symbol and period of at most a month.

    One aggregation with map-side combine, so a symbol with a third of all
    trades still sends one partial row per task and period. ``seq`` orders the
    rows of a day: a number (a decimal of up to 36 digits) keeps the hash
    aggregate, anything else, a struct of columns too, sorts the rows. If all
    numbers are known to be from 0 and to have ``seq_bits`` bits at most, day
    and number are one long where they fit, which is cheaper than a decimal.
    """
    if freq not in ("D", "W", "W-FRI", "M", "ME"):
        raise ValueError("bars_from_ticks takes D, W or M; use rollup_bars beyond")
    end = period_key("date", freq)
    order = F.col("seq")
    if freq != "D":
        kind = dict(ticks.dtypes)["seq"]
        if seq_bits is not None and seq_bits <= 57:
            days = F.datediff("date", F.date_sub(end, 31)).cast("bigint")
            order = F.shiftleft(days, seq_bits).bitwiseOR(order.cast("bigint"))
        elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
            days = F.datediff("date", F.date_sub(end, 31)).cast("decimal(2,0)")
            order = days * F.lit(str(10**36)).cast("decimal(37,0)") + order.cast("decimal(36,0)")
        else:
            order = F.struct("date", "seq")
    t = ticks.select("sym", end.alias("_end"), "price", "qty", "amount", order.alias("_ord"))
    return (
        t.groupBy("sym", F.col("_end").alias("date"))
        .agg(
            F.min_by("price", "_ord").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_ord").alias("close"),
            F.sum("qty").alias("volume"),
            F.sum("amount").alias("turnover"),
        )
        .withColumn("vwap", F.try_divide("turnover", "volume"))
    )


def rollup_bars(bars: DataFrame, freq: str) -> DataFrame:
    """Coarser bars from finer ones."""
    return (
        bars.groupBy("sym", period_key("date", freq).alias("_end"))
        .agg(
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("_end", "date")
    )


def resample_last(panel: DataFrame, freq: str, values: list[str]) -> DataFrame:
    """Last value of each period."""
    return panel.groupBy("sym", period_key("date", freq).alias("_end")).agg(
        *[F.max_by(v, "date").alias(v) for v in values]
    ).withColumnRenamed("_end", "date")


def carry_forward(panel: DataFrame, step_days: int) -> DataFrame:
    """Regular grid per symbol from its first bar to the last date of the
    panel, values carried forward. The grid comes from a sequence per symbol,
    not from dates x symbols."""
    values = [c for c in panel.columns if c not in ("date", "sym")]
    last = panel.agg(F.max("date")).scalar()
    grid = (
        panel.groupBy("sym").agg(F.min("date").alias("_first"))
        .select("sym", F.explode(F.sequence("_first", last, F.expr(f"interval {step_days} days"))).alias("date"))
    )
    j = grid.join(panel.withColumn("_seen", F.lit(True)), ["sym", "date"], "left")
    return j.select(
        "date", "sym",
        *[F.last(v, ignorenulls=True).over(to_here()).alias(v) for v in values],
        F.col("_seen").isNull().alias("filled"),
    )


# ---- alignment and joins ----------------------------------------------


def as_of(left: DataFrame, right: DataFrame, values: list[str], right_date: str = "date") -> DataFrame:
    """Backward as-of join of two panels on ``sym`` by union and last value:
    one shuffle, no range join. Both sides must be bars-sized per symbol."""
    keep = [c for c in left.columns]
    lhs = left.withColumn("_side", F.lit(1))
    rhs = right.select(
        "sym", F.col(right_date).alias("date"), F.lit(0).alias("_side"),
        *[F.col(v).alias(f"_r_{v}") for v in values],
    )
    w = Window.partitionBy("sym").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = lhs.unionByName(rhs, allowMissingColumns=True)
    return (
        u.select(*keep, "_side", *[F.last(f"_r_{v}", ignorenulls=True).over(w).alias(v) for v in values])
        .where(F.col("_side") == 1)
        .drop("_side")
    )


def combine(panels: dict[str, DataFrame], freq: str | None = None) -> DataFrame:
    """Named single-value panels (date, sym, value) on one grid, one column
    per name, in one shuffle: union, then conditional aggregates."""
    parts = []
    for name, p in panels.items():
        q = p.select("date", "sym", "value")
        parts.append(
            q.select(
                "sym",
                (period_key("date", freq) if freq else F.col("date")).alias("date"),
                F.lit(name).alias("_name"), F.col("date").alias("_at"), "value",
            )
        )
    u = reduce(DataFrame.unionByName, parts)
    return u.groupBy("date", "sym").agg(
        *[F.max_by(F.when(F.col("_name") == n, F.col("value")),
                   F.when((F.col("_name") == n) & F.col("value").isNotNull(), F.col("_at"))).alias(n)
          for n in panels]
    )


def rebalance_orders(current: DataFrame, target: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Orders from weight differences of at least ``threshold``. Keys are
    (date, sym); a side without the key counts as 0."""
    j = current.select("date", "sym", F.col("weight").alias("cur")).join(
        target.select("date", "sym", F.col("weight").alias("tgt")), ["date", "sym"], "full_outer"
    )
    delta = F.coalesce("tgt", F.lit(0.0)) - F.coalesce("cur", F.lit(0.0))
    return (
        j.select("date", "sym", delta.alias("delta"))
        .where(F.abs("delta") >= threshold)
        .withColumn("side", F.when(F.col("delta") > 0, "Buy").otherwise("Sell"))
    )


# ---- predicates --------------------------------------------------------


def holds(cond: Column) -> Column:
    """A signal: a missing operand gives False."""
    return F.coalesce(cond, F.lit(False))


def clip(x, lo: float, hi: float) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def complete_dates(panel: DataFrame, value: str, n_symbols) -> DataFrame:
    """Rows of the dates on which all ``n_symbols`` symbols have a value."""
    full = panel.where(F.col(value).isNotNull()).groupBy("date").agg(F.count("*").alias("_n")).where(
        F.col("_n") == n_symbols
    )
    return panel.join(full.select("date"), "date", "left_semi")


def recent_days(panel: DataFrame, n: int) -> DataFrame:
    return panel.where(F.col("date") > F.date_sub(panel.agg(F.max("date")).scalar(), n))


def on_schedule(calendar: DataFrame, freq: str) -> DataFrame:
    """Decision dates: the last date of each period. The calendar is one row
    per date."""
    return calendar.groupBy(period_key("date", freq).alias("period")).agg(F.max("date").alias("date"))


# ---- selection and holding --------------------------------------------


def top(panel: DataFrame, value: str, n: int, keys: tuple[str, ...] = ("date",), ascending: bool = False) -> DataFrame:
    """The n best rows per key, ties by ``sym``; boolean values keep True only.

    Catalyst turns the rank filter into a map-side group limit, so at most n
    rows per key and task are shuffled.
    """
    is_bool = dict(panel.dtypes)[value] == "boolean"
    rows = panel.where(F.col(value) if is_bool else F.col(value).isNotNull())
    first = [] if is_bool else [F.asc(value) if ascending else F.desc(value)]
    w = Window.partitionBy(*keys).orderBy(*first, F.asc("sym"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hold_until(panel: DataFrame, entry: str = "entry", exit_: str = "exit", out: str = "held") -> DataFrame:
    """Held from an entry until an exit; both on one date means exit."""
    ev = F.when(F.col(exit_), F.lit(False)).when(F.col(entry), F.lit(True))
    return panel.withColumn(out, F.coalesce(F.last(ev, ignorenulls=True).over(to_here()), F.lit(False)))


def hold_until_slots(
    panel: DataFrame, n: int, rank: str = "rank_value", entry: str = "entry", exit_: str = "exit",
    key: str = "strategy",
) -> DataFrame:
    """Holding with at most n slots per strategy.

    On a date only the best 2n entries can matter: at most n names are held
    already, so 2n candidates always fill the slots. Spark prunes to those
    and to exits of names that were ever such a candidate; the remaining rows,
    at most 2n entries per date and the exits between them, are folded in
    date order for each strategy.
    """
    w = Window.partitionBy(key, "date").orderBy(F.desc(rank), F.asc("sym"))
    cand = (
        panel.where(F.col(entry) & ~F.col(exit_) & F.col(rank).isNotNull())
        .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * n)
        .select(key, "date", "sym", F.col("_r").cast("int").alias("_r"))
    )
    # Of a symbol's exits only the first after each candidate date can end a
    # holding, so exits per symbol never outnumber its candidate dates.
    sig = panel.where(F.col(exit_)).select(key, "date", "sym", F.lit(0).alias("_r"))
    names = cand.select(key, "sym").distinct()
    ev = cand.unionByName(sig.join(names, [key, "sym"], "left_semi"))
    ws = Window.partitionBy(key, "sym").orderBy("date")
    ev = ev.withColumn("_prev", F.lag("_r").over(ws)).where(
        (F.col("_r") > 0) | (F.col("_prev") > 0)
    ).drop("_prev")

    def fold(pdf):
        import pandas as pd

        strategy = pdf[key].iloc[0]
        pdf = pdf.sort_values(["date", "_r", "sym"], kind="stable")
        held: dict = {}
        out = []
        for day, g in pdf.groupby("date", sort=False):
            for s in g.loc[g["_r"] == 0, "sym"]:
                if s in held:
                    out.append((strategy, s, held.pop(s), day))
            for s in g.loc[g["_r"] > 0, "sym"]:
                if len(held) >= n:
                    break
                if s not in held:
                    held[s] = day
        out += [(strategy, s, d, None) for s, d in held.items()]
        return pd.DataFrame(out, columns=[key, "sym", "entry_date", "exit_date"])

    types = dict(panel.dtypes)
    spells = ev.groupBy(key).applyInPandas(
        fold, f"{key} {types[key]}, sym {types['sym']}, entry_date date, exit_date date"
    )
    return spells


def stack(parts: dict[str, DataFrame], key: str = "strategy") -> DataFrame:
    """Positions of several strategies in one table."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [p.withColumn(key, F.lit(n)) for n, p in parts.items()],
    )


def for_each_param(panel: DataFrame, values: list, name: str = "param") -> DataFrame:
    """Every row once per parameter value, in one job."""
    return panel.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
