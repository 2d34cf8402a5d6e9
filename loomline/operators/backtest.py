"""Set-oriented strategy evaluation.

A strategy is a table of selected names at decision dates. Between two
rebalances weights drift with prices in closed form, so holding returns,
costs, NAV, trades and statistics are joins, aggregates and windows over bars.
All operators carry a ``strategy`` key: a parameter sweep is one job.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.calendar import PERIODS_PER_YEAR, period_key
from loomline.operators.panel import by_sym
from loomline.operators.panel import clip as clipped
from loomline.operators.panel import last_rows, to_here, top
from loomline.session import written

# Published cost and capital defaults (fixed values).
FEE_RATIO = 0.001425
TAX_RATIO = 0.003
INITIAL_CAPITAL = 10_000_000.0


def price_column(mode: str) -> Column:
    c = F.col
    try:
        return {
            "open": c("open"),
            "close": c("close"),
            "avg": (c("open") + c("high") + c("low") + c("close")) / 4,
        }[mode]
    except KeyError:
        raise ValueError("trade_at_price is open, close or avg") from None


def calendar_of(bars: DataFrame) -> DataFrame:
    """(date, i, next_date): one row per trading date. Its size is the number
    of dates, so the ordering windows over it are bounded."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return bars.groupBy("date").agg(F.count("*").alias("_n")).select(
        "date", F.row_number().over(w).alias("i"), F.lead("date").over(w).alias("next_date")
    )


def schedule(cal: DataFrame, freq: str) -> DataFrame:
    """(decision, effective, until): decide on the last date of a period,
    trade at the next bar, hold until the next trade."""
    dec = cal.groupBy(period_key("date", freq).alias("_p")).agg(
        F.max("date").alias("decision"), F.max_by("next_date", "date").alias("effective"))
    w = Window.partitionBy(F.lit(0)).orderBy("effective")
    return dec.where(F.col("effective").isNotNull()).select(
        "decision", "effective", F.lead("effective").over(w).alias("until"), F.row_number().over(w).alias("k"))


def carry_on_calendar(panel: DataFrame, cal: DataFrame, values: list[str]) -> DataFrame:
    """Values on every calendar date from a symbol's first bar on."""
    last = cal.agg(F.max("i")).scalar()
    idx = panel.join(cal.select("date", "i"), "date")
    grid = idx.groupBy("sym").agg(F.min("i").alias("_f")).select("sym", F.explode(F.sequence("_f", last)).alias("i"))
    w = Window.partitionBy("sym").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    j = grid.join(idx.drop("date"), ["sym", "i"], "left").select(
        "sym", "i", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values],
        *[c for c in panel.columns if c not in ("date", "sym", *values)])
    return j.join(cal.select("date", "i"), "i")


def equal_weights(names: DataFrame, keys: list[str]) -> DataFrame:
    n = names.groupBy(*keys).agg(F.count("*").alias("_n"))
    return names.join(n, keys).withColumn("weight", 1.0 / F.col("_n")).drop("_n")


@dataclass
class Result:
    """What a simulation returns; every part is a lazy DataFrame."""

    bars: DataFrame
    cal: DataFrame
    sched: DataFrame
    target: DataFrame  # strategy, effective, sym, weight
    freq: str
    bar_freq: str
    trade_at_price: str
    fee_ratio: float
    tax_ratio: float
    initial_capital: float
    name: str

    @cached_property
    def path(self) -> DataFrame:
        """Held names by date: growth since the rebalance that opened them."""
        b = self.bars.select("date", "sym", "high", "low", price_column(self.trade_at_price).alias("px"))
        # only names that are ever held are carried over the calendar
        b = b.join(self.target.select("sym").distinct(), "sym", "left_semi")
        p = carry_on_calendar(b, self.cal, ["px"])
        # the opening rebalance of a date is the last one strictly before it
        w = Window.partitionBy(F.lit(0)).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
        opened = self.cal.join(
            self.sched.select(F.col("effective").alias("date"), F.lit(True).alias("_e")), "date", "left"
        ).select("date", F.last(F.when(F.col("_e"), F.col("date")), ignorenulls=True).over(w).alias("effective"))
        opened = opened.where(F.col("effective").isNotNull())
        p = p.withColumn("px0", F.lag("px").over(Window.partitionBy("sym").orderBy("i")))
        p = p.join(opened, "date")
        w = Window.partitionBy("sym", "effective").orderBy("i")
        p = p.withColumn("base", F.first("px0").over(w)).where(F.col("base").isNotNull())
        p = p.join(self.target, ["sym", "effective"]).withColumn("g", F.col("px") / F.col("base"))
        # growth, costs and trades all read it: computed once
        return written(p.drop("i", "px0"), "path")

    @cached_property
    def growth(self) -> DataFrame:
        return self.path.groupBy("strategy", "effective", "date").agg(
            (1 + F.sum(F.col("weight") * (F.col("g") - 1))).alias("growth"))

    @cached_property
    def costs(self) -> DataFrame:
        """Fee on turnover and tax on sales, on the rebalance date itself."""
        ends = self.path.join(
            self.sched.select(F.col("effective").alias("date")), "date", "left_semi")
        drift = ends.join(self.growth, ["strategy", "effective", "date"]).select(
            "strategy", F.col("date").alias("effective"), "sym",
            (F.col("weight") * F.col("g") / F.col("growth")).alias("old"))
        j = self.target.select("strategy", "effective", "sym", "weight").join(
            drift, ["strategy", "effective", "sym"], "full_outer")
        d = F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
        return j.groupBy("strategy", F.col("effective").alias("date")).agg(
            F.sum(F.abs(d)).alias("turnover"), F.sum(F.greatest(-d, F.lit(0.0))).alias("sold"),
        ).withColumn("cost", self.fee_ratio * F.col("turnover") + self.tax_ratio * F.col("sold"))

    @cached_property
    def nav(self) -> DataFrame:
        """(strategy, date, ret, cost, nav), one row per date from the first
        rebalance on."""
        first = self.sched.agg(F.min("effective")).scalar()
        ends = self.cal.where(F.col("date") >= first).agg(
            F.collect_list("date").alias("_dates"))  # the calendar, one array
        names = self.target.select("strategy").distinct()
        grid = names.withColumn("date", F.explode(ends.scalar()))
        w = Window.partitionBy("strategy", "effective").orderBy("date")
        step = self.growth.withColumn(
            "ret", F.col("growth") / F.coalesce(F.lag("growth").over(w), F.lit(1.0)) - 1
        ).select("strategy", "date", "ret")
        j = grid.join(step, ["strategy", "date"], "left").join(
            self.costs.select("strategy", "date", "cost"), ["strategy", "date"], "left")
        j = j.select("strategy", "date", F.coalesce("ret", F.lit(0.0)).alias("gross"),
                     F.coalesce("cost", F.lit(0.0)).alias("cost"))
        j = j.withColumn("ret", (1 + F.col("gross")) * (1 - F.col("cost")) - 1)
        return nav_of(j, self.initial_capital)

    def report(self) -> DataFrame:
        return statistics(self.nav, PERIODS_PER_YEAR[self.bar_freq], self.initial_capital)

    @cached_property
    def spells(self) -> DataFrame:
        """Consecutive periods of one name belong to one spell."""
        s = self.target.join(self.sched, "effective")
        w = Window.partitionBy("strategy", "sym").orderBy("k")
        return s.withColumn("spell", F.col("k") - F.row_number().over(w))

    def get_trades(self) -> DataFrame:
        """One row per spell: dates, days, size, return, drawdown, excursions."""
        keys = ["strategy", "sym", "spell"]
        s = self.spells.select(*keys, "effective", "until")
        # a spell that reaches the last rebalance has no exit yet
        ends = s.groupBy(*keys).agg(F.max_by("until", "effective").alias("exit_date"))
        p = self.path.join(s, ["strategy", "sym", "effective"])
        w = Window.partitionBy("strategy", "sym", "spell").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        p = p.withColumn("entry_px", F.first("base").over(w))
        p = p.withColumn("_peak", F.greatest(F.max("px").over(w), F.col("entry_px")))
        t = p.groupBy("strategy", "sym", "spell").agg(
            F.min("effective").alias("entry_date"),
            F.max("date").alias("_last"),
            F.min_by("weight", "effective").alias("weight"),
            F.first("entry_px").alias("entry_price"),
            F.max_by("px", "date").alias("exit_price"),
            F.min(F.col("px") / F.col("_peak") - 1).alias("mdd"),
            F.min("low").alias("_lo"), F.max("high").alias("_hi"),
        )
        return t.join(ends, keys).select(
            "strategy", "sym", "entry_date", "exit_date",
            F.datediff(F.coalesce("exit_date", "_last"), "entry_date").alias("days"), "weight",
            "entry_price", "exit_price", (F.col("exit_price") / F.col("entry_price") - 1).alias("ret"), "mdd",
            F.least(F.lit(0.0), F.col("_lo") / F.col("entry_price") - 1).alias("mae"),
            F.greatest(F.lit(0.0), F.col("_hi") / F.col("entry_price") - 1).alias("mfe"),
        )


def sim(
    signals: DataFrame,
    bars: DataFrame,
    resample: str = "M",
    position_limit: int | None = None,
    trade_at_price: str = "open",
    fee_ratio: float = FEE_RATIO,
    tax_ratio: float = TAX_RATIO,
    initial_capital: float = INITIAL_CAPITAL,
    market_price: str = "close",
    name: str = "strategy",
    rank: str | None = None,
    bar_freq: str = "W",
) -> Result:
    """Evaluate boolean signals (date, sym, signal[, strategy]) or given
    weights (date, sym, weight[, strategy]) on bars.

    ``position_limit`` keeps the best names by ``rank``, else by symbol.
    NAV is marked at the trade price.
    """
    if "strategy" not in signals.columns:
        signals = signals.withColumn("strategy", F.lit(name))
    cal = written(calendar_of(bars), "calendar")
    sched = schedule(cal, resample)
    at = signals.join(sched.select(F.col("decision").alias("date"), "effective"), "date")
    if "weight" in signals.columns:
        target = at.where(F.col("weight") != 0).select("strategy", "effective", "sym", "weight")
    else:
        at = at.where(F.col("signal"))
        if position_limit is not None:
            at = top(at, rank or "signal", position_limit, ("strategy", "effective"))
        target = equal_weights(at.select("strategy", "effective", "sym"), ["strategy", "effective"])
    target = written(target, "target")
    return Result(bars, cal, sched, target, resample, bar_freq, trade_at_price, fee_ratio, tax_ratio,
                  initial_capital, name)


# ---- return series -------------------------------------------------------


def nav_of(series: DataFrame, capital: float = 1.0, key: str = "strategy") -> DataFrame:
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max(F.col("ret") <= -1).over(w)
    prod = F.exp(F.sum(F.when(F.col("ret") > -1, F.log1p("ret")).otherwise(0.0)).over(w))
    return series.withColumn("nav", capital * F.when(lost, 0.0).otherwise(prod))


def statistics(nav: DataFrame, periods: int, capital: float = 1.0, key: str = "strategy") -> DataFrame:
    """Total and annual return, drawdown and Sharpe ratio, one row per key."""
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = nav.withColumn("_dd", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(capital)) - 1)
    sd = F.stddev_samp("ret")
    total = F.max_by("nav", "date") / capital
    return d.groupBy(key).agg(
        F.count("*").alias("n"),
        (total - 1).alias("total_return"),
        (F.pow(total, periods / F.count("*")) - 1).alias("annual_return"),
        F.least(F.min("_dd"), F.lit(0.0)).alias("max_drawdown"),
        F.when(sd > 0, F.avg("ret") / sd * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        (sd * F.sqrt(F.lit(float(periods)))).alias("volatility"),
    )


def rolling_sharpe(series: DataFrame, n: int, periods: int, key: str = "strategy") -> DataFrame:
    w = Window.partitionBy(key).orderBy("date").rowsBetween(-(n - 1), 0)
    sd = F.stddev_samp("ret").over(w)
    v = F.when((F.count("ret").over(w) == n) & (sd > 0), F.avg("ret").over(w) / sd * F.sqrt(F.lit(float(periods))))
    return series.withColumn("sharpe", v)


def against_benchmark(nav: DataFrame, bench: DataFrame, key: str = "strategy") -> DataFrame:
    """NAV next to the benchmark's, with the excess return of each date."""
    j = nav.select(key, "date", "ret").join(bench.select("date", F.col("ret").alias("bench_ret")), "date")
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)

    def run(c):
        return F.exp(F.sum(F.log1p(c)).over(w))

    return j.withColumns({
        "curve": run("ret"), "bench_curve": run("bench_ret"), "excess": F.col("ret") - F.col("bench_ret")})


def trading_costs(positions: DataFrame, trading_bps: float, idle_bps: float) -> DataFrame:
    """Cost per traded fraction, and a time cost for periods without a trade."""
    prev = F.coalesce(F.lag("position").over(by_sym()), F.lit(0.0))
    turn = F.abs(F.col("position") - prev)
    return positions.withColumn("turnover", turn).withColumn(
        "cost", F.when(F.col("turnover") > 0, F.col("turnover") * trading_bps / 1e4).otherwise(idle_bps / 1e4))


def net_rewards(positions: DataFrame) -> DataFrame:
    """Yesterday's position earns today's return; today's cost is paid today."""
    held = F.coalesce(F.lag("position").over(by_sym()), F.lit(0.0))
    return positions.withColumn("reward", held * F.coalesce("ret", F.lit(0.0)) - F.col("cost"))


def stop_loss(trade_path: DataFrame, limit: float = 0.10, spell: tuple[str, ...] = ("strategy", "sym", "spell")) -> DataFrame:
    """Cut a spell at its first bar with a loss of at least ``limit``.
    Expects ``px``, ``entry_px`` and ``date`` per row of the spell."""
    hit = F.round(F.col("px") / F.col("entry_px") - 1, 12) <= -limit
    first = trade_path.where(hit).groupBy(*spell).agg(F.min("date").alias("stop_date"))
    return trade_path.join(first, list(spell), "left").where(
        F.col("stop_date").isNull() | (F.col("date") <= F.col("stop_date")))


def portfolio_hard_stop(nav: DataFrame, rebalances: DataFrame, limit: float = 0.10) -> DataFrame:
    """Cash from a fall of ``limit`` below the peak until the next rebalance.
    Depends on its own NAV, so one strategy's by-date series is folded."""
    d = nav.select("strategy", "date", "ret").join(
        rebalances.select("date").distinct().withColumn("reb", F.lit(True)), "date", "left")

    def fold(pdf):
        pdf = pdf.sort_values("date", ignore_index=True)
        level, peak, out, scaled, flags = 1.0, 1.0, False, [], []
        for ret, reb in zip(pdf["ret"], pdf["reb"].fillna(False)):
            if not out:
                level *= 1 + ret
            if out and reb:
                out, peak = False, level
            peak = max(peak, level)
            flags.append(out)
            if not out and level / peak - 1 <= -limit + 1e-12:
                out = True
            scaled.append(level)
        return pdf.assign(nav=scaled, stopped=flags)[["strategy", "date", "ret", "nav", "stopped"]]

    return d.groupBy("strategy").applyInPandas(fold, "strategy string, date date, ret double, nav double, stopped boolean")


def soft_stop(nav: DataFrame, n: int, k: float = 2.0, factor: float = 0.5) -> DataFrame:
    """Exposure is scaled the date after NAV falls k deviations below its mean."""
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(-(n - 1), 0)
    full = F.count("nav").over(w) == n
    low = full & (F.col("nav") < F.avg("nav").over(w) - k * F.stddev_pop("nav").over(w))
    d = nav.withColumn("_low", F.coalesce(low, F.lit(False)))
    prev = F.lag("_low").over(Window.partitionBy("strategy").orderBy("date"))
    return d.withColumn("exposure", F.when(prev, factor).otherwise(1.0)).drop("_low").withColumn(
        "scaled_ret", F.col("ret") * F.col("exposure"))


def book_keys(weights: DataFrame) -> list[str]:
    """The columns whose rows make up one portfolio: strategies stay apart."""
    return [c for c in ("strategy", "date") if c in weights.columns]


def cap_weights(weights: DataFrame, max_position: float = 0.10, max_sector: float = 0.30) -> DataFrame:
    """Clip names, then scale sectors over their cap; the rest is cash."""
    w = weights.withColumn("_w", F.least("weight", F.lit(max_position)))
    by = [*book_keys(weights), "category"]
    s = w.groupBy(*by).agg(F.sum("_w").alias("_s"))
    f = F.when(F.col("_s") > max_sector, max_sector / F.col("_s")).otherwise(1.0)
    return w.join(s, by).withColumn("capped", F.col("_w") * f).drop("_w", "_s")


def half_kelly(returns: DataFrame, n: int, cap: float = 0.10) -> DataFrame:
    w = last_rows(n)
    k = 0.5 * F.try_divide(F.avg("ret").over(w), F.var_samp("ret").over(w))
    return returns.withColumn(
        "weight", F.when(F.count("ret").over(w) == n, F.greatest(F.lit(0.0), F.least(F.lit(cap), k))))


def blend(positions: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of strategy positions; unknown strategies weigh nothing."""
    f = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return positions.withColumn("_w", F.col("weight") * f[F.col("strategy")]).where(F.col("_w").isNotNull()).groupBy(
        "date", "sym").agg(F.sum("_w").alias("weight"))


def target_positions(selected: DataFrame, prices: DataFrame, total_value: float) -> DataFrame:
    """Whole shares of equal value at the last price."""
    n = selected.groupBy("date").agg(F.count("*").alias("_n"))
    return selected.join(n, "date").join(prices, ["date", "sym"]).withColumn(
        "shares", F.floor(F.lit(total_value) / F.col("_n") / F.col("price"))).drop("_n")


# ---- orders, fills, holdings --------------------------------------------


#: Bars of a block, blocks of the next larger one, and so on.
FAN = 32


def _satisfied(b: Column) -> Column:
    """Whether a bar, or some bar of a block, fills the order on the row."""
    return (b["low"] <= F.col("_lo")) | (b["high"] >= F.col("_hi"))


def _period_number(d: Column, freq: str) -> Column:
    """Consecutive numbers of consecutive periods."""
    days = F.datediff(d, F.lit("1970-01-01").cast("date"))
    if freq in ("W", "W-FRI"):
        return F.floor(days / 7).cast("long")
    return (F.year(d) * 12 + F.month(d)).cast("long") if freq in ("M", "ME") else days.cast("long")


def _block_tables(bars: DataFrame, freq: str) -> list[DataFrame]:
    """Level by level ``(sym, block, items)``: the bars of a block of periods, then the lows and highs of the blocks of a
    larger one, FAN of them at most, until one block of the largest spans all periods."""
    bars = bars.select("sym", (_period_number(F.col("date"), freq)).alias("at"), "date", "low", "high")
    ends = bars.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    first, n = ends["first"] or 0, (ends["last"] or 0) - (ends["first"] or 0) + 1
    items, size, tables = bars.withColumn("at", F.col("at") - first), n, []
    while True:
        item = F.struct("at", "low", "high", *(["date"] if not tables else []))
        t = items.groupBy("sym", F.expr(f"at div {FAN}").alias("block")).agg(
            F.sort_array(F.collect_list(item)).alias("items"), F.min("low").alias("low"), F.max("high").alias("high"))
        t = written(t, "blocks")
        tables.append(t.select("sym", "block", "items"))
        size = -(-size // FAN)
        if size <= 1:
            return first, tables
        items = t.select("sym", F.col("block").alias("at"), "low", "high")


def _bounds(orders: DataFrame) -> DataFrame:
    """Order types as two prices: filled when low <= ``_lo`` or high >= ``_hi``."""
    buy, kind, inf = F.col("side") == "Buy", F.col("type"), F.lit(float("inf"))
    below = ((kind == "Limit") & buy) | ((kind == "StopLoss") & ~buy)
    return orders.withColumns({
        "_lo": F.when(kind == "Market", inf).when(below, F.col("limit_price")).otherwise(-inf),
        "_hi": F.when((kind == "Market") | below, inf).otherwise(F.col("limit_price")),
    })


def trigger_dates(orders: DataFrame, bars: DataFrame, freq: str = "W") -> DataFrame:
    """First bar after an order that satisfies it; bars end on period ends.

    An order looks for it in the block of periods it falls in, then in ever
    larger blocks behind that one, each known by the lows and highs of its
    parts, and from the first part that holds a fill back down to a bar. Every
    step is a join by symbol and block, so orders of a busy symbol spread over
    its blocks, and orders are never multiplied by bars. Where an order has no
    need of a step it carries a key of its own that matches nothing.
    """
    first, tables = _block_tables(bars, freq)
    own = -1 - F.pmod(F.xxhash64("order_id"), F.lit(4099))
    start = _period_number(period_key("date", freq), freq) - first
    o = _bounds(orders).withColumns({
        "_from": F.greatest(start, F.lit(-1)), "trigger_date": F.lit(None).cast("date"), "_hit": F.lit(None).cast("long"), "_level": F.lit(None).cast("int")})

    def looked_up(o: DataFrame, level: int, need: Column, block: Column) -> DataFrame:
        t = tables[level].select(F.col("sym").alias("_sym"), F.col("block").alias("_block"), "items")
        key = F.when(need, block).otherwise(own)
        return o.withColumn("_key", key).join(t, (F.col("sym") == F.col("_sym")) & (F.col("_key") == F.col("_block")), "left").drop("_sym", "_block")

    for level in range(len(tables)):
        looking = F.col("trigger_date").isNull() & F.col("_hit").isNull()
        block = F.floor(F.greatest("_from", F.lit(0)) / FAN).cast("long")
        o = looked_up(o, level, looking, block)
        if level:
            fits = F.filter("items", lambda x: (x["at"] >= F.col("_from")) & _satisfied(x))
            o = o.withColumn("_found", F.get(fits, F.lit(0))["at"])
            o = o.withColumn("_hit", F.coalesce("_hit", "_found")).withColumn("_level", F.coalesce("_level", F.when(F.col("_found").isNotNull(), level - 1)))
        else:
            fits = F.filter("items", lambda x: (x["date"] > F.col("date")) & _satisfied(x))
            o = o.withColumn("trigger_date", F.get(fits, F.lit(0))["date"]).withColumn("_found", F.lit(None).cast("long"))
        o = o.withColumn("_from", F.when(looking, block + 1).otherwise(F.col("_from"))).drop("items", "_found", "_key")
    for level in range(len(tables) - 2, -1, -1):
        here = F.col("_level") == level
        o = looked_up(o, level, F.coalesce(here, F.lit(False)), F.col("_hit"))
        best = F.get(F.filter("items", _satisfied), F.lit(0))
        if level:
            o = o.withColumn("_hit", F.when(here, best["at"]).otherwise(F.col("_hit"))).withColumn("_level", F.when(here, level - 1).otherwise(F.col("_level")))
        else:
            o = o.withColumn("trigger_date", F.coalesce("trigger_date", F.when(here, best["date"])))
        o = o.drop("items", "_key")
    return o.drop("_lo", "_hi", "_from", "_hit", "_level")


def holdings(fills: DataFrame) -> DataFrame:
    """Open quantity, average buy cost and realised profit per symbol and date.

    Fills of a day are summed first, so the running sums see one row per
    symbol and date."""
    buy, sell = F.col("side") == "Buy", F.col("side") == "Sell"
    amount = F.col("qty") * F.col("price")
    d = fills.groupBy("sym", "date").agg(
        F.sum(F.when(buy, F.col("qty")).otherwise(0.0)).alias("bq"),
        F.sum(F.when(buy, amount).otherwise(0.0)).alias("ba"),
        F.sum(F.when(sell, F.col("qty")).otherwise(0.0)).alias("sq"),
        F.sum(F.when(sell, amount).otherwise(0.0)).alias("sa"))
    w = to_here()
    d = d.withColumns({
        "quantity": F.sum(F.col("bq") - F.col("sq")).over(w),
        "avg_cost": F.try_divide(F.sum("ba").over(w), F.sum("bq").over(w)),
    })
    d = d.withColumn("realised", F.col("sa") - F.col("sq") * F.coalesce("avg_cost", F.lit(0.0)))
    return d.withColumn("realised_total", F.sum("realised").over(w)).select(
        "sym", "date", "quantity", "avg_cost", "realised", "realised_total")


def latest_holdings(fills: DataFrame) -> DataFrame:
    h = holdings(fills)
    return h.groupBy("sym").agg(*[F.max_by(c, "date").alias(c) for c in ("quantity", "avg_cost", "realised_total")])


def mark(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Value of holdings at each symbol's last price."""
    last = bars.groupBy("sym").agg(F.max_by("close", "date").alias("price"))
    return positions.join(last, "sym", "left").withColumns({
        "market_value": F.col("quantity") * F.col("price"),
        "pnl": F.col("quantity") * (F.col("price") - F.col("avg_cost")),
        "pnl_ratio": F.try_divide("price", "avg_cost") - 1,
    })


def account(marked: DataFrame, cash: float) -> DataFrame:
    return marked.agg(
        F.count("*").alias("n_positions"), F.sum("market_value").alias("market_value"),
        (F.lit(cash) + F.sum("market_value")).alias("total_value"))


def trade_statistics(trades: DataFrame, key: str = "strategy") -> DataFrame:
    """Over closed trades: count, win rate, mean days, compounded return."""
    t = trades.where(F.col("exit_date").isNotNull())
    return t.groupBy(key).agg(
        F.count("*").alias("n_trades"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        F.avg("days").alias("avg_days"), F.avg("ret").alias("avg_ret"),
        F.when(F.min("ret") <= -1, -1.0).otherwise(
            F.exp(F.sum(F.when(F.col("ret") > -1, F.log1p("ret")))) - 1).alias("compounded"))


def treemap(
    panel: DataFrame, universe: DataFrame, start: str | None = None, end: str | None = None,
    area: str = "turnover", item: str = "return_ratio", clip: tuple[float, float] | None = None,
) -> DataFrame:
    """``(category, sym, area, item, n)`` per symbol, category and in all, from the bars of a closed range of dates.

    ``return_ratio`` is last over first close less one, ``turnover_ratio`` the share of all turnover; ``turnover`` is
    summed; any other name is a column of the panel, of which the last known value counts. Items are clipped for each
    symbol before categories take their mean. Symbols without a category or without bars in the range are left out; an empty range gives no rows.
    """
    p = panel.where(F.col("date").between(start or "0001-01-01", end or "9999-12-31"))

    def value(name):
        if name == "return_ratio":
            return F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1
        if name in ("turnover", "turnover_ratio"):
            return F.sum("turnover")
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("date")))

    per = p.groupBy("sym").agg(value(area).alias("area"), value(item).alias("item"))
    if item == "turnover_ratio":
        per = per.withColumn("item", F.try_divide("item", p.agg(F.sum("turnover")).scalar()))
    if clip is not None:
        per = per.withColumn("item", clipped("item", *map(float, clip)))
    return per.join(universe, "sym").groupingSets([["category", "sym"], ["category"], []], "category", "sym").agg(
        F.sum("area").alias("area"), F.avg("item").alias("item"), F.count("*").alias("n"))


def sunburst(positions: DataFrame) -> DataFrame:
    return positions.rollup("strategy", "category", "sym").agg(F.sum("weight").alias("weight"))
