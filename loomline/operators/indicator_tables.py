"""Tables built from indicators: momentum, crosses, bands, scores, candles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.indicators import indicators, lagged, rolled
from loomline.operators.panel import as_of, by_sym, rollup_bars, to_here
from loomline.operators.panel import recent_days as latest
from loomline.operators.ranking import tiles


def momentum_skip(monthly: DataFrame, far: int = 12, near: int = 1) -> DataFrame:
    """Return from ``far`` to ``near`` months back; the last month is left out."""
    return monthly.withColumn("mom", F.try_divide(lagged("close", near), lagged("close", far)) - 1)


def ma_cross(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """1 where the fast mean crosses above the slow one, -1 below, else 0."""
    b = bars.withColumn("_s", F.sign(rolled(F.avg, "close", fast) - rolled(F.avg, "close", slow)))
    b = b.withColumn("_p", F.lag("_s").over(by_sym()))
    up = (F.col("_s") > 0) & (F.col("_p") <= 0)
    down = (F.col("_s") < 0) & (F.col("_p") >= 0)
    return b.withColumn("cross_dir", F.when(up, 1).when(down, -1).otherwise(0)).drop("_s", "_p")


def cross_zscore(panel: DataFrame, value: str, out: str) -> DataFrame:
    """Standard score inside a date: moments by aggregation, then a join."""
    s = panel.groupBy("date").agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_d"))
    return panel.join(s, "date").withColumn(out, F.try_divide(F.col(value) - F.col("_m"), F.col("_d"))).drop("_m", "_d")


def prefix_product(panel: DataFrame, ret: str, out: str, by: list[str] | None = None, order: str = "date") -> DataFrame:
    """Running product of 1 + r. A null return counts as 0; from a total loss
    (r <= -1) on the product is 0."""
    w = Window.partitionBy(*(by or ["sym"])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.coalesce(F.col(ret), F.lit(0.0))
    lost = F.max(x <= -1).over(w)
    return panel.withColumn(
        out, F.when(lost, 0.0).otherwise(F.exp(F.sum(F.when(x > -1, F.log1p(x)).otherwise(0.0)).over(w)))
    )


def adjust(panel: DataFrame, factors: DataFrame, prices: list[str]) -> DataFrame:
    """Prices times the product of all later split factors."""
    later = by_sym().rowsBetween(1, Window.unboundedFollowing)
    j = panel.join(factors, ["sym", "date"], "left")
    f = F.exp(F.coalesce(F.sum(F.ln(F.coalesce("factor", F.lit(1.0)))).over(later), F.lit(0.0)))
    return j.withColumn("_f", f).select(*panel.columns, *[(F.col(p) * F.col("_f")).alias(f"adj_{p}") for p in prices])


def river(panel: DataFrame, price: str, base: str, split_range: int) -> DataFrame:
    """Price bands at evenly spaced multiples between the symbol's extremes."""
    p = panel.withColumn("_x", F.try_divide(price, base))
    m = p.groupBy("sym").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    p = p.join(m, "sym").withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(split_range))))
    mult = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("band") / split_range
    return p.withColumn("multiple", mult).withColumn("price", F.col("multiple") * F.col(base))


def radar(ratios: DataFrame, feats: list[str], cut_bins: int,
          portfolio: DataFrame | None = None) -> DataFrame:
    """Score 1..bins of each ratio in its quarter; scored over everyone, then
    cut to the portfolio."""
    long = ratios.unpivot(["sym", "quarter"], feats, "ratio", "v").where(F.col("v").isNotNull())
    s = tiles(long, ["quarter", "ratio"], [F.round("v", 9), F.col("sym")], cut_bins, "score")
    if portfolio is not None:
        s = s.join(portfolio, "sym", "left_semi")
    return s.select("sym", "quarter", "ratio", "score")


def candles(
    bars: DataFrame, overlays: list, technicals: list, symbol=None, recent_days: int | None = None,
    factors: DataFrame | None = None, resample: str | None = None,
) -> DataFrame:
    """OHLC with named indicator columns, all from one pass over the bars.

    ``symbol`` (one or a list) reaches the scan. ``factors`` adjusts prices for splits before bars are rolled up to
    ``resample``. Indicators see the whole history; ``recent_days`` then keeps dates less than so many days before the
    last bar of what was asked for.
    """
    prices = ["open", "high", "low", "close"]
    b = bars.select("date", "sym", *prices, "volume")
    if symbol is not None:
        b = b.where(F.col("sym").isin(symbol if isinstance(symbol, list) else [symbol]))
    if factors is not None:
        b = adjust(b, factors, prices).select("date", "sym", *[F.col(f"adj_{p}").alias(p) for p in prices], "volume")
    if resample is not None:
        b = rollup_bars(b, resample)
    out = indicators(b, [*overlays, *technicals])
    return out if recent_days is None else latest(out, recent_days)


def river_of(
    bars: DataFrame, statements: DataFrame, symbol=None, start: str | None = None, end: str | None = None,
    mode: str = "pe", split_range: int = 10,
) -> DataFrame:
    """Bands of one symbol, or of all, between the extremes of its price-to-earnings (``pe``) or price-to-book (``pb``)
    ratio within the range of dates. Statements before the range stay visible in it."""
    per_share = {"pe": "net", "pb": "equity"}[mode]
    b, s = bars.select("date", "sym", "close"), statements
    if symbol is not None:
        b, s = b.where(F.col("sym") == symbol), s.where(F.col("sym") == symbol)
    b = b.where(F.col("date").between(start or "0001-01-01", end or "9999-12-31"))
    j = as_of(b, s, [per_share, "shares"], "available").where(F.col("shares").isNotNull())
    return river(j.withColumn("base", F.try_divide(per_share, "shares")), "close", "base", split_range)
