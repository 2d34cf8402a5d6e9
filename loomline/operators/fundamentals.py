"""Statement ratios and their as-of use on price panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.calendar import visible_from
from loomline.operators.panel import as_of


def by_quarter():
    return Window.partitionBy("sym").orderBy("quarter")


def with_lag(statements: DataFrame, lag_days: int = 45) -> DataFrame:
    return statements.withColumn("available", visible_from(F.col("quarter"), lag_days))


def ratios(statements: DataFrame) -> DataFrame:
    return statements.withColumns({
        "gross_margin": F.try_divide(F.col("revenue") - F.col("cost"), F.col("revenue")),
        "net_margin": F.try_divide("net", "revenue"),
        "roe": F.try_divide("net", "equity"),
    })


def valuation(bars: DataFrame, statements: DataFrame) -> DataFrame:
    """Price-to-book, price-to-earnings and market value with the statement visible that day."""
    j = as_of(bars, statements, ["net", "equity", "shares"], "available")
    return j.withColumns({
        "pb": F.try_divide("close", F.try_divide("equity", "shares")),
        "pe": F.try_divide("close", F.try_divide("net", "shares")),
        "market_value": F.col("close") * F.col("shares"),
    })


def growth(statements: DataFrame, periods: int = 4) -> DataFrame:
    """Change against the period a year before, and log share issuance."""
    return statements.withColumns({
        "revenue_growth": F.try_divide("revenue", F.lag("revenue", periods).over(by_quarter())) - 1,
        "net_issuance": F.ln(F.try_divide("shares", F.lag("shares", periods).over(by_quarter()))),
    })
