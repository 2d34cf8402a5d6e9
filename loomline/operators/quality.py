"""Completeness and outlier checks on panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completeness(panel: DataFrame, value: str, step_days: int, z_limit: float) -> DataFrame:
    """Per symbol: expected, missing and null cells of a regular calendar from
    its first bar on, and values more than ``z_limit`` deviations away."""
    last = panel.agg(F.max("date")).scalar()
    stat = panel.groupBy("sym").agg(
        F.min("date").alias("_first"), F.count("*").alias("_n"), F.count_if(F.col(value).isNull()).alias("nulls"),
        F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"),
    )
    out = panel.join(stat, "sym").groupBy("sym").agg(
        F.count_if(F.abs(F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))) > z_limit).alias("outliers")
    )
    expected = (F.floor(F.datediff(last, F.col("_first")) / step_days) + 1).cast("bigint")
    return stat.join(out, "sym").select(
        "sym", expected.alias("expected"), (expected - F.col("_n")).alias("missing"), "nulls", "outliers"
    )


def missing_cells(panel: DataFrame, step_days: int) -> DataFrame:
    """The missing (sym, date) cells themselves."""
    last = panel.agg(F.max("date")).scalar()
    grid = panel.groupBy("sym").agg(F.min("date").alias("_first")).select(
        "sym", F.explode(F.sequence("_first", last, F.expr(f"interval {step_days} days"))).alias("date"))
    return grid.join(panel.select("sym", "date"), ["sym", "date"], "left_anti")
