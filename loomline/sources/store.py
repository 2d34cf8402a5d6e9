"""Written tables: partitioned stores and idempotent nightly sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_year(df: DataFrame, path: str, date: str = "date", extra: tuple[str, ...] = ()) -> None:
    """Parquet by ``extra`` columns and year. Rows are rebalanced: a large year
    becomes several tasks and files, small ones share a task."""
    out = df.withColumn("year", F.year(date))
    parts = [*extra, "year"]
    out.hint("rebalance", *parts).write.mode("overwrite").partitionBy(*parts).parquet(path)


def write_nightly(df: DataFrame, path: str, keys: tuple[str, ...] = ("date",)) -> None:
    """Replace exactly the partitions present in ``df``; a rerun changes nothing.
    One night is one partition that holds the rows of all strategies."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
