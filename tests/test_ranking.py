"""Ranks over ranges equal plain windows, with ties, nulls and a group that holds nine tenths of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import ranking as R

GROUPS = (("hot", 1800), ("small", 7), (None, 190), ("one", 1))


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = [(g, i, None if rnd.random() < 0.05 else float(rnd.choice([1, 1, 1, 2, 3, rnd.random()])))
            for g, n in GROUPS for i in range(n)]
    return spark.createDataFrame(data, "g string, sym bigint, v double").repartition(4).cache()


@pytest.fixture(params=["windows", "mixed", "ranges"])
def way(request, monkeypatch):
    """All groups by windows, the hot one by ranges, all by ranges."""
    monkeypatch.setattr(R, "HOT_ROWS", {"windows": 10**6, "mixed": 1000, "ranges": 0}[request.param])


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_ordinal(rows, way):
    got = R.ordinal(rows, ["g"], [-F.col("v"), F.col("sym")]).select("g", "sym", "rn")
    same(got, rows.withColumn("rn", F.expr("cast(row_number() over (partition by g order by -v, sym) as bigint)")).select("g", "sym", "rn"))


def test_tiles(rows, way):
    got = R.tiles(rows, ["g"], [F.col("v"), F.col("sym")], 8).select("g", "sym", "bin")
    same(got, rows.withColumn("bin", F.expr("cast(ntile(8) over (partition by g order by v, sym) as bigint)")).select("g", "sym", "bin"))


SQL = {
    "average": "(rank() over (partition by g, v is null order by v) + (count(*) over (partition by g, v) - 1) / 2d)",
    "min": "cast(rank() over (partition by g, v is null order by v) as double)",
    "percent": "percent_rank() over (partition by g, v is null order by v)",
}


@pytest.mark.parametrize("method", sorted(SQL))
def test_tied_rank(rows, way, method):
    got = R.tied_rank(rows, ["g"], "v", "rank", method).select("g", "sym", "rank")
    same(got, rows.withColumn("rank", F.expr(f"if(v is null, null, {SQL[method]})")).select("g", "sym", "rank"))


def test_equal_values_only_and_nothing(spark, way):
    d = spark.range(500).select(F.lit("a").alias("g"), F.col("id").alias("sym"), F.lit(2.0).alias("v"))
    assert {r["rank"] for r in R.tied_rank(d, ["g"], "v").collect()} == {250.5}
    assert R.tied_rank(d.limit(0), ["g"], "v").count() == 0 and R.tiles(d.limit(0), ["g"], [F.col("v")], 3).count() == 0


def test_a_hot_group_spreads_over_ranges(rows, spark):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        dealt = R._dealt(rows, ["g"], [F.col("v").isNotNull(), F.col("v"), F.col("sym")])
        parts = dealt.inputFiles()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert dealt.count() == sum(n for _, n in GROUPS) and len(parts) == 8
