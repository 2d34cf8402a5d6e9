"""Joins with hot and null keys."""

from pyspark.sql import functions as F

from loomline.operators.joins import hot_keys, lookup_join


def tables(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("v"))
    table = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")).unionByName(
        spark.createDataFrame([(1, 10)], "k long, w long"))
    return rows, table


def test_same_rows_as_a_plain_join(spark):
    rows, table = tables(spark)
    for how in ("left", "inner"):
        got = sorted(map(tuple, lookup_join(rows, table, "k", how).select("k", "v", "w").collect()), key=str)
        want = sorted(map(tuple, rows.join(table, "k", how).select("k", "v", "w").collect()), key=str)
        assert got == want


def test_only_heavy_keys_are_hot(spark):
    rows, _ = tables(spark)
    assert [r["k"] for r in hot_keys(rows, ["k"]).collect()] == [1]
    assert hot_keys(rows.where("k <> 1"), ["k"]) is None
    assert hot_keys(rows.limit(0), ["k"]) is None


def test_hot_and_null_rows_stay_where_they_are(spark):
    rows, table = tables(spark)
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lookup_join(rows, table, "k")._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    # the shuffled part holds neither the hot key nor nulls
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan and "LeftAnti" in plan
