"""The pipeline stage by stage, and the queries against SQL."""

import glob
import os
import re

import duckdb
import pytest
from conftest import SF
from helpers import assert_equal
from llm.data import edge_docs, no_docs
from llm.test_texts import strict_brute
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from loomline.llm.common import written

OPS = sorted(n for n in entry.queries() if re.match(r"op\d+_", n))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in OPS) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", [n for n in OPS if n in entry.oracle_sql()])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert_equal(entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df())


def test_stages_keep_columns_and_take_effect(spark):
    sf = f"{SF}/../sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    one = written(stage("quality classifier")(spark, docs, sf), "test")
    judged = docs.join(labels, "doc_id").join(one.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
    rate = {r["quality"]: r["k"] for r in judged.groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("k")).collect()}
    assert rate[1] > 0.95 and rate[0] < 0.3
    two = written(stage("MinHash near-dedup")(spark, one, SF), "test")
    assert two.select("text").distinct().count() == two.count() < one.count()
    three = written(stage("PII")(spark, two, SF), "test")
    assert three.count() == two.count()
    assert not any(strict_brute(r["text"]) for r in three.collect())
    assert three.where("n_chars <> length(text)").count() == 0
    four = written(stage("mixing sources to target weights")(spark, three, SF), "test")
    assert 0.5 * three.count() < four.count() < three.count()
    assert all(x.columns == columns for x in (one, two, three, four))
    assert four.join(three, columns, "left_anti").isEmpty()
    five = stage("SentencePiece encoding and decoding")(spark, four, SF)
    assert five.count() == four.count() and five.where("NOT round_trip").isEmpty()


def test_stages_on_hard_rows_and_on_nothing(spark):
    docs = written(edge_docs(spark), "test")
    for name, fn in corpus_pipeline.STAGES:
        docs = written(fn(spark, docs, SF), "test")
        if name == "MinHash near-dedup":
            ids = [r["doc_id"] for r in docs.collect()]
            assert ids.count(10) == 1 and ids.count(None) == 1 and {4, 5, 6} <= set(ids) and 2 not in ids
    assert docs.count() > 0
    docs = no_docs(spark)
    for _, fn in corpus_pipeline.STAGES:
        docs = written(fn(spark, docs, SF), "test")
    assert docs.count() == 0
