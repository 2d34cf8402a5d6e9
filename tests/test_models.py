"""Fits read their own part of the rows."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import models
from loomline.operators.models import MLEngine, tokens, topics, word_vectors
from loomline.plans.factors_queries import stored_features
from loomline.sources.tables import Tables


def test_a_fit_reads_the_rows_of_its_fold_alone(spark):
    first = datetime.date(2024, 1, 1)
    rows = [(first + datetime.timedelta(d), s, float(d * s % 7), float(d + 2 * s)) for d in range(20) for s in range(1, 6)]
    e = MLEngine(spark.createDataFrame(rows, "date date, sym long, f double, label double"), ["f"], 6, 3, 2, 1)
    whole = len(e.rows.inputFiles())
    for fold in (0, 1):
        for part, dates in (("train", 6), ("test", 3)):
            one = e.rows.where((F.col("fold") == fold) & (F.col("part") == part))
            assert one.count() == dates * 5
            path = set(one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
            assert path and all(f"fold={fold}/part={part}/" in p for p in path) and len(path) < whole
    assert e.rows.columns == ["date", "sym", "f", "label", "fold", "part"]
    assert e.train_predict("linear").count() == 2 * 3 * 5


def test_folds_without_rows_keep_their_columns(spark):
    e = MLEngine(spark.createDataFrame([], "date date, sym long, f double, label double"), ["f"], 6, 3, 2, 1)
    assert e.rows.count() == 0 and e.rows.columns == ["date", "sym", "f", "label", "fold", "part"]


def test_features_are_written_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert stored_features(t) is stored_features(t)
    assert "Window" not in stored_features(t)._jdf.queryExecution().toString()


def test_topics_and_word_vectors_read_stored_words(spark):
    text = ["Red apple, green apple", "green pear red plum", "blue sky grey sky", "grey sky blue sea"] * 4
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    w = tokens(docs)
    assert w.where("doc_id = 0").first()["words"] == ["red", "apple", "green", "apple"]
    assert "UDF" not in w._jdf.queryExecution().toString()
    t = topics(docs, 2, terms=3, rounds=2)
    assert len(t._jdf.queryExecution().toString()) < 2000  # the vocabulary is not in the plan
    assert dict(t.dtypes) == {"topic": "int", "rank": "int", "term": "string", "weight": "double"}
    found = t.toPandas()
    assert sorted(zip(found["topic"], found["rank"])) == [(k, i) for k in range(2) for i in range(3)]
    assert set(found["term"]) <= {x for line in text for x in line.lower().replace(",", "").split()}
    assert word_vectors(w, size=4).getVectors().where("word = 'sky'").count() == 1


def test_word_vectors_are_trained_part_by_part(spark, monkeypatch):
    rnd = random.Random(1)
    groups = [[f"{g}{i}" for i in range(12)] for g in ("red", "blue", "green")]
    text = [" ".join(rnd.choice(groups[i % 3] if rnd.random() < 0.7 else ["the", "of"]) for _ in range(60)) for i in range(300)]
    w = tokens(spark.createDataFrame([*enumerate(text), (300, "seldom red1"), (301, "")], "doc_id long, text string"))
    monkeypatch.setattr(models, "PART_WORDS", 6000)
    seen = []
    m = word_vectors(w, size=8)
    words = m.getVectors().toPandas()["word"]
    assert sorted(words) == sorted(["the", "of", *(x for g in groups for x in g)])  # "seldom" is there once
    for g in groups:
        near = [r["word"] for r in m.findSynonyms(g[1], 11).collect()]
        seen.append(len(set(near) & set(g)))
    assert min(seen) >= 10
    again = word_vectors(w, size=8, rounds=2)
    assert {r["word"] for r in again.findSynonyms("blue3", 11).collect()} == set(groups[1]) - {"blue3"}
    assert "word-vectors" in m.table.inputFiles()[0]  # a stored table, where the model held all words on the driver before


def test_word_vectors_of_nothing(spark):
    w = tokens(spark.createDataFrame([(1, "one two")], "doc_id long, text string"))
    assert word_vectors(w).getVectors().count() == 0 and word_vectors(w).findSynonyms("one", 3).count() == 0
    assert word_vectors(w.limit(0)).getVectors().count() == 0


def test_topics_are_those_of_the_text_however_it_is_dealt(spark):
    rnd = random.Random(1)
    groups = [[f"{g}{i}" for i in range(12)] for g in ("red", "blue", "green")]
    text = [" ".join(rnd.choice(groups[i % 3] if rnd.random() < 0.9 else groups[rnd.randrange(3)]) for _ in range(60)) for i in range(300)]
    docs = spark.createDataFrame([*enumerate(text), (300, ""), (301, "alone")], "doc_id long, text string")
    one, four = (topics(docs.repartition(n), 3, terms=8, rounds=20).toPandas().sort_values(["topic", "rank"], ignore_index=True) for n in (1, 4))
    assert one["term"].tolist() == four["term"].tolist() and abs(one["weight"] - four["weight"]).max() < 1e-9  # began at random by task before
    found = {frozenset(x.strip("0123456789") for x in g["term"]) for _, g in one.groupby("topic")}
    assert found == {frozenset({"red"}), frozenset({"blue"}), frozenset({"green"})}


def test_topics_of_documents_are_where_plain_steps_end():
    rng = np.random.default_rng(3)
    beta, alpha = np.exp(models._expected_logs(rng.gamma(100, 0.01, (4, 50)), axis=1)).astype("float32"), np.full(4, 0.25)
    sizes = np.array([1, 20, 7, 50])
    ids, counts = np.concatenate([rng.choice(50, n, replace=False) for n in sizes]), rng.integers(1, 9, sizes.sum())
    gamma, odds = models.document_topics(ids, counts, sizes, beta, alpha)
    again = models._expected_logs(gamma)
    for d, (lo, hi) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
        b, t = beta[:, ids[lo:hi]], np.exp(again[:, d])
        step = alpha + t * (b * (counts[lo:hi] / (t @ b))).sum(axis=1)
        assert abs(step - gamma[:, d]).mean() < 2e-3 and gamma[:, d].sum() == pytest.approx(1 + counts[lo:hi].sum(), rel=1e-4)
    assert len(odds) == len(ids)
