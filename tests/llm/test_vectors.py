"""Searches against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from loomline.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, v int, block int, rank int, q string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, 3, 4, "x") for i, e in rows], SCHEMA).repartition(3)


def hard_rows():
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(100)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]  # equal vectors
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (340, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (360, [math.nan] * 6), (380, [0.0] * 6), (400, [1.0, 2.0]), (None, rows[1][1])]
    rows += [(20, rows[20][1])]  # a repeated row
    return rows


def sound(rows, zero):
    out = {}
    for i, e in rows:
        if i is not None and e is not None and len(e) == 6 and all(x is not None and math.isfinite(x) for x in e) and (zero or any(e)):
            out[i] = np.array(e, np.float64)
    return out


def best(vectors, k, score):
    out = []
    for q, a in vectors.items():
        if q % 20 == 0:
            found = sorted(((-score(a, b), i) for i, b in vectors.items() if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("lists", [1, 2, 3, 6, 50])
def test_exact_top_k(spark, lists, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 20)
    rows = hard_rows()
    ints = {i: np.floor(64 * x).astype(np.int64) for i, x in sound(rows, True).items()}
    got = topk.exact_top_k(table(spark, rows), k=20, lists=lists).collect()
    assert Counter(tuple(r) for r in got) == Counter(best(ints, 20, lambda a, b: int(a @ b)))


def test_exact_top_k_of_few_large_or_no_vectors(spark):
    few = [(0, [1.0, -1.0]), (20, [-1.0, -2.0]), (3, [1.0, 1.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(table(spark, few)).collect()}
    assert got == {(0, 1): (20, 4096), (0, 2): (3, 0), (20, 1): (0, 4096), (20, 2): (3, -12288)}
    assert topk.exact_top_k(table(spark, [])).collect() == []
    assert topk.exact_top_k(table(spark, [(0, [1.0])])).collect() == []
    big = [(0, [float(2**24)] * 3), (1, [float(2**24 - 1)] * 3), (2, [float(2**24)] * 3)]
    assert [(r["vec_id"], r["score"]) for r in topk.exact_top_k(table(spark, big)).orderBy("rank").collect()] == [(2, 3 * 2**60), (1, 3 * 2**30 * (2**30 - 64))]


def test_nearest_finds_what_is_near(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 40)
    rows = hard_rows()
    vectors = sound(rows, False)
    want = best(vectors, 20, lambda a, b: float((a * b).sum()))
    got = [tuple(r) for r in ann.nearest(table(spark, rows), k=20).collect()]
    least = {q: s for q, n, _, s in want if n == 20}
    assert {q for q, *_ in got} == set(least)
    assert sum(s >= least[q] - 1e-12 for q, _, _, s in got) >= 0.9 * len(want)
    for q in least:
        own = sorted(x for x in got if x[0] == q)
        assert [x[1] for x in own] == list(range(1, len(own) + 1))
        assert [(-x[3], x[2]) for x in own] == sorted((-x[3], x[2]) for x in own)
        assert all(x[3] == (vectors[q] * vectors[x[2]]).sum() for x in own) and q not in [x[2] for x in own]


def test_nearest_edges(spark):
    assert ann.nearest(table(spark, [])).collect() == []
    assert ann.nearest(table(spark, [(0, [1.0, 0.0])])).collect() == []
    r = ann.nearest(table(spark, [(0, [1.0, 0.0]), (5, [2.0, 0.1]), (6, [0.0, 0.0])])).collect()
    assert [tuple(x)[:3] for x in r] == [(0, 1, 5)]


def test_probes_come_in_order_and_are_valid():
    order = ann.probe_order(8, 200)
    assert order[0] == () and len(set(order)) == 200
    assert all(len({min(j, 15 - j) for j in s}) == len(s) for s in order)


def test_recall_on_the_table(spark):
    from conftest import SF

    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in t.collect()}
    want = {q: s for q, n, _, s in best(vectors, 20, lambda a, b: float(a @ b)) if n == 20}
    got = ann.nearest(t).collect()
    assert sum(r["score"] >= want[r["query_id"]] - 1e-12 for r in got) >= 0.9 * 20 * len(want)


def uneven(kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    norm = {"one outlier": np.where(np.arange(1500) == 777, 100.0, 1.0), "sigma 1": rng.lognormal(0, 1, 1500), "sigma 2": rng.lognormal(0, 2, 1500)}[kind]
    return [(i, [float(c) for c in row]) for i, row in enumerate((x * norm[:, None]).astype(np.float32))]


@pytest.mark.parametrize("kind", ["one outlier", "sigma 1", "sigma 2"])
def test_nearest_of_uneven_norms_are_found_and_complete(spark, kind):
    rows = uneven(kind)
    vectors = {i: np.array(e, np.float64) for i, e in rows}
    least = {q: s for q, n, _, s in best(vectors, 20, lambda a, b: float(a @ b)) if n == 20}
    got = ann.nearest(table(spark, rows)).collect()
    assert Counter(r["query_id"] for r in got) == dict.fromkeys(least, 20)
    assert sum(r["score"] >= least[r["query_id"]] - 1e-9 for r in got) >= 0.9 * len(got)


def test_a_query_whose_cells_are_empty_goes_on(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [1.0 + 0.01 * float(rng.normal())] + [0.01 * float(c) for c in rng.normal(size=15)]) for i in range(1, 400) if i % 20]
    rows.append((0, [-1.0] + [0.0] * 15))
    got = ann.nearest(table(spark, rows), tables=1, probes=1).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 21))
