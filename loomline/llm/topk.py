"""Exact top-k inner products over partitioned score lists, in three phases.

A vector's components are cut into ``lists`` slices; each slice gives a list
of local scores for a query, and a vector's score is the sum of its local
scores. Vectors lie in blocks; a block holds its part of every list.

1. Every block sends, for each query, the best of each of its local lists
   with their sums. The k-th largest sum over all blocks is a score that at
   least k vectors reach.
2. A vector that reaches it has a local score of at least that sum divided by
   the number of lists in one list or more. This cutoff goes to the blocks
   along with the queries; blocks collect the entries at or above it.
3. For the collected entries, lists that did not send one are bounded by the
   cutoff; what can still reach the sum of phase 1 is resolved exactly.

Queries are a stated set and meet the vectors block by block; a block returns
at most k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import n_blocks, valid_vectors, written

BLOCK, QUERIES = 4096, 256


def integer_parts(v) -> F.Column:
    return F.transform(v, lambda c: F.floor(c * 64).cast("long"))


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles where they are exact, else by long arithmetic."""
    bound = (float(np.abs(q).max(initial=0)) + 1) * (float(np.abs(x).max(initial=0)) + 1) * max(1, q.shape[1])
    if bound < 2**52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def _matrix(table: pa.Table, d: int, key: str = "vec_id", vector: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors, so that the first of equal scores has the smaller id."""
    ids = table[key].to_numpy()
    x = table[vector].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d)
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def _slices(d: int, lists: int) -> list[slice]:
    edge = np.linspace(0, d, min(lists, max(d, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest; of equal ones those that come first."""
    if len(score) <= k:
        return np.argsort(-score, kind="stable")
    least = np.partition(score, len(score) - k)[len(score) - k]
    at = np.flatnonzero(score >= least)
    return at[np.argsort(-score[at], kind="stable")][:k]


_SCORES = "query_id long, score long"
_FOUND = "query_id long, vec_id long, score long"


def _phase_one(d: int, lists: int, k: int):
    def run(key, block: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_s = [], []
        if len(block) and len(queries):
            ids, x = _matrix(block, d)
            qids, q = _matrix(queries, d, "query_id", "q")
            for a in range(0, len(qids), QUERIES):
                qa = q[a : a + QUERIES]
                local = [_product(qa[:, s], x[:, s]) for s in _slices(d, lists)]
                whole = sum(local)
                for i in range(len(qa)):
                    heads = np.unique(np.concatenate([_best(part[i], k + 1) for part in local]))
                    heads = heads[ids[heads] != qids[a + i]]
                    top = np.sort(whole[i, heads])[::-1][:k]
                    out_q.append(np.full(len(top), qids[a + i]))
                    out_s.append(top)
        q_, s_ = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_q, out_s))
        return pa.table({"query_id": pa.array(q_, pa.int64()), "score": pa.array(s_, pa.int64())})

    return run


def _phases_two_three(d: int, lists: int, k: int):
    def run(key, block: pa.Table, queries: pa.Table) -> pa.Table:
        outs = []
        if len(block) and len(queries):
            ids, x = _matrix(block, d)
            order = np.argsort(queries["query_id"].to_numpy(), kind="stable")
            qids, q = _matrix(queries, d, "query_id", "q")
            safe = queries["safe"].to_numpy(zero_copy_only=False)[order]
            cuts = _slices(d, lists)
            for a in range(0, len(qids), QUERIES):
                b = min(a + QUERIES, len(qids))
                reach = safe[a:b, None]
                cutoff = np.ceil(reach / len(cuts))  # integer scores: at least the next whole number
                sent, known, missing = None, 0.0, 0
                for s in cuts:
                    part = _product(q[a:b, s], x[:, s])
                    has = part >= cutoff
                    known = known + np.where(has, part, 0)
                    missing = missing + ~has
                    sent = has if sent is None else sent | has
                with np.errstate(invalid="ignore"):
                    bound = known + np.where(missing > 0, missing * cutoff, 0)
                row, col = np.nonzero(sent & (bound >= reach))
                exact = np.empty(len(row), np.int64)
                for c in range(0, len(row), 1 << 17):
                    w = slice(c, c + (1 << 17))
                    exact[w] = np.einsum("ij,ij->i", q[a + row[w]], x[col[w]])
                keep = (exact >= safe[a + row]) & (ids[col] != qids[a + row])
                row, col, exact = row[keep], col[keep], exact[keep]
                order_ = np.lexsort((col, -exact, row))
                row, col, exact = row[order_], col[order_], exact[order_]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place < k
                outs.append((qids[a + row[keep]], ids[col[keep]], exact[keep]))
        cols = [np.concatenate([o[i] for o in outs]) if outs else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return run


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, lists: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest scores.

    Queries are the rows whose id is divisible by ``every``; candidates are
    all other rows. Score: inner product of floor(64 x). Equal scores: smaller
    id first. A query with fewer than k candidates gets all of them. Rows that
    ``valid_vectors`` leaves out are neither queries nor candidates; an empty
    table gives no rows. Other columns are ignored.
    """
    sound, d = valid_vectors(vectors, key, vector)
    ints = written(sound.select("vec_id", integer_parts(F.col("v")).alias("v")), "topk-vectors")
    blocks = n_blocks(ints.count(), BLOCK)
    base = ints.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    queries = ints.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    sent = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    heads = base.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_phase_one(d, lists, k), _SCORES)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    safe = (
        heads.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
        .groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        .select("query_id", F.when(F.col("n") == k, F.col("least").cast("double")).alias("safe"))
    )
    safe = written(safe, "topk-cutoffs")
    sent = (
        queries.join(safe, "query_id", "left")
        .withColumn("safe", F.coalesce("safe", F.lit(float("-inf"))))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    found = base.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_phases_two_three(d, lists, k), _FOUND)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
