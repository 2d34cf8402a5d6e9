"""Nearest vectors by multi-probe p-stable hashing.

Vectors are taken apart by ranges of their norms: down to half the largest, a
quarter and so on. Those of a range are scaled by its largest norm and given
one more component that makes all norms equal, so that the nearest by distance
have the largest inner product. Every table cuts ``width`` wide cells along ``bits`` Gaussian
directions. A query visits its own cell and, in the order in which they are
expected to hold a neighbour, the cells reached by perturbing the directions
whose borders lie closest. A query that has seen too few rows of a range goes on
down that order, and takes all rows of the range when the order ends.
Candidates of all tables and ranges are merged and ranked by the exact inner
product.

The index is partitioned by row: each block holds the cells of its own rows
for all tables, and the stated query set visits every block. A cell with a
third of all rows is thus spread evenly, and vectors are stored once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import n_blocks, valid_vectors, written

BLOCK, QUERIES = 4096, 256
_FOUND = "query_id long, vec_id long, score double"


def probe_order(bits: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of borders to cross, by increasing expected squared distance.

    Border j is the j-th closest of the 2 * bits borders of a point that lies
    evenly in its cell; borders j and 2 * bits - 1 - j belong to one direction
    and are not crossed both.
    """
    m = bits
    near = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) for j in range(m)]
    far = [1 - (m - j) / (m + 1) + (m - j) * (m - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m)]
    cost = near + far
    queue, out = [(cost[0], (0,))], [()]
    while queue and len(out) < probes:
        _, s = heapq.heappop(queue)
        if len({min(j, 2 * m - 1 - j) for j in s}) == len(s):
            out.append(s)
        if s[-1] + 1 < 2 * m:
            for t in (s[:-1] + (s[-1] + 1,), s + (s[-1] + 1,)):
                heapq.heappush(queue, (sum(cost[j] for j in t), t))
    return out


class Tables:
    """The hash functions; the same in every task."""

    def __init__(self, d: int, tables: int, bits: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.bits, self.width = bits, width
        self.directions = rng.normal(size=(tables, d + 1, bits))
        self.offsets = rng.uniform(0, width, (tables, bits))
        self.names = rng.integers(0, 2**63, (tables, bits), np.int64) | 1

    def _places(self, t: int, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions[t] + self.offsets[t]) / self.width

    def cells(self, t: int, x: np.ndarray) -> np.ndarray:
        return (np.floor(self._places(t, x)).astype(np.int64) * self.names[t]).sum(axis=1)

    def probes(self, t: int, x: np.ndarray, order: list[tuple[int, ...]]) -> np.ndarray:
        place = self._places(t, x)
        low = place - np.floor(place)
        home = (np.floor(place).astype(np.int64) * self.names[t]).sum(axis=1)
        step = np.concatenate([-self.names[t], self.names[t]])  # lower borders, then upper ones
        step = step[np.argsort(np.concatenate([low, 1 - low], axis=1), axis=1, kind="stable")]
        return np.stack([home + step[:, list(s)].sum(axis=1) for s in order], axis=1)


def _data(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by the largest norm of their range, with one more component; the number of the range of each."""
    norm = np.sqrt((x * x).sum(axis=1))
    part = np.unique(np.floor(np.log2(norm.max() / norm)), return_inverse=True)[1]
    largest = np.zeros(part.max() + 1)
    np.maximum.at(largest, part, norm)
    y = x / largest[part][:, None]
    rest = np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))
    return np.concatenate([y, rest[:, None]], axis=1), part


def _asked(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))], axis=1)


def _matrix(table: pa.Table, key: str, vector: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    ids = table[key].to_numpy()
    x = table[vector].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d)
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def _visit(hashed: Tables, cells: list, rows: np.ndarray, asked: np.ndarray, order: list[tuple[int, ...]], seen: np.ndarray, queries: np.ndarray) -> None:
    """Mark in ``seen`` what the queries numbered find in the cells of the rows."""
    for t, (cell, owner) in enumerate(cells):
        wanted = hashed.probes(t, asked[queries], order)
        at = np.minimum(np.searchsorted(cell, wanted), len(cell) - 1)
        visited = np.zeros((len(queries), len(cell)), bool)
        row, col = np.nonzero(cell[at] == wanted)
        visited[row, at[row, col]] = True
        seen[np.ix_(queries, rows)] |= visited[:, owner]


def _closest(queries: np.ndarray, x: np.ndarray, seen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a candidate that may be among its k closest. Only the candidates that a query has seen are
    read and multiplied; what rounding could put among the k stays."""
    row, col = [], []
    for i, q in enumerate(queries):
        some = np.flatnonzero(seen[i])
        if len(some) > k:
            score = x[some] @ q
            least = np.partition(score, len(some) - k)[len(some) - k]
            some = some[score >= least - 1e-9 * (1 + abs(least))]
        row.append(np.full(len(some), i))
        col.append(some)
    return np.concatenate(row), np.concatenate(col)


def _search(d: int, k: int, tables: int, bits: int, width: float, probes: int, seed: int):
    def run(key, block: pa.Table, queries: pa.Table) -> pa.Table:
        outs = []
        if len(block) and len(queries):
            hashed, order = Tables(d, tables, bits, width, seed), probe_order(bits, 3**bits)
            ids, x = _matrix(block, "vec_id", "v", d)
            qids, q = _matrix(queries, "query_id", "q", d)
            data, part = _data(x)
            ranges = []
            for r in range(part.max() + 1):
                rows = np.flatnonzero(part == r)
                ranges.append((rows, [np.unique(hashed.cells(t, data[rows]), return_inverse=True) for t in range(tables)]))
            for a in range(0, len(qids), QUERIES):
                some, named = q[a : a + QUERIES], qids[a : a + QUERIES]
                asked = _asked(some)
                seen = np.zeros((len(some), len(ids)), bool)
                own = named[:, None] == ids[None, :]
                for rows, cells in ranges:
                    left, done, upto = np.arange(len(some)), 0, probes
                    while len(left) and done < len(order) and k < len(rows):
                        _visit(hashed, cells, rows, asked, order[done:upto], seen, left)
                        has = (seen[np.ix_(left, rows)] & ~own[np.ix_(left, rows)]).sum(axis=1)
                        left, done, upto = left[has < k], upto, 4 * upto
                    seen[np.ix_(left, rows)] = True
                row, col = _closest(some, x, seen & ~own, k)
                exact = (some[row] * x[col]).sum(axis=1)
                best = np.lexsort((col, -exact, row))
                row, col, exact = row[best], col[best], exact[best]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                outs.append((named[row[keep]], ids[col[keep]], exact[keep]))
        z = np.zeros(0, np.int64)
        cols = [np.concatenate([o[i] for o in outs]) if outs else z for i in range(3)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, tables: int = 10, bits: int = 8, width: float = 2.0, probes: int = 120, seed: int = 1,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the k nearest found.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    other rows. Nearness and score: inner product of the original vectors in
    double precision; equal scores: smaller id first. All rows are indexed, and
    no cell is capped. Of each range of norms in a block a query sees k rows
    at least, or all, so that it gets k rows if there are as many others. Zero vectors and rows that ``valid_vectors`` leaves out take
    no part. An empty table gives no rows; other columns are ignored.
    """
    sound, d = valid_vectors(vectors, key, vector)
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    sound = written(sound.withColumn("norm2", norm2).where("norm2 > 0"), "ann-vectors")
    blocks = n_blocks(sound.count(), BLOCK)
    base = sound.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    queries = sound.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    sent = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    search = _search(d, k, tables, bits, width, probes, seed)
    found = base.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(search, _FOUND)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
