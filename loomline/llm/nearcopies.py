"""Near copies by a chosen-path set similarity join.

Texts are sets of word shingles, sketched by 64 minwise tokens. Equal sets are
one class. In every tree a node sends its classes on by a few chosen
coordinates: those with the same minwise token there meet in a child. Small
nodes are compared exhaustively. Independent trees are repeated until a pair at
the threshold meets with the target probability.

A large node first compares all its classes with one pivot. By the triangle
inequality of the Jaccard distance, whatever links with a class lies about as
near to the pivot as that class; so the ball around the pivot becomes one
candidate cluster, the classes near its middle are done with, and only the
rest are branched on. A group of copies of any size thus takes linear work.

Sketches only propose clusters. Links are confirmed on full sets: inside
chunks of a cluster that all hold a common member, and then between what is
not yet connected and every chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import LOWER, give_back, lean_memory, mix, pieces, some_texts, text_buffer, window_hashes, word_hashes, words_of, written

lean_memory()

TOKENS = 64
#: Classes compared exhaustively at once; documents whose full sets are compared at once.
NODE, CHUNK = 512, 128
PIECE_BYTES = 1 << 20
#: Levels after which a large node is compared in blocks of NODE classes.
DEPTH = 10

_SEEDS = np.random.default_rng(11).integers(0, 2**32, (2, TOKENS), np.uint32)
_SEEDS[1] |= 1

_SKETCH = "doc_id long, text_key long, n_shingles long, class_id long, sketch binary"


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's shingles; a text with fewer words is one shingle, without words none."""
    for (some,) in some_texts(column):
        buf, at = text_buffer(some)
        for i, j in pieces(at, PIECE_BYTES):
            part, ends = LOWER[buf[at[i] : at[j]]], at[i : j + 1] - at[i]
            start, end, first = words_of(part, ends)
            words = word_hashes(part, start, end)
            for k in range(j - i):
                own = words[first[k] : first[k + 1]]
                if len(own) >= size:
                    yield np.unique(window_hashes(own, size))
                else:
                    yield window_hashes(own, len(own)) if len(own) else np.zeros(0, np.uint64)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of TOKENS hash functions over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(TOKENS, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 4096):
        h = (x[i : i + 4096, None] ^ _SEEDS[0]) * _SEEDS[1]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        np.minimum(least, h.min(axis=0), out=least)
    return least


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, sketch = [], [], []
            for s in shingle_sets(b.column("text"), size):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    own = int(mix(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else None
                cls.append(own)
                sketch.append(minwise(s).tobytes() if len(s) else None)
            yield pa.record_batch([
                b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketch, pa.binary()),
            ], names=["doc_id", "text_key", "n_shingles", "class_id", "sketch"])
        give_back()

    return run


def _labels(linked: np.ndarray) -> np.ndarray:
    """The first member of each connected component of a small symmetric relation."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _edges_of(ids: np.ndarray, linked: np.ndarray) -> pa.Table:
    """A spanning star of each component."""
    label = _labels(linked)
    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": pa.array(ids[at], pa.int64()), "b": pa.array(ids[label[at]], pa.int64())})


def _tokens(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _exhaustive(least: int):
    def run(table: pa.Table) -> pa.Table:
        ids, sketch = table["class_id"].to_numpy(), _tokens(table["sketch"])
        linked = np.zeros((len(ids), len(ids)), bool)
        for i in range(len(ids)):
            linked[i] = (sketch == sketch[i]).sum(axis=1) >= least
        return _edges_of(ids, linked)

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, TOKENS) for c in ("sketch", "pivot_sketch"))
        yield pa.record_batch(
            [b.column("node"), b.column("class_id"), b.column("pivot"), b.column("sketch"), pa.array((x == y).sum(axis=1), pa.int32())],
            names=["node", "class_id", "pivot", "sketch", "agree"],
        )


def _children(rows: DataFrame, branch: int) -> DataFrame:
    """``(node, n, class_id)`` of the children that hold two classes or more."""

    def child(j: int):
        coord = F.pmod(F.xxhash64("node", F.lit(j)), F.lit(TOKENS)).cast("int")
        return F.xxhash64("node", F.lit(j), coord, F.substring("sketch", coord * 4 + 1, F.lit(4)))

    keyed = rows.select("class_id", F.explode(F.array(*(child(j) for j in range(branch)))).alias("node"))
    counts = keyed.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(counts, "node")


def connected(edges: DataFrame) -> DataFrame:
    """``(id, label)``: the smallest id reachable over ``(a, b)``, for every id of an edge.

    Large-star and small-star steps in turn; each round is written, so a lost
    executor costs a re-read, and rounds grow with the logarithm of the longest
    path.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        new = written(small, "components")
        same = new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = new
        if same:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def candidate_edges(classes: DataFrame, percent: int, recall: float, branch: int) -> DataFrame:
    """Edges whose components hold together every pair that may be linked."""
    s = percent / 100
    least = math.floor(TOKENS * (s - 5 * math.sqrt(s * (1 - s) / TOKENS)))
    inner, ball = math.ceil(TOKENS * 0.6), math.floor(TOKENS * (0.6 - (1 - s) - 0.2))
    trees = max(1, math.ceil(math.log(1 - recall) / math.log((1 - s) ** branch)))
    rows = classes.select("class_id", "sketch", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(trees).cast("long"))).alias("node"))
    edges: list[DataFrame] = []
    for level in range(DEPTH + 1):
        nodes = _children(rows.select("node", "class_id", "sketch"), branch)
        members = written(nodes.join(classes, "class_id").select("node", "n", "class_id", "sketch"), "chosen-paths")
        whole = F.col("n") <= NODE if level < DEPTH else F.lit(True)
        # a small node is one block; at the last level large ones are compared in pairs of blocks
        parts = F.ceil(F.col("n") / NODE).cast("int")
        own = F.pmod(F.xxhash64("class_id"), parts).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
        dealt = members.where(whole).withColumn("parts", parts).withColumn("own", own).select("node", "class_id", "sketch", F.explode(pairs).alias("pair"))
        edges.append(dealt.groupBy("node", "pair").applyInArrow(_exhaustive(least), "a long, b long"))
        large = members.where(~whole)
        if large.isEmpty():
            break
        pivots = large.groupBy("node").agg(F.min_by(F.struct("class_id", "sketch"), F.xxhash64("class_id", "node")).alias("p"))
        met = (
            large.join(pivots, "node")
            .select("node", "class_id", "sketch", F.col("p.class_id").alias("pivot"), F.col("p.sketch").alias("pivot_sketch"))
            .mapInArrow(_agreement, "node long, class_id long, pivot long, sketch binary, agree int")
        )
        met = written(met, "chosen-paths")
        edges.append(met.where(F.col("agree") >= ball).select(F.col("class_id").alias("a"), F.col("pivot").alias("b")))
        rows = met.where((F.col("agree") < inner) & (F.col("class_id") != F.col("pivot")))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.tobytes() for s in shingle_sets(b.column("text"), size)]
            yield pa.record_batch([b.column("class_id"), b.column("cluster"), pa.array(sets, pa.binary())], names=["class_id", "cluster", "full"])
        give_back()

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs, from the shingles that two sets or more hold."""
    n = len(sets)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    owner, group = owner[often], group[often]
    _, column = np.unique(group, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    for a in range(0, width, 8192):
        i, j = np.searchsorted(column, [a, a + 8192])
        m = np.zeros((n, min(8192, width - a)), np.float32)
        m[owner[i:j], column[i:j] - a] = 1
        out += m @ m.T
    return out


def _linked(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    sets = [np.frombuffer(x, np.uint64) for x in table["full"].to_pylist()]
    both = _shared(sets).astype(np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    return table["class_id"].to_numpy(), 100 * both >= percent * (size[:, None] + size[None, :] - both)


def _confirm(percent: int):
    def run(table: pa.Table) -> pa.Table:
        return _edges_of(*_linked(table, percent))

    return run


def _confirm_across(percent: int):
    """Links between members that have different labels so far."""

    def run(table: pa.Table) -> pa.Table:
        ids, linked = _linked(table, percent)
        label = table["label"].to_numpy()
        _, label = np.unique(label, return_inverse=True)
        a, b = np.nonzero(linked & (label[:, None] < label[None, :]))
        pair = label[a] * (label.max(initial=0) + 1) + label[b]
        _, first = np.unique(pair, return_index=True)  # one link joins two labels
        return pa.table({"a": pa.array(ids[a[first]], pa.int64()), "b": pa.array(ids[b[first]], pa.int64())})

    return run


def confirmed_edges(members: DataFrame, percent: int) -> DataFrame:
    """Of ``(class_id, cluster, full)``, links that connect what full sets connect."""
    size = members.groupBy("cluster").agg(F.count("*").alias("n"), F.min("class_id").alias("pivot"))
    sized = members.join(size, "cluster").withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int"))
    chunk = F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")
    sized = written(sized.withColumn("chunk", chunk), "near-sets")
    pivots = sized.where(F.col("class_id") == F.col("pivot"))
    everywhere = F.when(F.col("class_id") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("chunk"))
    dealt = sized.select("cluster", "class_id", "full", F.explode(everywhere).alias("chunk"))
    inside = written(dealt.groupBy("cluster", "chunk").applyInArrow(_confirm(percent), "a long, b long"), "near-links")
    wide = sized.where("parts > 1")
    if wide.isEmpty():
        return inside
    label = connected(inside)
    wide = wide.join(label, F.col("class_id") == F.col("id"), "left").withColumn("label", F.coalesce("label", "class_id"))
    main = pivots.join(label, F.col("class_id") == F.col("id"), "left").select("cluster", F.coalesce("label", "class_id").alias("main"))
    wide = written(wide.join(main, "cluster").select("cluster", "class_id", "full", "parts", "chunk", "label", (F.col("label") != F.col("main")).alias("apart")), "near-sets")
    rest = wide.where("apart")
    count = rest.groupBy("cluster").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("rows"))
    left = rest.join(count, "cluster").select(
        "cluster", "class_id", "label", "full", F.pmod(F.xxhash64("class_id", F.lit(5)), F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j")
    )
    right = wide.join(count, "cluster").select("cluster", "class_id", "label", "full", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.col("chunk").alias("j"))
    across = left.unionByName(right).groupBy("cluster", "i", "j").applyInArrow(_confirm_across(percent), "a long, b long")
    return inside.unionByName(across)


def near_copies(
    docs: DataFrame, shingle: int = 5, percent: int = 80, recall: float = 0.999999, branch: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row.

    Texts are lower-cased A-Z and cut into words at ASCII white space. Two
    texts are linked if 100 times the size of the intersection of their shingle
    sets is at least ``percent`` times that of the union. ``component_id`` is
    the smallest id reachable, its own included; ``kept`` marks the row that
    bears it. Null and empty texts have no shingles and no links. Rows with a
    null id take part in links; their component is null only if no other id is
    reachable. Repeated rows each get a row. An empty table gives no rows;
    other columns are ignored. A link at the threshold is missed with
    probability 1 - ``recall`` at most; what is linked is confirmed on full sets.
    """
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_key"))
    sketched = written(base.mapInArrow(_sketches(shingle), _SKETCH), "near-sketches")
    classes = (
        sketched.where("class_id IS NOT NULL").groupBy("class_id")
        .agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("sketch").alias("sketch"))
    )
    classes = written(classes, "near-classes")
    clusters = connected(candidate_edges(classes.select("class_id", "sketch"), percent, recall, branch))
    reps = clusters.join(classes, F.col("id") == F.col("class_id")).select(
        "class_id", F.col("label").alias("cluster"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key")
    )
    named = base.join(reps, (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    sets = named.select("class_id", "cluster", "text").mapInArrow(_full_sets(shingle), "class_id long, cluster long, full binary")
    links = connected(confirmed_edges(sets.dropDuplicates(["class_id"]), percent))
    group = classes.join(links, F.col("class_id") == F.col("id"), "left").select("class_id", "first_id", F.coalesce("label", "class_id").alias("group"))
    lowest = group.groupBy("group").agg(F.min("first_id").alias("component_id"))
    component = group.join(lowest, "group").select("class_id", "component_id")
    out = sketched.select("doc_id", "n_shingles", "class_id").join(component, "class_id", "left")
    component_id = F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
