"""Trie of conversation prefixes, with count-min screening of prefix digests.

A conversation is its turns in order; a node is a distinct sequence of first
turns. Every prefix has a 128-bit digest, a polynomial in the hashes of its
turns, so that prefix states are sums: they are built over sorted ranges of
rows, and a conversation of any length spreads over many tasks.

A count-min sketch of all prefixes never counts too low: where it says one, the
prefix belongs to this conversation alone, and its node is written from the row
itself. Only rows whose prefix may be shared are shuffled, for exact grouping
by depth and digest. False hits of the sketch only cost a shuffled row.

What a node knows of its subtree is a sum over its members. A conversation that
is a node's smallest member is also that of its deeper nodes, so it *owns* the
end of its path from one depth on. Each node has one owner, hence leaves,
children and saved bytes are counted by owners and no path is walked.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import written
from loomline.operators.joins import lookup_join

#: Odd bases of the two halves of a digest.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_M = 2**64 - 1
#: Cells of a row of the sketch at most (8 bytes each while it is counted), rows, and tables it is dealt to.
CELLS, DEPTH, TABLES = 1 << 21, 2, 32
#: Conversation ids that are joined at once.
IDS = 8192

_STATE = "c long, k long, s1 long, s2 long, b long, q1 long, q2 long, qb long"
_MEMBER = "c long, d long, len long, total long, d1 long, d2 long, q1 long, q2 long, b long, qb long"
_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# ---- digests of prefixes -------------------------------------------------


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _turn_hash(role: bytes, text: bytes) -> tuple[int, int]:
    h = hashlib.blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=16)
    return struct.unpack("<QQ", h.digest())


def _local_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix states of the sorted rows of one range, as if each conversation began in it; and of its first and last one, how they end."""
    part = TaskContext.get().partitionId()
    cur = None
    names = ["part", "mark", "c", "k", "s1", "s2", "b", "q1", "q2", "qb"]
    first = state = None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        types = [pa.int32(), pa.bool_()] + [pa.int64()] * 8
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names)

    for rows in batches:
        out = []
        for c, role, text in zip(rows["c"].to_pylist(), rows["role"].to_pylist(), rows["text"].to_pylist(), strict=True):
            if cur != c:
                if first is None and state is not None:
                    first = state
                cur, k, s1, s2, b, p1, p2 = c, 0, 0, 0, 0, 1, 1
            q1, q2, qb = s1, s2, b
            x1, x2 = _turn_hash(role, text)
            k, p1, p2 = k + 1, p1 * BASES[0] & _M, p2 * BASES[1] & _M
            s1, s2, b = (s1 + x1 * p1) & _M, (s2 + x2 * p2) & _M, b + len(text)
            state = (part, True, c, k, _signed(s1), _signed(s2), b, 0, 0, 0)
            out.append((part, False, *state[2:7], _signed(q1), _signed(q2), qb))
        yield batch(out)
    yield batch([x for x in (first, state) if x is not None])


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponent modulo 2**64; negative exponents take the inverse."""
    out = np.ones(len(exponents), np.uint64)
    for sign, b in ((1, base), (-1, pow(base, -1, 2**64))):
        e = np.maximum(exponents * sign, 0).astype(np.uint64)
        while e.any():
            out = np.where(e & np.uint64(1), out * np.uint64(b), out)
            b, e = b * b & _M, e >> np.uint64(1)
    return out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].to_numpy(zero_copy_only=False)


def _u(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64, copy=False).view(np.uint64)


def prefix_states(conversations: DataFrame) -> DataFrame:
    """For every turn: the conversation ``c``, the turn's place ``k`` from 1 on, the digest ``s1, s2`` and the text bytes
    ``b`` of the prefix that ends with it, and ``q1, q2, qb`` of the one before."""
    start = F.left("text", F.lit(64))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = rows.repartitionByRange(F.asc("c"), F.asc_nulls_first("t"), F.asc("role"), start.asc())
    ranges = ranges.sortWithinPartitions(F.asc("c"), F.asc_nulls_first("t"), F.asc("role"), F.asc("text"))
    local = written(
        ranges.select("c", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))
        .mapInArrow(_local_states, f"part int, mark boolean, {_STATE}"), "trie-states")
    states = local.where("NOT mark").drop("mark")
    # Two rows a range at most: its first conversation, where another follows, and its last.
    marks = sorted(local.where("mark").collect(), key=lambda r: (r["part"], r["c"]))
    before: dict[int, tuple] = {}
    last = None  # conversation and state at the end of the ranges so far
    for part in sorted({r["part"] for r in marks}):
        own = [r for r in marks if r["part"] == part]
        head = own[0]
        if last and last[0] == head["c"]:
            before[part] = last
        for r in own:
            n, s1, s2, b = last[1:] if last and last[0] == r["c"] else (0, 0, 0, 0)
            p1, p2 = pow(BASES[0], n, 2**64), pow(BASES[1], n, 2**64)
            last = (r["c"], n + r["k"], (s1 + p1 * (r["s1"] & _M)) & _M, (s2 + p2 * (r["s2"] & _M)) & _M, b + r["b"])
    if not before:
        return states.drop("part")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {n: _column(batch, n).copy() for n in batch.schema.names}
            for part in np.unique(x["part"]):
                if int(part) not in before:
                    continue
                c, n, s1, s2, b = before[int(part)]
                at = np.flatnonzero((x["part"] == part) & (x["c"] == c))
                for name, base, more in (("s1", BASES[0], s1), ("s2", BASES[1], s2), ("q1", BASES[0], s1), ("q2", BASES[1], s2)):
                    x[name][at] = (_u(x[name][at]) * np.uint64(pow(base, n, 2**64)) + np.uint64(more)).view(np.int64)
                x["k"][at] += n
                x["b"][at] += b
                x["qb"][at] += b
            yield pa.RecordBatch.from_arrays([pa.array(x[n], pa.int64()) for n in _STATE.replace(" long", "").split(", ")], _STATE.replace(" long", "").split(", "))

    return states.mapInArrow(moved, _STATE)


# ---- members: (conversation, depth) with the digest of the prefix --------


def plain_members(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the conversations as they are, and ``(c, len, total)``."""
    convs = states.groupBy("c").agg(F.max("k").alias("len"), F.max("b").alias("total"))
    rows = lookup_join(states, convs, "c", "inner")
    return rows.select("c", F.col("k").alias("d"), "len", "total", F.col("s1").alias("d1"), F.col("s2").alias("d2"), "q1", "q2", "b", "qb"), convs


def _moved_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of a conversation's own turns after its first h, put behind m turns of another one."""
    for batch in batches:
        x = {n: _column(batch, n) for n in batch.schema.names}
        out = {n: x[n] for n in ("c", "d", "len", "total", "b", "qb")}
        for base, s, head, own in ((BASES[0], ("s1", "d1"), "m1", "h1"), (BASES[1], ("s2", "d2"), "m2", "h2")):
            p = _powers(base, x["m"] - x["h"])
            out[s[1]] = (_u(x[head]) + p * (_u(x[s[0]]) - _u(x[own]))).view(np.int64)
            q = s[0].replace("s", "q")
            out[q] = (_u(x[head]) + p * (_u(x[q]) - _u(x[own]))).view(np.int64)
        names = _MEMBER.replace(" long", "").split(", ")
        yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.int64()) for n in names], names)


def spliced_members(states: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Members of rebuilt conversations, and ``(c, len, total)``.

    Conversation c begins with the first h turns of c - c % group, h being the
    crc32 of its id modulo ``most``, and goes on with its own after the first h.
    Digests are sums, so they are spliced and no text is read again.
    """
    n = most - 1
    state = F.struct("k", "s1", "s2", "b")
    first = F.sort_array(F.collect_list(F.when(F.col("k") <= n, state)))
    convs = written(states.groupBy("c").agg(F.max("k").alias("n"), F.max("b").alias("own"), first.alias("f")), "trie-convs")
    base = convs.select(F.col("c").alias("base"), F.col("f").alias("bf"), F.col("n").alias("bn"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    with_base = convs.withColumn("base", F.col("c") - F.col("c") % group).withColumn("h", h).join(base, "base", "left")
    m = F.least("h", F.coalesce("bn", F.lit(0)))

    def at(states: str, place: Column, field: str) -> Column:
        return F.when(place > 0, F.element_at(states, F.greatest(place, F.lit(1)).cast("int"))[field]).otherwise(F.lit(0).cast("long"))

    spliced = with_base.withColumn("m", m).withColumn("rest", F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    g = F.least("h", "n")
    spliced = written(spliced.select(
        "c", "h", "m", (F.col("m") + F.col("rest")).alias("len"),
        *(at("bf", F.col("m"), f).alias(a) for f, a in (("s1", "m1"), ("s2", "m2"), ("b", "mb"))),
        *(at("f", g, f).alias(a) for f, a in (("s1", "h1"), ("s2", "h2"), ("b", "hb"))),
        F.when(F.col("m") > 0, F.slice("bf", F.lit(1), F.greatest("m", F.lit(1)).cast("int"))).alias("head"), "own",
    ).withColumn("total", F.col("mb") + F.col("own") - F.col("hb")), "trie-spliced")
    heads = spliced.where("m > 0").select("c", "len", "total", "head", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("i"))
    this = F.element_at("head", F.col("i"))
    heads = heads.select(
        "c", F.col("i").cast("long").alias("d"), "len", "total", this["s1"].alias("d1"), this["s2"].alias("d2"),
        at("head", F.col("i") - 1, "s1").alias("q1"), at("head", F.col("i") - 1, "s2").alias("q2"), this["b"].alias("b"), at("head", F.col("i") - 1, "b").alias("qb"))
    tails = lookup_join(states.where(F.col("k") > h), spliced.drop("head", "own"), "c", "inner")
    tails = tails.select(
        "c", (F.col("k") - F.col("h") + F.col("m")).alias("d"), "len", "total", "h", "m", "m1", "m2", "h1", "h2", "s1", "s2", "q1", "q2",
        (F.col("mb") + F.col("b") - F.col("hb")).alias("b"), (F.col("mb") + F.col("qb") - F.col("hb")).alias("qb"))
    return heads.unionByName(tails.mapInArrow(_moved_tails, _MEMBER)), spliced.select("c", "len", "total")


# ---- count-min screening --------------------------------------------------


def sketch(members: DataFrame, cells: int = CELLS) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each of TABLES parts of the digests the hash factors and, by row, which cells count two or more.

    Counted where the rows are and merged by Spark; about four cells a prefix,
    ``cells`` at most, so the driver receives 32 MB at most.
    """
    width = max(64, min(4 * members.count(), cells) // TABLES)
    counted = members.groupBy(F.pmod("d1", F.lit(TABLES)).alias("t")).agg(
        F.count_min_sketch("d1", F.lit(2.0 / width), F.lit(1 - 0.5**DEPTH), F.lit(17)).alias("s"))
    out: list = [None] * TABLES
    for r in counted.collect():
        out[r["t"]] = read_sketch(bytes(r["s"]))
    return out, width


def read_sketch(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash factors and cells of two or more of a serialised sketch: version, total, depth, width, factors, rows."""
    depth, width = struct.unpack(">ii", data[12:20])
    factors = np.frombuffer(data, ">i8", depth, 20).astype(np.int64)
    cells = np.frombuffer(data, ">i8", depth * width, 20 + 8 * depth).reshape(depth, width)
    return factors, cells >= 2


def is_single(tables: list, digests: np.ndarray) -> np.ndarray:
    """Whether the estimate of each digest is one; every digest is in the sketch."""
    out = np.zeros(len(digests), bool)
    part = digests % TABLES
    for t in np.unique(part):
        at = np.flatnonzero(part == t)
        factors, many = tables[t]
        one = np.zeros(len(at), bool)
        for f, row in zip(factors, many, strict=True):
            h = digests[at] * f
            h = (h + (h >> 32)) & (2**31 - 1)
            one |= ~row[h % row.shape[0]]
        out[at] = one
    return out


def screened(members: DataFrame, cells: int = CELLS) -> DataFrame:
    """Members with ``single``: proved to be the only one of its node; and ``below_single``: so is the prefix before."""
    tables, _ = sketch(members, cells)
    shared = members.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            deeper = _column(b, "d") > 1
            below = np.zeros(b.num_rows, bool)
            below[deeper] = is_single(shared.value, _column(b, "q1")[deeper])
            single = is_single(shared.value, _column(b, "d1"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(single), pa.array(below)], [*b.schema.names, "single", "below_single"])

    return members.mapInArrow(run, f"{_MEMBER}, single boolean, below_single boolean")


# ---- ends -------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted rows, comma-joined for runs of a node."""
    key, ids = None, []

    def out() -> pa.RecordBatch:
        d, d1, d2 = key
        return pa.RecordBatch.from_arrays(
            [pa.array([d], pa.int64()), pa.array([d1], pa.int64()), pa.array([d2], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])],
            ["d", "d1", "d2", "first", "ids"])

    for b in batches:
        for d, d1, d2, c in zip(*(b[n].to_pylist() for n in ("d", "d1", "d2", "c")), strict=True):
            if key != (d, d1, d2) or len(ids) == IDS:
                if ids:
                    yield out()
                key, ids = (d, d1, d2), []
            ids.append(c)
    if ids:
        yield out()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, h = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([h.hexdigest()])], ["d", "d1", "d2", "ends_sha256"])

    for b in batches:
        for d, d1, d2, ids in zip(*(b[n].to_pylist() for n in ("d", "d1", "d2", "ids")), strict=True):
            if key != (d, d1, d2):
                if key:
                    yield out()
                key, h = (d, d1, d2), hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
    if key:
        yield out()


def end_hashes(ends: DataFrame) -> DataFrame:
    """``(d, d1, d2, ends_sha256)`` of ``(d, d1, d2, c)``: ids are joined in sorted ranges, so a node with very many ends
    brings one row for each IDS of them to the task that hashes, which reads them one after another."""
    node = ["d", "d1", "d2"]
    joined = ends.repartitionByRange(*node, "c").sortWithinPartitions(*node, "c").mapInArrow(_chunks, "d long, d1 long, d2 long, first long, ids string")
    return joined.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(_hashes, "d long, d1 long, d2 long, ends_sha256 string")


# ---- the trie -----------------------------------------------------------------


def trie(members: DataFrame, convs: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row a node, of ``members`` and ``convs`` ``(c, len, total)``, the root included."""
    zero, node = F.lit(0).cast("long"), ["d", "d1", "d2"]
    rows = written(screened(written(members, "trie-members"), cells), "trie-screened")
    alone, maybe = rows.where("single").drop("single"), rows.where("NOT single").drop("single", "below_single")
    # Exact nodes of what may be shared. Members of a node agree in q1, q2 and qb.
    nodes = written(
        maybe.groupBy(*node).agg(F.min("c").alias("owner"), F.max("len").alias("longest"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("qb").alias("qb")),
        "trie-nodes")
    owned = nodes.select(F.col("owner").alias("c"), "d", "qb", (F.col("longest") == F.col("d")).alias("leaf"))
    owned = owned.unionByName(alone.select("c", "d", "qb", (F.col("d") == F.col("len")).alias("leaf")))
    # From depth o on a conversation owns its path; ob: text bytes before it.
    owners = written(owned.groupBy("c").agg(F.min("d").alias("o"), F.min("qb").alias("ob"), F.max(F.col("leaf").cast("int")).alias("leaf")), "trie-owners")
    top = convs.agg(F.min("c").alias("c")).first()["c"]
    # Where a path is first owned, the parent belongs to another conversation.
    entry = nodes.select(F.col("owner").alias("c"), "d", "q1", "q2").unionByName(alone.where("NOT below_single").select("c", "d", "q1", "q2"))
    entry = written(
        entry.join(owners.select("c", F.col("o").alias("d")), ["c", "d"]).where("d > 1")
        .select("c", (F.col("d") - 1).alias("d"), F.col("q1").alias("d1"), F.col("q2").alias("d2")), "trie-entries")
    parents = lookup_join(entry, nodes.select(*node, "owner"), node, "inner").select("c", F.col("owner").alias("parent"))
    owners = written(owners.join(parents, "c", "left").withColumn("parent", F.when(F.col("o") == 1, F.lit(top).cast("long")).otherwise(F.col("parent"))), "trie-owners")

    # Sums over members of nodes that may be shared.
    known = lookup_join(maybe, owners, "c", "left")
    o, ob = F.coalesce("o", F.col("len") + 1), F.coalesce("ob", F.col("total"))
    known = known.withColumns({"o": o, "ob": ob, "leaf": F.coalesce(F.col("leaf").cast("long"), zero)})
    ends = F.col("len") == F.col("d")
    shared = known.groupBy(*node).agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max(F.when(F.col("o") == F.col("d"), F.col("parent"))).alias("other"),
        F.count_if((F.col("len") > F.col("d")) & (F.col("o") <= F.col("d") + 1)).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("o") > F.col("d"), F.col("ob") - F.col("qb")).otherwise(zero)).alias("saved_tokens"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    turnless = convs.where("len = 0").select(zero.alias("d"), zero.alias("d1"), zero.alias("d2"), "c")
    hashed = written(end_hashes(maybe.where(ends).select(*node, "c").unionByName(turnless)), "trie-ends")
    shared = shared.join(hashed, node, "left").select(
        "conv_id", F.col("d").alias("depth"), F.coalesce("other", "conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))

    # Nodes of one conversation, from its own rows; only the first of a path asks for its parent.
    def local(frame: DataFrame, parent: Column) -> DataFrame:
        return frame.select(
            F.col("c").alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
            (F.col("len") > F.col("d")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
            F.when(ends, F.sha2(F.col("c").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))

    deep = local(alone.where("below_single"), F.col("c"))
    first = alone.where("NOT below_single").join(owners.select("c", "o", "parent"), "c")
    first = local(first, F.when(F.col("o") == F.col("d"), F.col("parent")).otherwise(F.col("c")))

    whole = convs.join(owners, "c", "left").withColumns({"o": o, "ob": ob, "leaf": F.coalesce(F.col("leaf").cast("long"), zero)})
    root = whole.agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if((F.col("len") > 0) & (F.col("o") == 1)).alias("n_children"),
        F.greatest(F.sum("leaf"), F.lit(1).cast("long")).alias("n_leaves"), F.sum("ob").alias("saved_tokens")).where("n_convs > 0")
    root = root.join(hashed.where("d = 0").select("ends_sha256"), how="left") if not hashed.where("d = 0").isEmpty() else root.withColumn("ends_sha256", nothing)
    root = root.withColumns({"depth": zero, "parent_conv_id": F.lit(None).cast("long")})
    return root.select(*_OUT).unionByName(shared).unionByName(deep).unionByName(first)


def prefix_trie(conversations: DataFrame, cells: int = CELLS) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` of every node.

    ``conversations`` has ``(conv_id, turn, role, text)``; other columns are
    ignored. Turns are ordered by turn (null first), ties by role and text, so
    repeated rows are turns of their own. A null role or text is empty. Rows
    without conv_id belong to no conversation. An empty table has no nodes, not
    even a root.
    """
    members, convs = plain_members(prefix_states(conversations))
    return trie(members, convs, cells)


def rebuilt_trie(conversations: DataFrame, cells: int = CELLS) -> DataFrame:
    """As ``prefix_trie``, over the conversations that ``spliced_members`` rebuilds. Rebuilt ones may be turnless; these end at the root."""
    members, convs = spliced_members(prefix_states(conversations))
    return trie(members, convs, cells)
