"""Repair of conversations by the cheapest edits, with the least audit among equals.

A repaired conversation is an optional system turn and pairs of user and
assistant turns. Edits keep, rerole or delete a row, or insert a turn; where the
repaired text stands decides which role an insert or a rerole gives, so a string
of edit initials stands for one repair. The search goes forward over the rows
and keeps the best string for each of four states.

Strings are nodes of a tree (previous string, last edit), so prefixes are
shared. A node has a rolling hash and links to its ancestors at distances of
powers of two. Two strings of equal cost are compared at the first edit behind
their longest common prefix, which is searched along the links by hashes. Equal
strings are the same node, so a hash that is equal for different nodes is a
collision, and counts as different.

Rows come sorted and are not gathered: where the strings of all live states go
through one node, what precedes it is final and is written out, and the tree
begins anew there. States that cannot win any more are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import written
from loomline.operators.joins import lookup_join

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of edits (fixed values); a truncated row that stays costs TRUNCATED more.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: From any state another one's remaining repair can be had for less than this: two inserts, and a system turn deleted.
SLACK = 2 * INSERT_COST + DELETE_COST
#: Where a kept row of each initial leads from each state.
_KEEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Where a rerole or an insert leads.
_TURN = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
_P, _B = 2**61 - 1, 0x1B873593CC9E2D51 % (2**61 - 1)

_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3


class Strings:
    """Edit strings that share prefixes. Node 0 is the empty string."""

    def __init__(self, hash_of=lambda h, c: (h * _B + ord(c)) % _P):
        self.hash_of = hash_of
        self.up: list[list[int]] = [[]]
        self.edit, self.depth, self.hash = [""], [0], [0]
        self.made: dict[tuple[int, str], int] = {}

    def add(self, node: int, edit: str) -> int:
        """The string of ``node`` and one more edit."""
        new = self.made.get((node, edit))
        if new is None:
            new = self.made[node, edit] = len(self.edit)
            links, j = [node], 0
            while j < len(self.up[links[j]]):
                links.append(self.up[links[j]][j])
                j += 1
            self.up.append(links)
            self.edit.append(edit)
            self.depth.append(self.depth[node] + 1)
            self.hash.append(self.hash_of(self.hash[node], edit))
        return new

    def ancestor(self, node: int, depth: int) -> int:
        rest, j = self.depth[node] - depth, 0
        while rest:
            if rest & 1:
                node = self.up[node][j]
            rest, j = rest >> 1, j + 1
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two strings of one length are equal; equal hashes of different nodes are collisions."""
        return self.hash[a] == self.hash[b] and a == b

    def less(self, a: int, b: int) -> bool:
        """Whether string a precedes string b; neither is a prefix of the other unless they are equal."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for j in range(len(self.up[x]) - 1, -1, -1):
            if j < len(self.up[x]) and not self.same(self.up[x][j], self.up[y][j]):
                x, y = self.up[x][j], self.up[y][j]
        return self.edit[x] < self.edit[y]

    def common(self, nodes: list[int]) -> int:
        """The node that all strings go through last."""
        x = nodes[0]
        for y in nodes[1:]:
            depth = min(self.depth[x], self.depth[y])
            x, y = self.ancestor(x, depth), self.ancestor(y, depth)
            if x != y:
                for j in range(len(self.up[x]) - 1, -1, -1):
                    if j < len(self.up[x]) and self.up[x][j] != self.up[y][j]:
                        x, y = self.up[x][j], self.up[y][j]
                x = self.up[x][0]
        return x

    def text(self, node: int, after: int = 0) -> str:
        """The edits of ``node`` behind its ancestor ``after``."""
        out = []
        while node != after:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


class Repair:
    """The cheapest repair of one conversation whose rows come one by one."""

    #: Rows between two looks at what is final.
    EVERY = 256

    def __init__(self, strings=Strings):
        self.strings = strings
        self.tree = strings()
        self.best: dict[int, tuple[int, int]] = {NOTHING: (0, 0)}
        self.rows: list[tuple[str, str]] = []  # rows that are not final
        self.audit: list[str] = []
        self.cost = 0
        self.state = NOTHING  # behind what is final
        self.hash, self.first = hashlib.sha256(), True
        self.held = 0  # most rows that waited at once
        self._inserts(self.best)

    def _offer(self, to: dict[int, tuple[int, int]], state: int, cost: int, node: int, edit: str) -> None:
        old = to.get(state)
        if old is None or cost < old[0]:
            to[state] = (cost, self.tree.add(node, edit))
        elif cost == old[0]:
            new = self.tree.add(node, edit)
            if new != old[1] and self.tree.less(new, old[1]):
                to[state] = (cost, new)

    def add(self, role: str, text: str, fault: int) -> None:
        self.rows.append((role, text))
        to: dict[int, tuple[int, int]] = {}
        stays = fault not in (_BLANK, _DUPLICATE)
        more = TRUNCATED_COST if fault == _TRUNCATED else 0
        for state, (cost, node) in self.best.items():
            self._offer(to, state, cost + DELETE_COST, node, DELETE)
            if stays:
                kept = _KEEPS.get((state, role[:1]))
                if kept is not None:
                    self._offer(to, kept, cost + more, node, KEEP)
                self._offer(to, _TURN[state], cost + REROLE_COST + more, node, REROLE)
        self._inserts(to)
        least = min(c for c, _ in to.values())
        self.best = {s: x for s, x in to.items() if x[0] <= least + SLACK}
        if len(self.rows) >= self.EVERY and len(self.rows) % self.EVERY == 0:
            self.held = max(self.held, len(self.rows))
            self._settle(self.tree.common([n for _, n in self.best.values()]))

    def _inserts(self, to: dict[int, tuple[int, int]]) -> None:
        for state in (NOTHING, SYSTEM, ASSISTANT, USER):
            if state in to:
                cost, node = to[state]
                self._offer(to, _TURN[state], cost + INSERT_COST, node, INSERT)

    def _settle(self, node: int) -> None:
        """Write out what precedes a node that every live string goes through, and begin the tree there."""
        edits = self.tree.text(node)
        if not edits:
            return
        used = 0
        for e in edits:
            row = None
            if e != INSERT:
                row, used = self.rows[used], used + 1
            if e == DELETE:
                continue
            if e == KEEP:
                self.state, turn = _KEEPS[self.state, row[0][:1]], row
            else:
                self.state = _TURN[self.state]
                turn = (ROLES[self.state], row[1] if row else "")
            self.hash.update(("" if self.first else "\n").encode() + f"{turn[0]}:{turn[1]}".encode())
            self.first = False
        self.rows = self.rows[used:]
        self.audit.append(edits)
        fresh = self.strings()
        moved = {}
        for state, (cost, n) in self.best.items():
            new = 0
            for e in self.tree.text(n, node):
                new = fresh.add(new, e)
            moved[state] = (cost, new)
        self.tree, self.best = fresh, moved

    def finish(self) -> tuple[int, str, str]:
        """Cost, audit and the hash of the repaired text."""
        self._inserts(self.best)
        cost, node = None, None
        for state in (NOTHING, ASSISTANT):
            if state in self.best:
                c, n = self.best[state]
                if cost is None or c < cost or c == cost and self.tree.less(n, node):
                    cost, node = c, n
        self.best = {NOTHING: (cost, node)}
        self._settle(node)
        return cost, "".join(self.audit), self.hash.hexdigest()


# ---- damage and faults ----------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` after the contract's damage: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped,
    emptied, loses its ``.!?``, is repeated, or becomes the user's. Nulls of role and text, and in the name, are one space."""
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"),
        (F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20).alias("what"))
    rows = rows.where("what <> 0").withColumn("times", F.explode(F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("what") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") == 1, F.lit("")).when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"))


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    done: list[tuple] = []
    started, conv, work = False, None, None

    def close() -> None:
        cost, audit, digest = work.finish()
        gaps = high - low + 1 - turns if low is not None else 0
        done.append((conv, gaps, *faults[1:], illegal, cost, audit, digest))

    def out() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) if done else [[]] * len(names)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names)

    for b in batches:
        for c, turn, role, text, blank, again, cut in zip(*(b[n].to_pylist() for n in ("conv_id", "turn", "role", "text", "blank", "again", "cut")), strict=True):
            if not started or c != conv:
                if started:
                    close()
                started, conv, work, before = True, c, Repair(), None
                low = high = last_turn = None
                turns, faults, illegal = 0, [0, 0, 0, 0], 0
            if turn is not None:
                low = turn if low is None else low
                high = turn
                turns += turn != last_turn
                last_turn = turn
            if before is not None and before[1][:1] + role[:1] not in ("su", "ua", "au"):
                illegal += 1
            row = (turn, role, text)
            fault = _BLANK if blank else _DUPLICATE if again or row == before else _TRUNCATED if cut else 0
            faults[fault] += 1
            before = row
            work.add(role, text, fault)
        yield out()
    if started:
        close()
    yield out()


def audited(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation of
    ``(conv_id, turn, role, text)`` without nulls but in conv_id and turn.

    Rows are taken by turn (null first), ties by role and text. A null conv_id
    is a conversation of its own. Rows of a conversation reach one task, since
    the repaired text has one hash; there they pass one by one.
    """
    rows = rows.withColumn("key", F.sha2(F.to_json(F.struct("conv_id", "role", "text"), {"ignoreNullFields": "false"}), 256))
    rows = written(rows, "audit-rows")
    # A row is a duplicate if its role and text have an earlier turn; equal rows of one turn stand side by side.
    first = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("at_null"), F.min("turn").alias("at")).where("n > 1").drop("n")
    marked = lookup_join(rows, first, "key", "left")
    again = F.coalesce(F.when(F.col("turn").isNull(), F.lit(False)).otherwise(F.col("at_null") | (F.col("turn") > F.col("at"))), F.lit(False))
    space = "[\\x20\\x09-\\x0D]"
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    cut = ~F.col("text").rlike(f"[.!?]{space}*\\z")
    marked = marked.select("conv_id", "turn", "role", "text", blank.alias("blank"), again.alias("again"), cut.alias("cut"))
    ordered = marked.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(
        _by_conversation, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def audited_damage(conversations: DataFrame) -> DataFrame:
    """``audited`` after ``damaged``, with every original conversation: one that lost all rows has zeros, no audit, and the
    hash of the empty string. An empty table gives no rows; other columns are ignored."""
    found = audited(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("id", "conv_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
