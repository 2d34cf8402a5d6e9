"""Encoding into vocabulary pieces by streaming Viterbi, and decoding.

A text's best segmentation maximises the sum of piece scores. ``Stream``
finds it while it reads: a piece has a bounded length, so only that many end
positions can be continued, and as soon as the backpointer paths of all of
them pass through one boundary, the ids up to it are committed. Its window
does not grow with the text.

No piece goes on after a space that follows other characters, and none holds
a line break; there all paths converge, so what lies between is encoded once
for each task and remembered. Units shorter than the window take the same
recurrence in lock step, one array lane each; longer ones and those with
characters outside the vocabulary are streamed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import give_back, lean_memory, some_texts

lean_memory()

SPACE = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
#: Longest unit that goes through the lanes; distinct units that a task remembers.
LANE, REMEMBERED = 24, 100_000
TEXT_CHARS = 1 << 20


def _fields(data: bytes):
    """Field numbers and values of a protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[i : i + n]
            i += n


class Vocabulary:
    """Pieces with scores, and byte pieces for what no piece covers; read from a model file's bytes."""

    def __init__(self, model: bytes):
        self.score: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        self.surface: list[bytes] = []
        for number, message in _fields(model):
            if number != 1:
                continue
            text, score, kind = "", 0.0, 1
            for n, value in _fields(message):
                if n == 1:
                    text = value.decode()
                elif n == 2:
                    score = float(np.frombuffer(value, "<f4")[0])
                elif n == 3:
                    kind = value
            i = len(self.surface)
            if kind == 6:
                self.byte[int(text[1:-1], 16)] = i
                self.surface.append(bytes([int(text[1:-1], 16)]))
            elif kind in (1, 4):
                self.score[text] = (score, i)
                self.surface.append(text.replace(SPACE, " ").encode())
            else:
                self.surface.append(b"")
        self.longest = max(map(len, self.score), default=1)
        self.unknown = min((s for s, _ in self.score.values()), default=0.0) - 10
        inner = [s for t, (s, _) in self.score.items() if SPACE in t.lstrip(SPACE) or "\n" in t]
        if inner:
            raise ValueError("a piece goes on after a space or holds a line break")
        #: Runs of spaces form pieces of their own only if that can pay.
        one = self.score.get(SPACE, (self.unknown, 0))[0]
        self.joined_spaces = any(len(t) > 1 and t.startswith(SPACE * 2) and s > 2 * self.longest * min(one, self.ordinary_least()) for t, (s, _) in self.score.items())
        self.table = None

    def ordinary_least(self) -> float:
        """The least score above that of pieces that are never chosen."""
        return min((s for s, _ in self.score.values() if s > -1e8), default=-1.0)

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()]


class Stream:
    """The best segmentation of a stream of characters, committed as it becomes certain.

    Of equal sums the one with the longer last piece wins.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # characters since the last committed boundary
        self.best, self.back, self.root = [0.0], [0], [0]
        self.widest = 1

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        v = self.v
        for c in chars:
            self.text += c
            n = len(self.text)
            top, came = None, n - 1
            for start in range(max(0, n - v.longest), n):
                hit = v.score.get(self.text[start:n])
                if hit:
                    s = self.best[start] + hit[0]
                    if top is None or s > top:
                        top, came = s, start
            if c not in v.score:  # one character outside the vocabulary
                s = self.best[n - 1] + v.unknown
                if top is None or s > top:
                    top, came = s, n - 1
            self.best.append(top)
            self.back.append(came)
            self.root.append(n if came == 0 else self.root[came])
            self.widest = max(self.widest, n + 1)
            first = max(0, n - v.longest + 1)
            # positions from first on can be continued; while all paths to them share their first boundary, it is certain
            while n > 0:
                roots = set(self.root[first:])
                if len(roots) != 1 or 0 in roots:
                    break
                cut = roots.pop()
                out += self._ids(0, cut)
                self._drop(cut)
                n -= cut
                first = max(0, n - v.longest + 1)
        return out

    def _ids(self, start: int, end: int) -> list[int]:
        piece = self.text[start:end]
        hit = self.v.score.get(piece)
        return [hit[1]] if hit else self.v.bytes_of(piece)

    def _drop(self, cut: int) -> None:
        base = self.best[cut]
        self.text = self.text[cut:]
        self.best = [b - base for b in self.best[cut:]]
        self.back = [max(0, b - cut) for b in self.back[cut:]]
        self.root = [0]
        for e in range(1, len(self.back)):
            self.root.append(e if self.back[e] == 0 else self.root[self.back[e]])

    def finish(self) -> list[int]:
        ends, e = [], len(self.text)
        while e > 0:
            ends.append((self.back[e], e))
            e = self.back[e]
        out = [i for a, b in reversed(ends) for i in self._ids(a, b)]
        self.__init__(self.v)
        return out


class Lanes:
    """The same recurrence for many short units of one length at a time."""

    def __init__(self, v: Vocabulary):
        self.v = v
        names = list(v.score)
        self.scores = np.array([v.score[t][0] for t in names] + [-np.inf])
        self.ids = np.array([v.score[t][1] for t in names] + [0], np.int32)
        self.keys = np.array([self._hash(t) for t in names] + [0], np.uint64)
        self.slots = [np.full(1 << 20, len(names), np.int32) for _ in range(2)]
        a, b = self._slot(self.keys[:-1])
        self.slots[0][a[::-1]] = np.arange(len(names))[::-1]
        left = np.flatnonzero(self.slots[0][a] != np.arange(len(names)))
        self.slots[1][b[left]] = left
        if (self.slots[1][b[left]] != left).any() or len(set(self.keys.tolist())) != len(self.keys):
            raise ValueError("pieces share a hash")
        self.alone = {t for t in v.score if len(t) == 1}

    @staticmethod
    def _slot(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = h ^ (h >> np.uint64(32))
        m = m * np.uint64(0xD6E8FEB86659FD93)
        return (m >> np.uint64(44)).astype(np.int64), ((m >> np.uint64(20)) & np.uint64((1 << 20) - 1)).astype(np.int64)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_P) + ord(c) + 1) % 2**64
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        a, b = self._slot(h)
        at = self.slots[0][a]
        miss = np.flatnonzero(self.keys[at] != h)
        second = self.slots[1][b[miss]]
        none = len(self.keys) - 1
        at[miss] = np.where((self.keys[second] == h[miss]) & (second < none), second, none)
        return at

    def encode(self, units: list[str]) -> list[np.ndarray]:
        """Ids of units that consist of single-character pieces and are of one length."""
        size, n = len(units[0]), len(units)
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(n, size).astype(np.uint64)
        prefix = np.zeros((size + 1, n), np.uint64)
        for j in range(size):
            prefix[j + 1] = prefix[j] * _P + chars[:, j] + np.uint64(1)
        powers = np.array([pow(int(_P), j, 2**64) for j in range(size + 1)], np.uint64)
        best = np.zeros((size + 1, n))
        back, piece = np.zeros((size + 1, n), np.int64), np.zeros((size + 1, n), np.int32)
        for e in range(1, size + 1):
            best[e] = -np.inf
            for start in range(max(0, e - self.v.longest), e):
                at = self._find(prefix[e] - prefix[start] * powers[e - start])
                s = best[start] + self.scores[at]
                better = s > best[e]
                best[e][better] = s[better]
                back[e][better] = start
                piece[e][better] = self.ids[at[better]]
        out = np.zeros((n, size), np.int32)
        count, e = np.zeros(n, np.int64), np.full(n, size)
        lane = np.arange(n)
        while True:
            live = lane[e > 0]
            if not len(live):
                break
            count[live] += 1
            out[live, size - count[live]] = piece[e[live], live]
            e[live] = back[e[live], live]
        return [out[i, size - count[i] :] for i in range(n)]


class Encoder:
    """Encodes texts unit by unit and remembers a bounded number of units."""

    def __init__(self, model: bytes):
        self.v = Vocabulary(model)
        self.lanes = Lanes(self.v)
        self._forget()

    def _forget(self) -> None:
        self.spaced: dict[str, int] = {}  # words after a space
        self.plain: dict[str, int] = {}  # units as they are
        self.flat = np.zeros(0, np.int32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def one(self, unit: str) -> list[int]:
        stream = Stream(self.v)
        out: list[int] = []
        for i in range(0, len(unit), 4096):
            out += stream.feed(unit[i : i + 4096])
        return out + stream.finish()

    def _learn(self, new: list[tuple[bool, str]]) -> None:
        """Ids of new units; a literal space mark is spelled in bytes so that decoding gives it back."""
        ids: list[np.ndarray | None] = [None] * len(new)
        by_length: dict[int, list[int]] = {}
        for k, (spaced, w) in enumerate(new):
            size = len(w) + spaced
            if 0 < size <= LANE and SPACE not in w and all(c in self.lanes.alone for c in w) and (not spaced or SPACE in self.lanes.alone):
                by_length.setdefault(size, []).append(k)
            else:
                parts = []
                for i, part in enumerate(w.split(SPACE)):
                    if i:
                        parts.append(np.array(self.v.bytes_of(SPACE), np.int32))
                    if i == 0 and spaced:
                        part = SPACE + part
                    if part:
                        parts.append(np.array(self.one(part.replace(" ", SPACE)), np.int32))
                ids[k] = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        for own in by_length.values():
            for a in range(0, len(own), 50_000):
                some = own[a : a + 50_000]
                for k, x in zip(some, self.lanes.encode([SPACE * new[k][0] + new[k][1] for k in some]), strict=True):
                    ids[k] = x
        lengths = np.array([len(x) for x in ids], np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)])
        self.length = np.concatenate([self.length, lengths])
        self.flat = np.concatenate([self.flat, *ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and where each text's ids begin and end."""
        if len(self.spaced) + len(self.plain) > REMEMBERED:
            self._forget()
        new: list[tuple[bool, str]] = []
        spaced, plain = self.spaced, self.plain
        place, ends = [], [0]

        def known(book: dict[str, int], flag: bool, w: str) -> int:
            at = book.get(w)
            if at is None:
                at = book[w] = len(self.start) + len(new)
                new.append((flag, w))
            return at

        for text in texts:
            if text:
                for i, line in enumerate(text.split("\n")):
                    words = line.split(" ")
                    if i:
                        place.append(known(plain, False, "\n"))
                        if words[0]:
                            place.append(known(plain, False, words[0]))
                        words = words[1:]
                    if self.v.joined_spaces and "" in words:
                        run = 0
                        for w in words:
                            run += 1
                            if w:
                                place.append(known(plain, False, " " * run + w) if run > 1 else known(spaced, True, w))
                                run = 0
                        if run:
                            place.append(known(plain, False, " " * run))
                        continue
                    at = list(map(spaced.get, words))
                    if None in at:
                        at = [known(spaced, True, w) if x is None else x for x, w in zip(at, words, strict=True)]
                    place += at
            ends.append(len(place))
        if new:
            self._learn(new)
        at = np.array(place, np.int64)
        n = self.length[at]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.flat[np.repeat(self.start[at] - total[:-1], n) + np.arange(total[-1])]
        return out, total[np.array(ends)]

    def decode(self, ids) -> str:
        """The text; bytes that are not UTF-8 become the replacement character."""
        text = b"".join(map(self.v.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_ENCODED = "struct<ids:array<int>,round_trip:boolean>"


def _encoded_batch(encoder: Encoder, column: pa.Array) -> pa.Array:
    values, offsets, same = [], [0], []
    for (part,) in some_texts(column):
        texts = [t or "" for t in part.to_pylist()]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < TEXT_CHARS):
                size += len(texts[j])
                j += 1
            some = texts[i:j]
            ids, place = encoder.encode(some)
            same += [encoder.decode(ids[a:b].tolist()) == t for t, a, b in zip(some, place[:-1], place[1:], strict=True)]
            values.append(ids)
            offsets += (place[1:] + offsets[-1]).tolist()
            i = j
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
    return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "round_trip"])


def encoded(text: str | Column, model: bytes) -> Column:
    """``ids`` of each text, and whether decoding them gives the text back; a null text is empty.

    The encoder lives as long as its task, so idle workers hold no memory.
    """

    @F.arrow_udf(_ENCODED)
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(model)
        for column in columns:
            yield _encoded_batch(encoder, column)
        encoder = column = None
        give_back()

    return encode(text)


def decoded(ids: str | Column, model: bytes) -> Column:
    @F.arrow_udf("string")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(model)
        for column in columns:
            yield pa.array([None if x is None else encoder.decode(x) for x in column.to_pylist()], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, model_path: str = "/opt/tokenizers/piece_bpe_32k.model", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_ids, round_trip, ids)`` for every row; repeated rows each, other columns ignored, an empty table gives no rows."""
    with open(model_path, "rb") as f:
        model = f.read()
    out = docs.select(F.col(key).cast("long").alias("doc_id"), encoded(F.col(text), model).alias("e"))
    return out.select("doc_id", F.size("e.ids").cast("long").alias("n_ids"), "e.round_trip", "e.ids")
