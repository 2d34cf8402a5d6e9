"""Repeated passages by difference-cover anchors.

A window is ``window`` consecutive words of a document. COVER is a set of
residues modulo PERIOD whose differences give every residue, so for any two
positions i and j some shift below PERIOD moves both onto cover positions. Two
equal windows therefore share an anchor, the ``window - PERIOD + 1`` words at
such a position, and it is enough to hash those: 5 of 21 positions.

1. Anchors are hashed at cover positions only and dealt by hash. Those that
   occur once are done with.
2. Around each repeated anchor the match is extended: the windows that hold it
   are hashed in full (128 bits) and dealt by hash.
3. Windows that occur again remove their words.

Hashes travel as packed arrays, at most two of a kind from one block of
documents, so a passage that a third of all documents share stays small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import discard, n_blocks, pieces, row_key, some_texts, text_buffer, text_bytes, window_hashes, word_hashes, words_of, written

#: A perfect difference set modulo 21.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
BLOCK_BYTES = 8 << 20
#: Bytes of text whose hashes are packed together, and worked on at once.
PACK_BYTES, PIECE_BYTES = 16 << 20, 2 << 20

_PACKED = "bucket int, blocks binary, h1 binary, h2 binary"
_FOUND = "b int, d1 binary, d2 binary"


def _anchors(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions of one document and the anchors there."""
    every = window_hashes(hashes, length)
    at = np.flatnonzero(_IN_COVER[np.arange(len(every)) % PERIOD])
    return at, every[at]


_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True


def _at_most_two(h1: np.ndarray, h2: np.ndarray, block: np.ndarray):
    """Of equal hashes of one block the first two: enough to tell that they repeat."""
    order = np.lexsort((block, h2, h1))
    h1, h2, block = h1[order], h2[order], block[order]
    if len(h1) > 2:
        same = (h1[2:] == h1[:-2]) & (h2[2:] == h2[:-2]) & (block[2:] == block[:-2])
        keep = np.concatenate([[True, True], ~same])
        h1, h2, block = h1[keep], h2[keep], block[keep]
    return h1, h2, block


def _pack(h1: np.ndarray, h2: np.ndarray, block: np.ndarray, buckets: int, wide: bool) -> dict[str, list]:
    """A row for each bucket; buckets are ranges of the first hash, which is sorted."""
    h1, h2, block = _at_most_two(h1, h2, block)
    bucket = ((h1 >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    out: dict[str, list] = {"bucket": [], "blocks": [], "h1": [], "h2": []}
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        out["bucket"].append(int(bucket[a]))
        out["blocks"].append(block[a:b].astype(np.int32).tobytes())
        out["h1"].append(h1[a:b].tobytes())
        out["h2"].append(h2[a:b].tobytes() if wide else b"")
    return out


def _join(column: pa.ChunkedArray, kind) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket, the hashes that occur twice or more, for each block that has them."""
    h1, block = _join(table["h1"], np.uint64), _join(table["blocks"], np.int32)
    h2 = _join(table["h2"], np.uint64)
    h2 = h2 if len(h2) == len(h1) else np.zeros(len(h1), np.uint64)
    order = np.lexsort((block, h2, h1))
    h1, h2, block = h1[order], h2[order], block[order]
    same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    twice = np.zeros(len(h1), bool)
    twice[1:] |= same
    twice[:-1] |= same
    h1, h2, block = h1[twice], h2[twice], block[twice]
    order = np.argsort(block, kind="stable")
    h1, h2, block = h1[order], h2[order], block[order]
    out: dict[str, list] = {"b": [], "d1": [], "d2": []}
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        x1, x2 = h1[a:b], h2[a:b]
        new = np.concatenate([[True], (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1])])
        out["b"].append(int(block[a]))
        out["d1"].append(x1[new].tobytes())
        out["d2"].append(x2[new].tobytes())
    return pa.table({"b": pa.array(out["b"], pa.int32()), "d1": pa.array(out["d1"], pa.binary()), "d2": pa.array(out["d2"], pa.binary())})


def _packed_table(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = (("bucket", pa.int32()), ("blocks", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary()))
    return pa.record_batch([pa.array(rows[n], k) for n, k in kinds], names=[n for n, _ in kinds])


def _scan_anchors(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, blocks, size = [], [], 0

        def flush():
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            b = np.concatenate(blocks) if blocks else np.zeros(0, np.int32)
            hashes.clear()
            blocks.clear()
            return _packed_table(_pack(h, np.zeros(len(h), np.uint64), b, buckets, False))

        for some, blocks_ in (x for b in batches for x in some_texts(b.column("text"), b.column("block"))):
            buf, at = text_buffer(some)
            block = blocks_.to_numpy(zero_copy_only=False)
            for i, j in pieces(at, PIECE_BYTES):
                part, ends = buf[at[i] : at[j]], at[i : j + 1] - at[i]
                start, end, first = words_of(part, ends)
                words = word_hashes(part, start, end)
                for k in range(j - i):
                    _, h = _anchors(words[first[k] : first[k + 1]], length)
                    if len(h):
                        hashes.append(h)
                        blocks.append(np.full(len(h), block[i + k], np.int32))
                size += len(part)
                if size >= PACK_BYTES:
                    yield flush()
                    size = 0
        if hashes:
            yield flush()

    return run


def _sorted_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    h1, h2 = _join(table["d1"], np.uint64), _join(table["d2"], np.uint64)
    order = np.argsort(h1, kind="stable")
    return h1[order], h2[order]


def _among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


#: Two 64-bit hashes as one number to compare by: the first decides, the second is folded in.
def _fold(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    both = np.empty(len(h1), dtype=[("a", np.uint64), ("b", np.uint64)])
    both["a"], both["b"] = h1, h2
    return both


def _among_both(keys: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership by both hashes; keys sorted by them."""
    if not len(keys) or not len(h1):
        return np.zeros(len(h1), bool)
    lo = np.searchsorted(keys["a"], h1, "left")
    hi = np.searchsorted(keys["a"], h1, "right")
    found = np.zeros(len(h1), bool)
    for step in range(int((hi - lo).max(initial=0))):
        at = lo + step
        found |= (at < hi) & (keys["b"][np.minimum(at, len(keys) - 1)] == h2)
    return found


def _kept(text: str | None, removed: np.ndarray | None) -> str:
    words = (text or "").encode().split()
    if removed is not None:
        words = [w for w, r in zip(words, removed, strict=True) if not r]
    return hashlib.sha256(b" ".join(words)).hexdigest()


_STEP = "kind string, block int, doc_id long, text string, n_words long, kept_sha256 string, starts binary, bucket int, blocks binary, h1 binary, h2 binary"
_STEP_SCHEMA = pa.schema([
    ("kind", pa.string()), ("block", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("kept_sha256", pa.string()),
    ("starts", pa.binary()), ("bucket", pa.int32()), ("blocks", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary()),
])


def _extend(window: int, length: int, buckets: int):
    """Documents of one block with its repeated anchors: finished ones, those with windows to settle, and these windows."""

    def run(key, docs: pa.Table, anchors: pa.Table) -> pa.Table:
        keys, _ = _sorted_keys(anchors)
        rows: list[dict] = []
        h1s, h2s = [], []
        if not len(docs):
            return pa.Table.from_pylist(rows, _STEP_SCHEMA)
        block = docs["block"][0].as_py()
        ids, texts = docs["doc_id"].to_pylist(), docs["text"].combine_chunks()
        buf, at = text_buffer(texts)
        for i, j in pieces(at, PIECE_BYTES):
            part, ends = buf[at[i] : at[j]], at[i : j + 1] - at[i]
            start, end, first = words_of(part, ends)
            words = word_hashes(part, start, end)
            for k in range(j - i):
                own = words[first[k] : first[k + 1]]
                n, text = len(own), texts[i + k].as_py()
                windows = n - window + 1
                cand = np.zeros(0, np.int64)
                if windows > 0 and len(keys):
                    pos, h = _anchors(own, length)
                    pos = pos[_among(keys, h)]
                    if len(pos):
                        step = np.zeros(windows + 1, np.int32)
                        np.add.at(step, np.clip(pos - (window - length), 0, windows), 1)
                        np.add.at(step, np.clip(pos + 1, 0, windows), -1)
                        cand = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                row = {"kind": "done", "block": block, "doc_id": ids[i + k], "n_words": n}
                if len(cand):
                    h1s.append(window_hashes(own, window, 1)[cand])
                    h2s.append(window_hashes(own, window, 2)[cand])
                    rows.append(row | {"kind": "open", "text": text, "starts": cand.astype(np.int32).tobytes()})
                else:
                    rows.append(row | {"kept_sha256": _kept(text, None)})
        if h1s:
            h1, h2 = np.concatenate(h1s), np.concatenate(h2s)
            packed = _pack(h1, h2, np.full(len(h1), block, np.int32), buckets, True)
            rows += [{"kind": "windows", "block": block} | dict(zip(packed, x, strict=True)) for x in zip(*packed.values(), strict=True)]
        return pa.Table.from_pylist(rows, _STEP_SCHEMA)

    return run


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _settle(window: int):
    def run(key, docs: pa.Table, repeated: pa.Table) -> pa.Table:
        keys = np.sort(_fold(_join(repeated["d1"], np.uint64), _join(repeated["d2"], np.uint64)))
        rows = []
        for x in docs.select(["doc_id", "text", "starts"]).to_batches(max_chunksize=64):
            for doc_id, text, starts in zip(*(c.to_pylist() for c in x.columns), strict=True):
                buf, at = text_buffer(pa.array([text], pa.string()))
                start, end, _ = words_of(buf, at)
                own, cand = word_hashes(buf, start, end), np.frombuffer(starts, np.int32)
                twice = _among_both(keys, window_hashes(own, window, 1)[cand], window_hashes(own, window, 2)[cand])
                step = np.zeros(len(own) + 1, np.int32)
                step[cand[twice]] += 1
                step[cand[twice] + window] -= 1
                removed = np.cumsum(step[:-1]) > 0
                rows.append({"doc_id": doc_id, "n_words": len(own), "n_removed": int(removed.sum()), "kept_sha256": _kept(text, removed)})
        return pa.Table.from_pylist(rows, _RESULT_SCHEMA)

    return run


def remove_repeats(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row.

    A word goes if a window that covers it, by the same words in the same
    order, also starts elsewhere in the table, in the same row included.
    Windows are judged on the input. Words are unchanged runs of anything but
    ASCII white space; hashes of 64 bits choose what is looked at, 128 bits
    decide. A null text has no words. Repeated rows count as separate
    documents. An empty table gives no rows; other columns are ignored.
    """
    if window < PERIOD:
        raise ValueError(f"window must have at least {PERIOD} words")
    length = window - PERIOD + 1
    blocks = n_blocks(text_bytes(docs, text), BLOCK_BYTES)
    buckets = max(16, blocks // 2)
    base = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.pmod(row_key(key, text), F.lit(blocks)).cast("int").alias("block")
    )

    def repeated(packed: DataFrame) -> DataFrame:
        return packed.groupBy("bucket").applyInArrow(_repeated, _FOUND)

    anchors = base.select("text", "block").mapInArrow(_scan_anchors(length, buckets), _PACKED)
    step = base.groupBy("block").cogroup(repeated(anchors).groupBy("b")).applyInArrow(_extend(window, length, buckets), _STEP)
    step = written(step, "substring-windows", by="kind")
    windows = step.where("kind = 'windows'").select("bucket", "blocks", "h1", "h2")
    again = written(repeated(windows), "substring-repeats")
    discard(step, part="kind=windows")
    open_docs = step.where("kind = 'open'").select("block", "doc_id", "text", "starts")
    settled = open_docs.groupBy("block").cogroup(again.groupBy("b")).applyInArrow(_settle(window), _RESULT)
    done = step.where("kind = 'done'").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return done.unionByName(settled)
