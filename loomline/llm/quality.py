"""Quality scores by supervised subword embeddings.

A text is the mean of the vectors of its words, of whether a word repeats the
one before it, and of the character n-grams inside words, hashed into a fixed number of rows; a softmax over the mean gives
the class. Vectors and softmax are learned together by stochastic gradient
descent on a bounded sample of labelled rows. For scoring, the softmax is
linear in the mean, so each row is reduced to one number, and the table that
tasks need has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import give_back, lean_memory, pieces, some_texts, text_buffer, word_hashes, words_of, written

lean_memory()

ROWS, DIMENSIONS, NGRAMS = 1 << 18, 16, (3, 4)
PIECE_BYTES = 1 << 20
#: Labelled rows that training takes at most, those with the least hash of their id, and bytes of their texts in all:
#: rows are taken in this order until the next text would exceed them.
SAMPLE, SAMPLE_BYTES = 2500, 16 << 20


def _row(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - (ROWS.bit_length() - 1))).astype(np.int64)


def feature_rows(buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words, word pairs and n-grams, each with the places where the documents' features begin and end.

    Of a pair of words it only counts whether they are the same. n-grams are of bytes, with one space before and after each word, and lie within a word.
    """
    start, end, first = words_of(buf, at)
    words = word_hashes(buf, start, end)
    yield _row(words, 1), first
    docs = len(at) - 1
    pair = np.full(len(words), 1, np.uint64)
    pair[1:] += words[1:] == words[:-1]
    pair[first[:-1][first[:-1] < first[1:]]] = 0
    yield _row(pair, 2), first
    padded = np.full(len(buf) + docs + 1, 0x20, np.uint8)
    padded[np.arange(len(buf)) + np.repeat(np.arange(docs), np.diff(at)) + 1] = buf
    space = (padded == 0x20) | ((padded >= 0x09) & (padded <= 0x0D))
    padded[space] = 0x20
    place = at + np.arange(docs + 1)
    for n in NGRAMS:
        count = len(padded) - n + 1
        if count <= 0:
            yield np.zeros(0, np.int64), np.zeros(docs + 1, np.int64)
            continue
        g = np.zeros(count, np.uint64)
        inside = np.ones(count, bool)
        for j in range(n):
            g = (g << np.uint64(8)) | padded[j : j + count]
            if 0 < j < n - 1:
                inside &= ~space[j : j + count]
        at_ = np.flatnonzero(inside)
        yield _row(g[at_], n), np.searchsorted(at_, place)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and their shares of the mean, for each labelled text."""
    for b in batches:
        rows, shares = [], []
        buf, at = text_buffer(b.column("text"))
        for i in range(len(at) - 1):
            every = [r for r, _ in feature_rows(buf[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))]
            row, count = np.unique(np.concatenate(every), return_counts=True)
            rows.append(row.astype(np.int32).tobytes())
            shares.append((count / max(1, count.sum())).astype(np.float32).tobytes())
        yield pa.record_batch([b.column("label"), pa.array(rows, pa.binary()), pa.array(shares, pa.binary())], names=["label", "rows", "shares"])


class Model:
    """One number a row, and an offset: the logit of class 1 is the mean over a text's features plus the offset."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset = weights.astype(np.float32), float(offset)

    def score(self, column: pa.Array) -> np.ndarray:
        parts = [np.zeros(0)]
        for (some,) in some_texts(column):
            buf, at = text_buffer(some)
            for i, j in pieces(at, PIECE_BYTES):
                total, n = np.zeros(j - i), np.zeros(j - i)
                for row, place in feature_rows(buf[at[i] : at[j]], at[i : j + 1] - at[i]):
                    sums = np.concatenate([[0.0], np.cumsum(self.weights[row], dtype=np.float64)])
                    total += sums[place[1:]] - sums[place[:-1]]
                    n += np.diff(place)
                parts.append(1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.offset))))
        return np.concatenate(parts)

    def column(self, text: str | Column = "text") -> Column:
        score = self.score

        @F.arrow_udf("double")
        def quality(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                yield pa.array(score(column), pa.float64())
            column = None
            give_back()

        return quality(text)


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 4, rate: float = 1.0, seed: int = 3) -> Model:
    """Stochastic gradient descent, one text at a time, with a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (ROWS, DIMENSIONS)).astype(np.float32)
    output, offset = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2)
    if examples:
        share = np.bincount([y for y, _, _ in examples], minlength=2) + 1.0
        offset = np.log(share / share.sum())
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            y, row, weight = examples[i]
            own = vectors[row]
            mean = weight @ own
            z = output @ mean + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - done / steps)
            back = p.astype(np.float32) @ output
            output -= (step * p[:, None] * mean[None, :]).astype(np.float32)
            offset -= 0.1 * step * p
            vectors[row] = own - step * len(row) ** 0.5 * weight[:, None] * back[None, :]
            done += 1
    return Model(vectors @ (output[1] - output[0]), offset[1] - offset[0])


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, held: int = 0,
    key: str = "doc_id", text: str = "text", label: str = "quality", sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Learn ``label`` (0 or 1) from the rows whose crc32 of the id as text modulo ``folds`` is not ``held``.

    At most ``sample`` rows and ``sample_bytes`` of text reach the driver, as
    counts of features. Labels that are null or of a null id are left out; of
    a label or document that is repeated one copy counts, of several texts of
    one id the smallest. Without any, every text scores 0.5.
    """
    ids = F.col(key).cast("long")
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (F.crc32(F.col(key).cast("string")) % folds != held))
    known = known.select(ids.alias("id"), F.col(label).cast("int").alias("label")).distinct().orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    texts = docs.select(ids.alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.join(known, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    found = written(found.withColumn("size", F.octet_length("text").cast("long")), "quality-sample")
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id", "label"))  # of at most ``sample`` rows, without their texts
    chosen = found.select("id", "label", "size").withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("id", "label")
    rows = found.join(chosen, ["id", "label"]).select("label", "text").mapInArrow(_examples, "label int, rows binary, shares binary").collect()
    examples = [(r["label"], np.frombuffer(r["rows"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]
    return train(sorted((e for e in examples if len(e[1])), key=lambda e: (e[0], len(e[1]), e[1].tobytes())))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row.

    ``score`` is the probability of label 1, from the text alone; null and
    empty texts score by the offset. ``predicted`` is 1 from ``threshold`` on.
    A null id counts as the empty text in the choice of held-out rows. Repeated
    rows score alike. An empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, key=key, text=text, **options)
    folds, held = options.get("folds", 5), options.get("held", 0)
    out = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == held
    scored = docs.select(F.col(key).cast("long").alias("doc_id"), out.alias("held_out"), model.column(F.col(text)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
