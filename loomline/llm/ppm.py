"""Language-model scores by prediction by partial matching over bytes.

The trie holds, for every context of up to ``order`` bytes, the symbols that
followed it in training and how often. A symbol is predicted from the longest
context seen in training; one that did not follow it there costs an escape and
is looked for in the next shorter context, where the symbols of the longer one
are excluded. Escapes are estimated by the number of different symbols seen
(method C). Below the empty context all remaining symbols are equally likely.

Symbols seen in a context were also seen in its suffix, so what a context
excludes from the next is one sum per node, and the code length of a symbol
depends only on the ``order + 1`` bytes that end with it. The trie is a set of
tables, one per order; code lengths are found by joins for the byte strings
that occur, and go back to the blocks of documents that hold them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import LOWER, discard, lean_memory, n_blocks, pieces, row_key, text_buffer, text_bytes, written

lean_memory()

#: Bytes that UTF-8 never uses: the start of a text fills contexts, the end is a symbol.
START, END = 0xFF, 0xFE
#: Symbols of the alphabet: all byte values but START.
SYMBOLS = 255
BLOCK_BYTES, PIECE_BYTES = 12 << 20, 1 << 20
#: Texts taken from a block at once.
SOME = 512

_COUNTED = "block int, gram long, word binary, n long"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def grams_of(buf: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and each text's end, the context and symbol as one number; and the texts' places."""
    docs = len(at) - 1
    length = np.diff(at)
    out = np.full(len(buf) + docs * (order + 1), START, np.uint8)
    owner = np.repeat(np.arange(docs), length)
    out[np.arange(len(buf)) + owner * (order + 1) + order] = buf
    out[at[1:] + np.arange(1, docs + 1) * (order + 1) - 1] = END
    g = np.zeros(len(out) - order, np.int64)
    for j in range(order + 1):
        g = (g << 8) | out[j : len(out) - order + j]
    return g[out[order:] != START], at + np.arange(docs + 1)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def _count(order: int):
    """Of one block: its byte strings and words, with the number of times they occur in training texts."""

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        keys, counts, words = [], [], Counter()
        for batch in table.select(["text", "train"]).to_batches(max_chunksize=SOME):
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            buf, at = text_buffer(batch.column("text"))
            for i, j in pieces(at, PIECE_BYTES):
                part, ends = LOWER[buf[at[i] : at[j]]], at[i : j + 1] - at[i]
                g, place = grams_of(part, ends, order)
                taught = np.repeat(train[i:j], np.diff(place))
                u, c = np.unique(g[taught], return_counts=True)
                other = np.unique(g[~taught])
                keys += [u, other]
                counts += [c, np.zeros(len(other), np.int64)]
                whole = part.tobytes()
                for k in range(j - i):
                    own = whole[ends[k] : ends[k + 1]].split()
                    if train[i + k]:
                        words.update(own)
                        words[b""] += 1  # the end
                    else:
                        words.update(dict.fromkeys(own, 0))
            if len(keys) > 8:
                merged = _merge(keys, counts)
                keys, counts = [merged[0]], [merged[1]]
        words.setdefault(b"", 0)
        g, n = _merge(keys, counts)
        grams = pa.table({"block": pa.array(np.full(len(g), block, np.int32)), "gram": g, "word": pa.nulls(len(g), pa.binary()), "n": n})
        said = pa.table({
            "block": pa.array(np.full(len(words), block, np.int32)), "gram": pa.nulls(len(words), pa.int64()),
            "word": pa.array(list(words), pa.binary()), "n": pa.array(list(words.values()), pa.int64()),
        })
        return pa.concat_tables([grams, said])

    return run


def _mask(order: int) -> int:
    return 256 ** (order + 1) - 1


def trie(grams: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Events ``(e, n)`` and contexts ``(c, n, d, x)`` of each order from 0 on, of ``(gram, n)`` with n > 0.

    An event is a context and a symbol. n: occurrences, d: different symbols,
    x: occurrences of these symbols in the next shorter context.
    """
    events = [written(grams.groupBy(F.col("gram").bitwiseAND(F.lit(_mask(j)).cast("long")).alias("e")).agg(F.sum("n").alias("n")), "ppm-events") for j in range(order)]
    events.append(grams.select(F.col("gram").alias("e"), "n"))
    contexts = []
    for j in range(order + 1):
        own = events[j].select(F.shiftright("e", 8).alias("c"), F.col("e").bitwiseAND(F.lit(_mask(max(j - 1, 0))).cast("long")).alias("shorter"), "n")
        if j:
            own = own.join(events[j - 1].select(F.col("e").alias("shorter"), F.col("n").alias("m")), "shorter")
        else:
            own = own.withColumn("m", F.lit(0).cast("long"))
        contexts.append(own.groupBy("c").agg(F.sum("n").alias("c_n"), F.count("*").alias("c_d"), F.sum("m").alias("c_x")))
    return events, contexts


def code_lengths(grams: DataFrame, order: int) -> DataFrame:
    """``(gram, logp)``: log10 probability of the last byte of each gram after the bytes before it; ``grams`` has ``(gram, n)``."""
    events, contexts = trie(grams.where("n > 0"), order)
    seen = grams.where("n > 0").withColumn("c", F.shiftright("gram", 8)).join(contexts[order], "c")
    done = [seen.select("gram", F.log10(F.col("n") / (F.col("c_n") + F.col("c_d"))).alias("logp"))]
    zero = F.lit(0).cast("long")
    rest = grams.where("n = 0").select("gram", F.lit(0.0).alias("logp"), zero.alias("gone_n"), zero.alias("gone_d"))
    for j in range(order, -1, -1):
        key = F.col("gram").bitwiseAND(F.lit(_mask(j)).cast("long"))
        at = rest.withColumn("e", key).withColumn("c", F.shiftright(key, 8)).join(contexts[j], "c", "left")
        if j < order:
            at = at.join(events[j].select("e", F.col("n").alias("e_n")), "e", "left")
        else:
            at = at.withColumn("e_n", F.lit(None).cast("long"))
        left_n, left_d = F.col("c_n") - F.col("gone_n"), F.col("c_d") - F.col("gone_d")
        at = at.select(
            "gram", F.col("e_n").isNotNull().alias("hit"), F.col("c_n").isNotNull().alias("known"), "c_d", "c_x",
            F.when(F.col("e_n").isNotNull(), F.col("logp") + F.log10(F.col("e_n") / (left_n + left_d)))
            .when(F.col("c_n").isNotNull() & (left_d > 0), F.col("logp") + F.log10(left_d / (left_n + left_d)))
            .otherwise(F.col("logp")).alias("logp"),
        )
        at = written(at, "ppm-escapes")
        done.append(at.where("hit").select("gram", "logp"))
        rest = at.where("NOT hit").select(
            "gram", "logp", F.when(F.col("known"), F.col("c_x")).otherwise(zero).alias("gone_n"), F.when(F.col("known"), F.col("c_d")).otherwise(zero).alias("gone_d")
        )
    out = rest.select("gram", (F.col("logp") - F.log10(SYMBOLS - F.col("gone_d"))).alias("logp"))
    for d in done:
        out = out.unionByName(d)
    return out


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, slots: np.ndarray, shift: int) -> np.ndarray:
    """Values of keys that are all present: by one multiplicative hash, by search where two keys share a slot."""
    at = slots[(wanted.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)]
    miss = np.flatnonzero(keys[at] != wanted)
    at[miss] = np.searchsorted(keys, wanted[miss])
    return values[at]


def _score(order: int, tokens: int, types: int):
    def run(key, docs: pa.Table, known: pa.Table) -> pa.Table:
        rows = {"doc_id": docs["doc_id"], "held_out": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}
        grams, said = known.select(["gram", "logp"]).drop_null(), known.select(["word", "n"]).drop_null()
        del known
        keys, logp = grams["gram"].to_numpy(), grams["logp"].to_numpy()
        by = np.argsort(keys)
        keys, logp = keys[by], logp[by]
        bits = max(1, int(2 * len(keys)).bit_length())
        slots = np.zeros(1 << bits, np.int64)
        slots[(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)] = np.arange(len(keys))
        count: dict[bytes, int] = {}
        for part in said.to_batches(max_chunksize=65536):
            count.update(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
        del grams, said
        total = np.log10(tokens + types + 1)
        for batch in docs.select(["text", "train"]).to_batches(max_chunksize=SOME):
            train = batch.column("train").to_pylist()
            buf, at = text_buffer(batch.column("text"))
            for i, j in pieces(at, PIECE_BYTES):
                part, ends = LOWER[buf[at[i] : at[j]]], at[i : j + 1] - at[i]
                g, place = grams_of(part, ends, order)
                rows["score"].append(np.add.reduceat(_lookup(keys, logp, g, slots, 64 - bits), place[:-1]))
                whole = part.tobytes()
                for k in range(j - i):
                    own = whole[ends[k] : ends[k + 1]].split()
                    own.append(b"")
                    c = np.fromiter(map(count.__getitem__, own), np.int64, len(own))
                    rows["held_out"].append(not train[i + k])
                    rows["n_tokens"].append(len(own))
                    rows["n_known"].append(int((c > 0).sum()))
                    rows["base_score"].append(float(np.log10(c + 1.0).sum() - len(own) * total))
        rows["score"] = np.concatenate(rows["score"]) if rows["score"] else np.zeros(0)
        return pa.table({
            "doc_id": rows["doc_id"].cast(pa.int64()), "held_out": pa.array(rows["held_out"], pa.bool_()), "n_tokens": pa.array(rows["n_tokens"], pa.int64()),
            "n_known": pa.array(rows["n_known"], pa.int64()), "base_score": pa.array(rows["base_score"], pa.float64()), "score": pa.array(rows["score"], pa.float64()),
        })

    return run


def ppm_scores(docs: DataFrame, order: int = 5, folds: int = 7, held: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Learns from the rows whose crc32 of the id as text modulo ``folds`` is not
    ``held`` (a null id counts as the empty text). Texts are lower-cased A-Z; a
    null text is empty. ``score`` is the log10 probability of the text's bytes
    and its end under the trie of the training texts; a text's own counts are
    in it if it is one of them. ``base_score`` is that of its words and its end
    by single-word counts with one added. Repeated rows count as often as they
    occur. Without training rows all symbols are equally likely. An empty table
    gives no rows; other columns are ignored. ``order`` is 1 to 6.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    blocks = n_blocks(text_bytes(docs, text), BLOCK_BYTES)
    base = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
        (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds != held).alias("train"),
        F.pmod(row_key(key, text), F.lit(blocks)).cast("int").alias("block"),
    )
    counted = written(base.groupBy("block").applyInArrow(_count(order), _COUNTED), "ppm-counts")
    grams = counted.where("gram IS NOT NULL").select("block", "gram", "n")
    words = counted.where("word IS NOT NULL").select("block", "word", "n")
    word_counts = written(words.groupBy("word").agg(F.sum("n").alias("n")), "ppm-words")
    size = word_counts.where("n > 0").agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).first()
    tokens, types = size["tokens"] or 0, size["types"]
    gram_counts = written(grams.groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams")
    lengths = code_lengths(gram_counts, order)
    # Both joins are written and what they came from is dropped, so that the last stage finds the disk free.
    known_grams = written(grams.select("block", "gram").join(lengths, "gram").select("block", "gram", "logp"), "ppm-lengths")
    known_words = written(words.select("block", "word").join(word_counts, "word").select("block", "word", "n"), "ppm-words")
    discard(counted, gram_counts, word_counts)
    known = known_grams.unionByName(known_words, allowMissingColumns=True).withColumnRenamed("block", "b")
    scored = base.groupBy("block").cogroup(known.groupBy("b")).applyInArrow(_score(order, tokens, types), _SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
