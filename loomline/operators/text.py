"""Logs, comments and search over text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.session import batches_of

WORD_GAP = r"[^\p{L}\p{N}]+"

# Verdict rules for review comments (fixed values): first accept, then ignore.
ACCEPT = r"\b(bug|error|leak|security|crash|race|overflow|null|secret|password)"
IGNORE = r"\b(style|naming|format|nit|whitespace|comment|typo)"


def words(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, word): runs of letters and digits of any script, of the whole text."""
    w = F.explode(F.split(F.lower(text), WORD_GAP)).alias("word")
    return docs.select(id_, w).where(F.col("word") != "")


def test_summary(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status counts, and the failing lines only."""
    s = lines.withColumn("status", F.lower(F.regexp_extract("line", r" (PASSED|FAILED|ERROR|SKIPPED)$", 1)))
    s = s.where(F.col("status") != "")
    return s.groupBy("status").agg(F.count("*").alias("n")), s.where(F.col("status").isin("failed", "error"))


def reduce_logs(docs: DataFrame, k: int = 3, id_: str = "doc_id") -> DataFrame:
    """Line count per file and its k most repeated lines."""
    lines = docs.select(id_, F.explode(F.split("text", "\n")).alias("line"))
    c = lines.groupBy(id_, "line").agg(F.count("*").alias("n"))
    total = c.groupBy(id_).agg(F.sum("n").alias("n_lines"))
    w = Window.partitionBy(id_).orderBy(F.desc("n"), "line")
    best = c.where(F.trim("line") != "").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(total, id_)


def triage(comments: DataFrame) -> DataFrame:
    t = F.lower("text")
    v = F.when(t.rlike(ACCEPT), "accept").when(t.rlike(IGNORE), "ignore").otherwise("review")
    return comments.withColumn("verdict", v)


def search(docs: DataFrame, terms: list[str], id_: str = "doc_id") -> DataFrame:
    """Score of each matching record: term counts weighted by inverse document
    frequency."""
    n = docs.agg(F.count("*")).scalar()
    tf = words(docs, id_).where(F.col("word").isin([t.lower() for t in terms])).groupBy(id_, "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    return tf.join(df, "word").groupBy(id_).agg(
        F.count("*").alias("n_terms"), F.sum(F.col("tf") * F.ln(n / F.col("df"))).alias("score"))


# ---- a stored index of all content --------------------------------------------------

#: Folders of an index; a term is in one of them.
BUCKETS = 64
_LISTS = "kind string, word string, ids array<string>, tfs array<int>"
_POSTINGS = f"{_LISTS}, batch int, bucket int"


def _bucket(word) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _listed(batches):
    """A row for each kind and word of a batch of ``(kind, id, words)``: the items that hold the word, and how often."""
    for batch in batches:
        kinds = batch["kind"].dictionary_encode(null_encoding="encode")
        items, n_kinds = batch.num_rows, max(1, len(kinds.dictionary))
        words = batch["words"].flatten()
        row = np.repeat(np.arange(items), pc.fill_null(pc.list_value_length(batch["words"]), 0).to_numpy())
        some = pc.not_equal(words, "")
        words, row = words.filter(some).dictionary_encode(), row[some.to_numpy(zero_copy_only=False)]
        group = words.indices.to_numpy().astype("int64") * n_kinds + kinds.indices.to_numpy()[row]
        key, tf = np.unique(group * items + row, return_counts=True)
        group, row = key // items, key % items
        first = np.flatnonzero(np.diff(group, prepend=-1))
        ends = pa.array(np.append(first, len(key)), "int32")
        yield pa.RecordBatch.from_arrays([
            kinds.dictionary.take(pa.array(group[first] % n_kinds)), words.dictionary.take(pa.array(group[first] // n_kinds)),
            pa.ListArray.from_arrays(ends, batch["id"].take(pa.array(row))), pa.ListArray.from_arrays(ends, pa.array(tf, "int32"))],
            ["kind", "word", "ids", "tfs"])


def index_items(items: DataFrame, path: str, batch: int) -> None:
    """Add ``(kind, id, text)`` to the index at ``path``: how often each item holds each word, in a folder of the word's
    bucket, sorted by word. A row lists the items of one Arrow batch that hold a word, so a frequent one is a few rows
    with long lists. Rows go to tasks by bucket, and Spark splits the buckets of frequent words by size. A batch owns its
    folders, so a repeated one replaces itself."""
    w = items.select("kind", F.col("id").cast("string").alias("id"), F.split(F.lower("text"), WORD_GAP).alias("words"))
    lists = w.mapInArrow(_listed, _LISTS).withColumn("bucket", _bucket(F.col("word")))
    dealt = lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word")
    with batches_of(items.sparkSession, "8m"):
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    items.groupBy("kind").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/items/batch={batch}")


def search_index(spark: SparkSession, path: str, terms: list[str], kinds: list[str] | None = None) -> DataFrame:
    """``(kind, id, n_terms, score)``: as ``search``, over all items of the index or of some kinds. Only the folders of the
    terms are read, and of these the parts whose range of words holds one."""
    terms = sorted({t.lower() for t in terms}) or [""]  # which no word is
    wanted = spark.createDataFrame([(t,) for t in terms], "word string").select(_bucket(F.col("word")).alias("b")).distinct().collect()
    items = spark.read.schema("kind string, n long, batch int").parquet(f"{path}/items")
    found = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").where(F.col("bucket").isin([r["b"] for r in wanted]) & F.col("word").isin(terms))
    if kinds is not None:
        items, found = items.where(F.col("kind").isin(kinds)), found.where(F.col("kind").isin(kinds))
    n = items.agg(F.sum("n")).scalar()
    found = found.select("kind", "word", F.explode(F.arrays_zip("ids", "tfs")).alias("x")).select("kind", "word", F.col("x.ids").alias("id"), F.col("x.tfs").alias("tf"))
    # Matches are shuffled and grouped once, by item, which may have several rows of a word; a column a term.
    tf = {t: f"_tf{i}" for i, t in enumerate(terms)}
    found = found.repartition("kind", "id").groupBy("kind", "id").agg(*(F.sum(F.when(F.col("word") == t, F.col("tf"))).alias(c) for t, c in tf.items()))
    df = found.agg(*(F.count(c).alias(f"_df{c}") for c in tf.values()))  # one row
    found = found.join(F.broadcast(df))
    has, score = F.lit(0).cast("long"), F.lit(0.0)
    for c in tf.values():
        has += F.when(F.col(c).isNotNull(), 1).otherwise(0)
        score += F.coalesce(F.col(c) * F.ln(F.try_divide(n, F.col(f"_df{c}"))), F.lit(0.0))
    return found.select("kind", "id", has.alias("n_terms"), score.alias("score"))


def sentiment(docs: DataFrame, lexicon: DataFrame, id_: str = "doc_id") -> DataFrame:
    """Sum of lexicon scores per document; counts of words go into the join,
    not the words themselves."""
    c = words(docs, id_).groupBy(id_, "word").agg(F.count("*").alias("c"))
    return c.join(lexicon, "word").groupBy(id_).agg(
        F.sum(F.col("c") * F.col("score")).alias("score"), F.sum("c").alias("n_words"))


def frequent_lexicon(docs: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent words with alternating signs."""
    c = words(docs).groupBy("word").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "word").limit(n)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("c"), "word")
    return c.select("word", F.when(F.row_number().over(w) % 2 == 1, 1).otherwise(-1).cast("bigint").alias("score"))
