"""From raw documents to piece ids, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one
before kept. Stages 1 to 4 return the columns of ``documents``; each result is
written and read again. Nulls are allowed in every column: a null text is
empty, a null id is no one's copy but that of the same text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import mixing, nearcopies, pieces, pii, quality
from loomline.llm.common import raw, written

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _rows(docs: DataFrame, **more: Column) -> DataFrame:
    """Each document as a struct beside the columns of a stage, so that no names clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in more.items()))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents to which the classifier gives less than 0.3. An empty text scores by the offset."""
    model = quality.fit(docs, raw(spark, sf_dir, "labels"))
    return _rows(docs, score=model.column(F.col("text"))).where("score >= 0.3").select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that shingles of five words link at 0.8 or more.

    Documents without words are no copies of each other. A row that is repeated
    with its id and text stays once; rows without an id come after all others.
    """
    far = F.lit(2**62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(2**61 - 1))
    name = F.coalesce(F.col("doc_id").cast("long"), far)
    groups = nearcopies.near_copies(docs.select(name.alias("doc_id"), "text"), shingle=5, percent=80)
    kept = groups.where("kept").groupBy(F.col("doc_id").alias("name")).agg(F.count("*").alias("times"))
    found = _rows(docs, name=name).join(kept, "name")
    once = found.where("times = 1").select("row.*")
    more = found.where("times > 1").withColumn("text", F.col("row.text")).dropDuplicates(["name", "text"]).select("row.*")
    return once.unionByName(more)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by marks, and counts characters anew."""
    found = docs.select(pii.candidates(F.col("text")).alias("spans"))
    accepted = pii.accepted_patterns(found, 0.9)
    clean = _rows(docs, clean=pii.masked(F.col("text"), accepted))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)}
    return clean.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics approach their target weights."""
    return mixing.mixed(docs, budget=0.9).where("keep").select("row.*")


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_ids, round_trip, ids)`` of what is left."""
    return pieces.encode_documents(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_near_copies),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed_sources),
    ("SentencePiece encoding and decoding", piece_ids),
]

#: The learned stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
