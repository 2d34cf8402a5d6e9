"""Markdown records with a ``---`` header block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = r"(?s)^\s*---\n(.*?)\n---\n?"


def scan(spark: SparkSession, path: str, record_sep: str | None = None) -> DataFrame:
    """One row per record: kind from the folder, header as a map, body.

    Without ``record_sep`` a file is a record; with it, a file holds many
    records and Spark splits it.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if record_sep is None:
        t = reader.text(path, wholetext=True)
    else:
        t = reader.option("lineSep", record_sep).text(path)
    t = t.select("value", F.col("_metadata.file_path").alias("path"))
    head = F.regexp_extract("value", HEADER, 1)
    # each line splits at its first colon; of a repeated key the last line counts
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[^:]*\S[^:]*:"))
    names = F.transform(lines, lambda x: F.trim(F.substring_index(x, ":", 1)))
    values = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", "")))
    last = F.filter(F.transform(names, lambda n, i: F.when(F.array_position(F.slice(names, i + 2, F.size(names)), n) == 0, i)), lambda i: i.isNotNull())
    attrs = F.map_from_arrays(F.transform(last, lambda i: F.get(names, i)), F.transform(last, lambda i: F.get(values, i)))
    return t.select(
        F.regexp_extract("path", r"/(epics|prds|context)/", 1).alias("kind"),
        "path",
        F.nullif(F.regexp_extract("path", r"/(?:epics|prds|context)/([^/]+)/[^/]*$", 1), F.lit("")).alias("epic"),
        F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1).alias("id"),
        F.when(F.length(head) > 0, attrs).alias("attrs"),
        F.regexp_replace(F.regexp_replace("value", HEADER, ""), r"^\s+|\s+$", "").alias("body"),
    )


def render(items: DataFrame, attrs: list[str], body: str) -> DataFrame:
    """The reverse: a ``value`` column with header and body."""
    lines = [F.concat(F.lit(f"{a}: "), F.col(a).cast("string")) for a in attrs]
    return items.select(
        F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.col(body)).alias("value")
    )
