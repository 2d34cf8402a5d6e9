"""Joins with a table of one row a key that hot and null keys cannot stall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than one in SHARE of all rows, so there are fewer than SHARE hot keys.
SHARE = 1000
#: Keys with fewer rows than this are never worth their own way.
LEAST = 1000


def hot_keys(rows: DataFrame, on: list[str], share: int = SHARE, least: int = LEAST) -> DataFrame | None:
    """The keys that hold more than one in ``share`` of all rows, fewer than ``share`` of them; None without any."""
    counts = rows.where(_present(on)).groupBy(*on).agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
    many = max(least, (most["all"] or 0) // share)
    if (most["most"] or 0) <= many:
        return None
    return rows.sparkSession.createDataFrame(counts.where(F.col("_n") > many).drop("_n").toArrow())


def _present(on: list[str]):
    out = F.lit(True)
    for k in on:
        out = out & F.col(k).isNotNull()
    return out


def lookup_join(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "left", share: int = SHARE, least: int = LEAST) -> DataFrame:
    """``rows`` with the columns of ``table``, which has at most one row a key; ``how`` is left or inner.

    Rows of hot keys meet a broadcast of these keys' table rows (fewer than
    ``share``) and stay where they are; rows with a null key are set aside and
    find nothing; only the others are shuffled. ``rows`` is read several times,
    so pass a stored table or a cheap frame.
    """
    on = [on] if isinstance(on, str) else list(on)
    hot = hot_keys(rows, on, share, least)
    sound = rows.where(_present(on))
    if hot is None:
        out = sound.join(table, on, how)
    else:
        hot = F.broadcast(hot)
        out = sound.join(hot, on, "left_anti").join(table.join(hot, on, "left_anti"), on, how)
        few = table.join(hot, on, "left_semi")
        out = out.unionByName(sound.join(hot, on, "left_semi").join(F.broadcast(few), on, how))
    if how == "left":
        more = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in on]
        out = out.unionByName(rows.where(~_present(on)).select("*", *more))
    return out
