"""Exact ranks inside groups of any size.

Groups are counted first. A group that one task can sort is ranked by a window;
all ranks of such groups share one partitioning. A hot group is dealt by ranges
of its order and sorted inside each range, so it spreads over many tasks: a
row's place in its range comes from the sort, and ranges are chained by their
counts. Both ways give the same ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import written


#: Rows of a group that one task sorts; larger groups are dealt by ranges.
HOT_ROWS = 1_000_000


def _by_size(df: DataFrame, by: list[str], small, large) -> DataFrame:
    """``small`` of the rows of ordinary groups and ``large`` of those of hot ones. A frame that this module has found to
    have no hot groups is not counted again."""
    if getattr(df, "no_hot_groups", None) == by:
        return _known(small(df), by)
    rows = written(df, "ranked")
    hot = written(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS), "hot-groups")
    if hot.isEmpty():
        return _known(small(rows), by)
    marked = _left_on(rows, hot, by, ["_n"])
    return small(marked.where("_n IS NULL").drop("_n")).unionByName(large(marked.where("_n IS NOT NULL").drop("_n")))


def _known(df: DataFrame, by: list[str] | None) -> DataFrame:
    df.no_hot_groups = by
    return df


def _placed(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``_at``, the place from 1 on inside ``by``, and ``_size``, the rows of the group."""
    own = Window.partitionBy(*by)
    return _by_size(
        df, by, lambda rows: rows.withColumn("_at", F.row_number().over(own.orderBy(*order))).withColumn("_size", F.count("*").over(own)),
        lambda rows: _dealt(rows, by, order))


def _dealt(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """As ``_placed``, by ranges."""
    keys = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    ranges = df.select("*", *keys).repartitionByRange(*by, *names).sortWithinPartitions(*by, *names)
    # Written, so that places and the counts below come from the same ranges.
    rows = written(ranges.drop(*names).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("_range", F.shiftright("_id", 33))
    runs = rows.groupBy(*by, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    before = F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_size", F.sum("_n").over(group)).drop("_n")
    out = _left_on(rows, runs, [*by, "_range"], ["_first", "_before", "_size"])
    return out.withColumn("_at", F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_id", "_range", "_first", "_before")


def ordinal(df: DataFrame, by: list[str], order: list[Column], out: str = "rn") -> DataFrame:
    """Row number from 1 inside ``by``. ``order`` are ascending sort values
    that together are unique in the group (negate a number to descend)."""
    d = _placed(df, by, order)
    return _known(d.withColumn(out, F.col("_at").cast("bigint")).drop("_at", "_size"), getattr(d, "no_hot_groups", None))


def _left_on(a: DataFrame, b: DataFrame, keys: list[str], add: list[str]) -> DataFrame:
    """A left join on keys that may be null: a null group is a group as well."""
    r = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *add)
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    return a.join(r, cond, "left").drop(*[f"_k_{k}" for k in keys])


def tiles(df: DataFrame, by: list[str], order: list[Column], bins: int, out: str = "bin") -> DataFrame:
    """Equal-count bins 1..bins, larger bins first, as ``ntile``."""
    d = _placed(df, by, order)
    return _known(d.withColumn(out, tile_of(F.col("_at"), F.col("_size"), bins)).drop("_at", "_size"), getattr(d, "no_hot_groups", None))


def tile_of(rn: Column, n: Column, bins: int) -> Column:
    q, r = F.floor(n / F.lit(bins)), n % bins
    big = r * (q + 1)
    low = F.ceil(rn / (q + 1))
    high = r + F.ceil((rn - big) / F.greatest(q, F.lit(1)))
    return F.when(rn <= big, low).otherwise(high).cast("bigint")


def tied_rank(df: DataFrame, by: list[str], value: str, out: str = "rank", method: str = "average") -> DataFrame:
    """Rank of a value with ties: ``average``, ``min`` (SQL rank) or
    ``percent`` (SQL percent_rank). Null values get a null rank.

    In a hot group rows of one value are told apart by a hash, so that a value
    with very many rows spreads over ranges too; their places are then replaced
    by the group's.
    """
    known = F.col(value).isNotNull()
    own = Window.partitionBy(*by)

    def small(rows: DataFrame) -> DataFrame:
        sorted_ = own.orderBy(F.asc_nulls_first(value))
        return rows.withColumns({
            "_low": F.rank().over(sorted_), "_high": F.count("*").over(sorted_.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
            "_size": F.count("*").over(own), "_blank": F.count_if(~known).over(own)})

    def large(rows: DataFrame) -> DataFrame:
        d = _dealt(rows, by, [known, F.col(value), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])])
        ends = d.where(known).groupBy(*by, value).agg(F.min("_at").alias("_low"), F.max("_at").alias("_high")).where("_low < _high")
        blank = d.where(~known).groupBy(*by).agg(F.count("*").alias("_blank"))
        d = _left_on(_left_on(d, ends, [*by, value], ["_low", "_high"]), blank, by, ["_blank"])
        return d.withColumns({"_low": F.coalesce("_low", "_at"), "_high": F.coalesce("_high", "_at"), "_blank": F.coalesce("_blank", F.lit(0))}).drop("_at")

    rows = _by_size(df, by, small, large)
    # Nulls come first in the order; they do not count.
    low = (F.col("_low") - F.col("_blank")).cast("double")
    r = {
        "average": low + (F.col("_high") - F.col("_low")) / 2,
        "min": low,
        "percent": _percent(low, F.col("_size") - F.col("_blank")),
    }[method]
    done = rows.withColumn(out, F.when(known, r)).drop("_size", "_low", "_high", "_blank")
    return _known(done, getattr(rows, "no_hot_groups", None))


def _percent(low: Column, total: Column) -> Column:
    return F.when(total > 1, (low - 1) / (total - 1)).otherwise(F.lit(0.0))


def correlation_of(a: str, b: str, over=None) -> Column:
    """Correlation over the rows where both values are present; null, not an
    error, where one of them does not vary."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    parts = [F.covar_pop(a, b), F.stddev_pop(x), F.stddev_pop(y)]
    c, u, v = (q.over(over) for q in parts) if over is not None else parts
    return F.try_divide(c, u * v)
