"""Dataset keys ``table:field`` and scoped reads."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import new_path
from loomline.sources.tables import Tables

# Documented second spelling of the book-ratio dataset (fixed value).
KEY_ALIASES = {"price_earning_ratio:pb": "price_book_ratio:pb"}


class Catalog:
    """Panels by key. One entry per table: a builder and its fields."""

    def __init__(self, tables: Tables):
        from loomline.operators import fundamentals as fn

        self.tables = tables
        self.spark = tables.spark
        self._builders: dict[str, tuple[Callable[[], DataFrame], tuple[str, ...]]] = {
            "price": (lambda: tables.bars("W"), ("open", "high", "low", "close", "volume", "turnover", "vwap")),
            "daily": (lambda: tables.bars("D"), ("open", "high", "low", "close", "volume", "turnover", "vwap")),
            "statement": (
                lambda: tables.fundamentals().withColumnRenamed("available", "date"),
                ("revenue", "cost", "tax", "net", "equity", "shares"),
            ),
            "fundamental_features": (
                lambda: fn.ratios(tables.fundamentals()).withColumnRenamed("available", "date"),
                ("gross_margin", "net_margin", "roe"),
            ),
            "price_book_ratio": (lambda: fn.valuation(tables.bars("W"), tables.fundamentals()), ("pb", "pe")),
        }
        self._scope: DataFrame | None = None
        self._storage: str | None = None

    # -- reads
    def split_key(self, key: str) -> tuple[str, str]:
        key = KEY_ALIASES.get(key, key)
        table, _, field = key.partition(":")
        if table not in self._builders or field not in self._builders[table][1]:
            raise KeyError(f"no dataset {key!r}")
        return table, field

    def get(self, key: str, save_to_storage: bool = True, force_download: bool = False) -> DataFrame:
        table, field = self.split_key(key)
        df = self._frame(table, save_to_storage, force_download)
        return df.select("date", "sym", F.col(field).alias("value"))

    def get_many(self, keys: dict[str, str]) -> DataFrame:
        """Several fields; fields of one table come from one scan."""
        by_table: dict[str, list] = {}
        for name, key in keys.items():
            table, field = self.split_key(key)
            by_table.setdefault(table, []).append(F.col(field).alias(name))
        frames = [self._frame(t).select("date", "sym", *cols) for t, cols in by_table.items()]
        out = frames[0]
        for f in frames[1:]:
            out = out.join(f, ["date", "sym"], "full_outer")
        return out

    def _frame(self, table: str, save: bool = True, force: bool = False) -> DataFrame:
        build, _ = self._builders[table]
        if self._storage is None:
            df = build()
        else:
            path = f"{self._storage}/{table}"
            if force or not self._exists(path):
                out = build().withColumn("year", F.year("date"))
                if not save:
                    return self._scoped(out.drop("year"))
                out.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)
            df = self.spark.read.parquet(path).drop("year")
        return self._scoped(df)

    def _scoped(self, df: DataFrame) -> DataFrame:
        if self._scope is None:
            return df
        scope = self._scope.select(F.col("sym").cast(df.schema["sym"].dataType).alias("sym"))
        return df.join(scope, "sym", "left_semi")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def set_storage(self, path: str | None = None) -> str:
        """Keep fetched tables as parquet under the path, by year."""
        self._storage = path or new_path(self.spark, "store")
        return self._storage

    # -- search and scope
    def datasets(self) -> list[str]:
        return [f"{t}:{f}" for t, (_, fields) in self._builders.items() for f in fields]

    def names(self, keyword: str = "") -> list[str]:
        return [d for d in self.datasets() if keyword.lower() in d.lower()]

    def search(self, keyword: str) -> DataFrame:
        """Matching dataset keys with their coverage, one pass per table.
        ``names`` answers without reading data."""
        parts = []
        for t, (build, fields) in self._builders.items():
            hit = [f for f in fields if keyword.lower() in f"{t}:{f}".lower()]
            if not hit:
                continue
            agg = build().agg(
                *[F.count(f).alias(f) for f in hit], F.min("date").alias("first"), F.max("date").alias("last")
            )
            parts.append(
                agg.select(F.explode(F.array(*[
                    F.struct(F.lit(f"{t}:{f}").alias("dataset"), F.col(f).alias("n_values"), "first", "last")
                    for f in hit])).alias("r")).select("r.*")
            )
        if not parts:
            return self.spark.createDataFrame([], "dataset string, n_values long, first date, last date")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def symbols(self, market: str | list[str] | None = None, category: str | list[str] | None = None) -> DataFrame:
        """Symbols of one or more markets and categories; none given means all."""
        u = self.tables.universe()
        for col, v in (("market", market), ("category", category)):
            if v is not None:
                u = u.where(F.col(col).isin([v] if isinstance(v, str) else list(v)))
        return u

    @contextmanager
    def universe(self, market=None, category=None, symbols: list | None = None):
        """Every read in the block sees these symbols only, by a semi join that
        Catalyst broadcasts when its size allows. A list may hold numbers or
        names; it takes the type of the panel it meets."""
        before = self._scope
        if symbols is not None:
            self._scope = self.spark.createDataFrame([(str(s),) for s in symbols], "sym string")
        else:
            self._scope = self.symbols(market, category).select("sym")
        try:
            yield self
        finally:
            self._scope = before
