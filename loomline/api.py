"""Fluent panels: what a strategy author writes.

    data = Data(Tables(spark, root))
    close = data.get("price:close")
    buy = (close > close.average(20)) & (data.indicator("RSI", period=14) > 50)
    sell = close < close.average(20)
    result = sim(buy.hold_until(sell), data, resample="M", position_limit=30)
    result.report().show()

A ``Panel`` is a column expression over a shared table plus the window columns
it needs. Panels of one table combine without a join; equal window columns
carry equal names and are computed once. Everything stays lazy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.indicators import REGISTRY, indicators, output_columns, rolled
from loomline.operators import backtest
from loomline.operators import panel as P
from loomline.sources.catalog import Catalog
from loomline.sources.tables import Tables

# Sampling order of the tables, finest first.
_FINENESS = {"daily": 0, "price": 1, "price_book_ratio": 1, "statement": 3, "fundamental_features": 3}


def _name(tag: str, expr: Column) -> str:
    return f"_{tag}_{hashlib.md5(repr(expr).encode()).hexdigest()[:12]}"


class Panel:
    def __init__(self, root: DataFrame, expr: Column, layers: tuple = (), grade: int = 1, boolean: bool = False):
        self.root, self.expr, self.layers, self.grade, self.boolean = root, expr, layers, grade, boolean

    # -- evaluation
    def frame(self) -> DataFrame:
        df = self.root
        for key, fn in self.layers:
            if key not in df.columns:
                df = fn(df)
        return df

    def df(self, name: str = "value") -> DataFrame:
        """(date, sym, value)."""
        return self.frame().select("date", "sym", self.expr.alias(name))

    def signals(self) -> DataFrame:
        return self.df("signal").withColumn("signal", P.holds(F.col("signal")))

    # -- combination
    def _with(self, expr: Column, boolean: bool = False) -> Panel:
        return Panel(self.root, expr, self.layers, self.grade, boolean)

    def _column(self, tag: str = "x") -> tuple[Panel, str]:
        """This panel with its value as a named column of the table."""
        name, expr = _name(tag, self.expr), self.expr
        layer = (name, lambda df: df.withColumn(name, expr))
        return Panel(self.root, F.col(name), (*self.layers, layer), self.grade, self.boolean), name

    def _align(self, other: Panel) -> tuple[Panel, Column, Column]:
        """One table holding both values."""
        if self.root is other.root:
            seen = {k for k, _ in self.layers}
            layers = (*self.layers, *[l for l in other.layers if l[0] not in seen])
            return Panel(self.root, self.expr, layers, self.grade), self.expr, other.expr
        if self.grade == other.grade:
            j = self.df("_a").join(other.df("_b"), ["date", "sym"], "full_outer")
            return Panel(j, F.col("_a"), (), self.grade), F.col("_a"), F.col("_b")
        fine, coarse, names = (self, other, ("_a", "_b")) if self.grade < other.grade else (other, self, ("_b", "_a"))
        j = P.as_of(fine.df(names[0]), coarse.df(names[1]), [names[1]])
        return Panel(j, F.col("_a"), (), fine.grade), F.col("_a"), F.col("_b")

    def _binary(self, other, op: Callable, boolean: bool = False) -> Panel:
        if isinstance(other, Panel):
            base, a, b = self._align(other)
        else:
            base, a, b = self, self.expr, F.lit(other)
        e = op(a, b)
        return base._with(P.holds(e) if boolean else e, boolean)

    def __gt__(self, o):
        return self._binary(o, lambda a, b: a > b, True)

    def __ge__(self, o):
        return self._binary(o, lambda a, b: a >= b, True)

    def __lt__(self, o):
        return self._binary(o, lambda a, b: a < b, True)

    def __le__(self, o):
        return self._binary(o, lambda a, b: a <= b, True)

    def __eq__(self, o):  # noqa: D105
        return self._binary(o, lambda a, b: a == b, True)

    def __ne__(self, o):
        return self._binary(o, lambda a, b: a != b, True)

    __hash__ = None

    def __and__(self, o):
        return self._binary(o, lambda a, b: P.holds(a) & P.holds(b), True)

    def __or__(self, o):
        return self._binary(o, lambda a, b: P.holds(a) | P.holds(b), True)

    def __invert__(self):
        return self._with(~P.holds(self.expr), True)

    def __add__(self, o):
        return self._binary(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._binary(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._binary(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self._binary(o, F.try_divide)

    def __radd__(self, o):
        return self._binary(o, lambda a, b: b + a)

    def __rsub__(self, o):
        return self._binary(o, lambda a, b: b - a)

    def __rmul__(self, o):
        return self._binary(o, lambda a, b: b * a)

    def __rtruediv__(self, o):
        return self._binary(o, lambda a, b: F.try_divide(b, a))

    def __neg__(self):
        return self._with(-self.expr)

    def __getitem__(self, key):
        """One symbol, or the cells where a boolean panel holds."""
        if isinstance(key, Panel):
            return self._binary(key, lambda a, b: F.when(P.holds(b), a))
        return Panel(self.root.where(F.col("sym") == key), self.expr, self.layers, self.grade, self.boolean)

    # -- windows over a symbol's bars
    def rolling(self, n: int) -> Rolling:
        return Rolling(self, n)

    def average(self, n: int) -> Panel:
        return self.rolling(n).mean()

    def shift(self, n: int = 1) -> Panel:
        p, c = self._column()
        return p._with(F.lag(c, n).over(P.by_sym()), self.boolean)

    def pct_change(self, n: int = 1) -> Panel:
        return self / self.shift(n) - 1

    def clip(self, lo: float, hi: float) -> Panel:
        return self._with(P.clip(self.expr, lo, hi))

    # -- selection
    def top(self, n: int) -> Panel:
        """Boolean panel of the n best names per date."""
        d = self.df("value")
        k = P.top(d, "value", n).select("date", "sym", F.lit(True).alias("_top"))
        d = d.select("date", "sym").join(k, ["date", "sym"], "left")
        return Panel(d, P.holds(F.col("_top")), (), self.grade, True)

    def hold_until(self, exits: Panel, nstocks_limit: int | None = None, rank: Panel | None = None) -> Panel:
        base, a, b = self._align(exits)
        if nstocks_limit is None:
            s = P.hold_until(base.frame().select("date", "sym", P.holds(a).alias("entry"), P.holds(b).alias("exit")))
            return Panel(s, F.col("held"), (), self.grade, True)
        both = base._with(F.struct(P.holds(a).alias("entry"), P.holds(b).alias("exit")))
        if rank is None:
            s = both.df("_e").select("date", "sym", "_e.*", F.lit(0.0).alias("rank_value"))
        else:
            m, e, r = both._align(rank)
            s = m._with(F.struct(e.alias("e"), r.alias("r"))).df("_x").select(
                "date", "sym", F.coalesce("_x.e.entry", F.lit(False)).alias("entry"),
                F.coalesce("_x.e.exit", F.lit(False)).alias("exit"), F.col("_x.r").alias("rank_value"))
        spells = P.hold_until_slots(s.withColumn("strategy", F.lit("")), nstocks_limit, exit_="exit")
        days = s.select("date", "sym")
        in_spell = ((F.col("sym") == F.col("_s")) & (F.col("date") >= F.col("entry_date"))
                    & (F.col("exit_date").isNull() | (F.col("date") < F.col("exit_date"))))
        # spells of a symbol do not overlap: each cell meets one at most
        held = days.join(spells.withColumnRenamed("sym", "_s"), in_spell, "left").select("date", "sym", F.col("_s").isNotNull().alias("held"))
        return Panel(held, F.col("held"), (), self.grade, True)

    # -- reductions
    def sum(self, axis: int = 0) -> DataFrame:
        """axis=1: per date over symbols; axis=0: per symbol over dates."""
        d = self.df("value")
        agg = F.count_if(F.coalesce("value", F.lit(False))) if self.boolean else F.sum("value")
        return d.groupBy("date" if axis == 1 else "sym").agg(agg.alias("value"))

    def dropna(self) -> DataFrame:
        return self.df().na.drop()

    def sort_values(self, ascending: bool = True) -> DataFrame:
        d = self.df()
        return d.orderBy(F.asc("value") if ascending else F.desc("value"), "date", "sym")

    def resample(self, freq: str) -> DataFrame:
        return P.resample_last(self.df(), freq, ["value"])


class Rolling:
    def __init__(self, panel: Panel, n: int):
        self.panel, self.n = panel, n

    def _agg(self, fn) -> Panel:
        p, c = self.panel._column()
        return p._with(rolled(fn, c, self.n))

    def mean(self):
        return self._agg(F.avg)

    def std(self):
        return self._agg(F.stddev_samp)

    def sum(self):
        return self._agg(F.sum)

    def max(self):
        return self._agg(F.max)

    def min(self):
        return self._agg(F.min)


class Data:
    """Entry point: reads panels and indicators under the current universe."""

    def __init__(self, tables: Tables):
        self.catalog = Catalog(tables)
        self._roots: dict = {}

    def _root(self, table: str) -> DataFrame:
        key = (table, id(self.catalog._scope), self.catalog._storage)
        if key not in self._roots:
            self._roots[key] = self.catalog._frame(table)
        return self._roots[key]

    def get(self, key: str, save_to_storage: bool = True, force_download: bool = False) -> Panel:
        table, field = self.catalog.split_key(key)
        if force_download:
            self.catalog.get(key, save_to_storage, True)
            self._roots.clear()
        return Panel(self._root(table), F.col(field), (), _FINENESS[table])

    def indicator(self, name: str, **params) -> Panel | tuple[Panel, ...]:
        root = self._root("price")
        ind = REGISTRY.get(name.upper())
        if ind is None:
            raise KeyError(f"unknown indicator {name!r}")
        outs = output_columns(name, params)
        layer = (outs[0], lambda df: indicators(df, [(name, None, params)]))
        panels = tuple(Panel(root, F.col(o), (layer,), _FINENESS["price"]) for o in outs)
        return panels[0] if len(panels) == 1 else panels

    def bars(self) -> DataFrame:
        return self._root("price")

    def search(self, keyword: str) -> DataFrame:
        return self.catalog.search(keyword)

    def universe(self, market=None, category=None, symbols=None):
        return self.catalog.universe(market, category, symbols)

    def set_storage(self, path: str | None = None) -> str:
        return self.catalog.set_storage(path)


def sim(position: Panel, data: Data, **kw) -> backtest.Result:
    """Evaluate a boolean position panel; arguments as in ``backtest.sim``."""
    return backtest.sim(position.signals(), data.bars(), **kw)


def run_strategy(strategy: Callable[[Data], tuple[Panel, Panel]], data: Data) -> DataFrame:
    """(date, sym, buy, sell) of a user function that composes panels."""
    buy, sell = strategy(data)
    base, a, b = buy._align(sell)
    return base.frame().select("date", "sym", P.holds(a).alias("buy"), P.holds(b).alias("sell"))
