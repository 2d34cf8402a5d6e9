"""Indicator registry.

``indicator(df, name, **params)`` adds the output columns of a named
indicator to a bars panel. Windowed indicators are column expressions over
the symbol's own bars and share window specs, so Catalyst folds them into one
Window node. Recursive ones (exponential smoothing, trailing bands) are
vectorised passes over one symbol's bars in ``mapInArrow`` over sorted
partitions; several of them run in a single pass. A task holds a batch and one
symbol's bars, which the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType, StructField, StructType

from loomline.operators.panel import by_sym, last_rows, to_here
from loomline.operators.ranking import correlation_of


@dataclass(frozen=True)
class Indicator:
    name: str
    outputs: tuple[str, ...]
    defaults: dict
    fn: Callable
    recursive: bool


REGISTRY: dict[str, Indicator] = {}


def _register(name, outputs, recursive, defaults):
    def deco(fn):
        REGISTRY[name.upper()] = Indicator(name.upper(), tuple(outputs), defaults, fn, recursive)
        return fn

    return deco


def windowed(name: str, *outputs: str, **defaults):
    """Register ``fn(df, outs, **params) -> df`` built from window columns."""
    return _register(name, outputs or (name.lower(),), False, defaults)


def recursive(name: str, *outputs: str, **defaults):
    """Register ``fn(pdf, **params) -> tuple of arrays`` over one symbol's bars."""
    return _register(name, outputs or (name.lower(),), True, defaults)


# The documents use both argument names for the window length.
def _params(ind: Indicator, given: dict) -> dict:
    p = dict(ind.defaults)
    for k, v in given.items():
        if k == "period" and "period" not in p:
            k = "timeperiod"
        if k not in p:
            raise TypeError(f"{ind.name} has no parameter {k!r}; known: {sorted(p)}")
        p[k] = v
    return p


def names() -> list[str]:
    return sorted(REGISTRY)


def output_columns(name: str, params: dict, prefix: str | None = None) -> list[str]:
    ind = REGISTRY[name.upper()]
    if prefix is None:
        p = _params(ind, params)
        changed = "_".join(str(v).replace(".", "p") for k, v in p.items() if v != ind.defaults.get(k))
        prefix = f"{ind.name.lower()}{'_' + changed if changed else ''}"
    return [prefix] if len(ind.outputs) == 1 else [f"{prefix}_{o}" for o in ind.outputs]


def indicator(df: DataFrame, name: str, prefix: str | None = None, **params) -> DataFrame:
    return indicators(df, [(name, prefix, params)])


def indicators(df: DataFrame, specs: list[tuple[str, str | None, dict]]) -> DataFrame:
    """Several indicators; outputs already present are not computed again."""
    todo_rec, done, given = [], [], df.columns
    for name, prefix, params in specs:
        key = name.upper()
        if key not in REGISTRY:
            raise KeyError(f"unknown indicator {name!r}")
        ind = REGISTRY[key]
        outs = output_columns(name, params, prefix)
        if all(o in given or o in done for o in outs) or any(outs == t[1] for t in todo_rec):
            continue
        p = _params(ind, params)
        if ind.recursive:
            todo_rec.append((ind, outs, p))
        else:
            df = ind.fn(df, outs, **p)
            done += outs
    if done:
        df = df.select(*given, *done)  # helper columns end here
    return _fold(df, todo_rec) if todo_rec else df


def _symbols(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole symbols, with the places where symbols begin."""
    kept: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            kept.append(batch)
        rows = pa.Table.from_batches(kept) if kept else None
        if rows is None or not rows.num_rows:
            continue
        sym = rows.column("sym").combine_chunks()
        same = pc.fill_null(pc.equal(sym[1:], sym[:-1]), False).to_numpy(zero_copy_only=False)
        blank = sym.is_null().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], ~(same | (blank[1:] & blank[:-1]))]))
        if batch is None:
            yield rows, starts
        elif len(starts) > 1:
            kept = rows.slice(starts[-1]).to_batches()
            yield rows.slice(0, starts[-1]), starts[:-1]


def _fold(df: DataFrame, todo) -> DataFrame:
    """Symbols come sorted, many to a batch: a group of its own for each would cost more than its bars."""
    outs = [o for _, os, _ in todo for o in os]
    values = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]

    def run(batches):
        for rows, starts in _symbols(batches):
            pdf = rows.select(values).to_pandas()
            cols = {o: np.full(len(pdf), np.nan) for o in outs}
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                g = pdf.iloc[lo:hi].reset_index(drop=True)
                for ind, os, p in todo:
                    res = ind.fn(g, **p)
                    for o, v in zip(os, res if isinstance(res, tuple) else (res,)):
                        cols[o][lo:hi] = v
            for o, v in cols.items():
                # NaN marks "no value" inside pandas; outside it is SQL NULL
                rows = rows.append_column(o, pa.array(v, mask=~np.isfinite(v)))
            yield from rows.to_batches()

    dealt = df.repartition("sym").sortWithinPartitions(F.asc("sym"), F.asc_nulls_last("date"))
    schema = StructType([*df.schema.fields, *[StructField(o, DoubleType()) for o in outs]])
    return dealt.mapInArrow(run, schema)


# ---- window helpers ----------------------------------------------------


def rolled(agg, x, n: int) -> Column:
    """Aggregate over n full rows, else null."""
    x = F.col(x) if isinstance(x, str) else x
    w = last_rows(n)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def lagged(x: str, k: int = 1) -> Column:
    return F.lag(x, k).over(by_sym())


def index() -> Column:
    return F.row_number().over(by_sym()).cast("double")


def true_range() -> Column:
    prev = lagged("close")
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


# ---- windowed indicators ----------------------------------------------


def _simple(name, agg, period=30, source="close"):
    @windowed(name, timeperiod=period, source=source)
    def fn(df, outs, timeperiod, source):
        return df.withColumn(outs[0], rolled(agg, source, timeperiod))


_simple("SMA", F.avg)
_simple("STDDEV", F.stddev_samp, 20)
_simple("VAR", F.var_samp, 20)
_simple("MAX", F.max)
_simple("MIN", F.min)
_simple("SUM", F.sum)
_simple("SKEW", F.skewness)


@windowed("MIDPOINT", timeperiod=14, source="close")
def _midpoint(df, outs, timeperiod, source):
    return df.withColumn(outs[0], (rolled(F.max, source, timeperiod) + rolled(F.min, source, timeperiod)) / 2)


@windowed("MIDPRICE", timeperiod=14)
def _midprice(df, outs, timeperiod):
    return df.withColumn(outs[0], (rolled(F.max, "high", timeperiod) + rolled(F.min, "low", timeperiod)) / 2)


def _price(name, expr):
    @windowed(name)
    def fn(df, outs):
        return df.withColumn(outs[0], expr())


_c = F.col
_price("AVGPRICE", lambda: (_c("open") + _c("high") + _c("low") + _c("close")) / 4)
_price("MEDPRICE", lambda: (_c("high") + _c("low")) / 2)
_price("TYPPRICE", lambda: (_c("high") + _c("low") + _c("close")) / 3)
_price("WCLPRICE", lambda: (_c("high") + _c("low") + 2 * _c("close")) / 4)
_price("BOP", lambda: F.try_divide(_c("close") - _c("open"), _c("high") - _c("low")))
_price("LOGPRICE", lambda: F.ln("close"))
_price("HL_RANGE", lambda: _c("high") - _c("low"))
_price("TRANGE", true_range)
_price("CUMRET", lambda: F.try_divide(_c("close"), F.first("close").over(to_here())) - 1)
_price("DRAWDOWN", lambda: F.try_divide(_c("close"), F.max("close").over(to_here())) - 1)
_price("LOGRET", lambda: F.ln(F.try_divide(_c("close"), lagged("close"))))
_price("GAP", lambda: F.try_divide(_c("open"), lagged("close")) - 1)


def _change(name, expr, period=10):
    @windowed(name, timeperiod=period, source="close")
    def fn(df, outs, timeperiod, source):
        return df.withColumn(outs[0], expr(F.col(source), F.lag(source, timeperiod).over(by_sym())))


_change("MOM", lambda x, p: x - p)
_change("ROC", lambda x, p: 100 * (F.try_divide(x, p) - 1))
_change("ROCP", lambda x, p: F.try_divide(x, p) - 1)
_change("ROCR", lambda x, p: F.try_divide(x, p))
_change("ROCR100", lambda x, p: 100 * F.try_divide(x, p))
_change("RETURN", lambda x, p: F.try_divide(x, p) - 1, 1)


@windowed("BBANDS", "upper", "middle", "lower", timeperiod=5, nbdevup=2.0, nbdevdn=2.0, matype=0)
def _bbands(df, outs, timeperiod, nbdevup, nbdevdn, matype):
    if matype not in (0, 1):
        raise ValueError("matype 0 (simple) or 1 (exponential)")
    if matype == 1:
        df = indicator(df, "EMA", prefix="_mid", timeperiod=timeperiod)
        mid = F.col("_mid")
    else:
        mid = rolled(F.avg, "close", timeperiod)
    dev = rolled(F.stddev_pop, "close", timeperiod)
    return (
        df.withColumn(outs[0], mid + nbdevup * dev)
        .withColumn(outs[1], mid)
        .withColumn(outs[2], mid - nbdevdn * dev)
    )


@windowed("STOCHF", "k", "d", fastk_period=5, fastd_period=3)
def _stochf(df, outs, fastk_period, fastd_period):
    hi, lo = rolled(F.max, "high", fastk_period), rolled(F.min, "low", fastk_period)
    df = df.withColumn(outs[0], 100 * F.try_divide(F.col("close") - lo, hi - lo))
    return df.withColumn(outs[1], rolled(F.avg, outs[0], fastd_period))


@windowed("STOCH", "k", "d", fastk_period=9, slowk_period=3, slowd_period=3)
def _stoch(df, outs, fastk_period, slowk_period, slowd_period):
    hi, lo = rolled(F.max, "high", fastk_period), rolled(F.min, "low", fastk_period)
    df = df.withColumn("_fastk", 100 * F.try_divide(F.col("close") - lo, hi - lo))
    df = df.withColumn(outs[0], rolled(F.avg, "_fastk", slowk_period))
    return df.withColumn(outs[1], rolled(F.avg, outs[0], slowd_period))


@windowed("WILLR", timeperiod=14)
def _willr(df, outs, timeperiod):
    hi, lo = rolled(F.max, "high", timeperiod), rolled(F.min, "low", timeperiod)
    return df.withColumn(outs[0], -100 * F.try_divide(hi - F.col("close"), hi - lo))


@windowed("ATR", timeperiod=14)
def _atr(df, outs, timeperiod):
    """Simple mean of the true range; ATR_WILDER has the smoothed form."""
    return df.withColumn("_tr", true_range()).withColumn(outs[0], rolled(F.avg, "_tr", timeperiod))


@windowed("NATR", timeperiod=14)
def _natr(df, outs, timeperiod):
    df = df.withColumn("_tr", true_range())
    return df.withColumn(outs[0], 100 * F.try_divide(rolled(F.avg, "_tr", timeperiod), F.col("close")))


@windowed("ULTOSC", timeperiod1=7, timeperiod2=14, timeperiod3=28)
def _ultosc(df, outs, timeperiod1, timeperiod2, timeperiod3):
    prev = lagged("close")
    df = df.withColumn("_tr", true_range()).withColumn("_bp", F.col("close") - F.least(F.col("low"), prev))

    def q(n):
        return F.try_divide(rolled(F.sum, "_bp", n), rolled(F.sum, "_tr", n))

    return df.withColumn(outs[0], 100 * (4 * q(timeperiod1) + 2 * q(timeperiod2) + q(timeperiod3)) / 7)


@windowed("RSI_SIMPLE", timeperiod=14)
def _rsi_simple(df, outs, timeperiod):
    d = F.col("close") - lagged("close")
    df = df.withColumn("_g", F.greatest(d, F.lit(0.0))).withColumn("_l", F.greatest(-d, F.lit(0.0)))
    # the first bar has no change: greatest() ignores null, so mask it
    first = lagged("close").isNull()
    df = df.withColumn("_g", F.when(~first, F.col("_g"))).withColumn("_l", F.when(~first, F.col("_l")))
    g, l = rolled(F.avg, "_g", timeperiod), rolled(F.avg, "_l", timeperiod)
    return df.withColumn(outs[0], rsi_value(g, l))


def rsi_value(g: Column, l: Column) -> Column:
    return F.when(l == 0, F.when(g == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.try_divide(g, l)))


@windowed("CMO", timeperiod=14)
def _cmo(df, outs, timeperiod):
    d = F.col("close") - lagged("close")
    df = df.withColumn("_d", d)
    up = rolled(F.sum, F.greatest(F.col("_d"), F.when(F.col("_d").isNotNull(), 0.0)), timeperiod)
    move = rolled(F.sum, F.abs("_d"), timeperiod)
    return df.withColumn(outs[0], 100 * F.try_divide(2 * up - move, move))


@windowed("CCI", timeperiod=20)
def _cci(df, outs, timeperiod):
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumn("_m", rolled(F.avg, "_tp", timeperiod))
    df = df.withColumn("_list", F.collect_list("_tp").over(last_rows(timeperiod)))
    dev = F.aggregate("_list", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / timeperiod
    return df.withColumn(outs[0], F.try_divide(F.col("_tp") - F.col("_m"), 0.015 * dev))


def _weighted(df: DataFrame, out: str, x: str, n: int) -> DataFrame:
    """Mean of the last n rows with weights 1 to n."""
    df = df.withColumn("_i", index()).withColumn("_iy", F.col("_i") * F.col(x))
    s = rolled(F.sum, "_iy", n) - (F.col("_i") - n) * rolled(F.sum, x, n)
    return df.withColumn(out, s / (n * (n + 1) / 2))


@windowed("WMA", timeperiod=30, source="close")
def _wma(df, outs, timeperiod, source):
    return _weighted(df, outs[0], source, timeperiod)


@windowed("HMA", timeperiod=16, source="close")
def _hma(df, outs, timeperiod, source):
    """Weighted mean of twice the half-length mean less the full one, over the root of the length."""
    df = _weighted(_weighted(df, "_half", source, timeperiod // 2), "_full", source, timeperiod)
    return _weighted(df.withColumn("_lead", 2 * F.col("_half") - F.col("_full")), outs[0], "_lead", isqrt(timeperiod))


@windowed("TRIMA", timeperiod=30, source="close")
def _trima(df, outs, timeperiod, source):
    """Mean of a mean, the two lengths adding up to one more than the period."""
    first = (timeperiod + 1) // 2
    df = df.withColumn("_inner", rolled(F.avg, source, first))
    return df.withColumn(outs[0], rolled(F.avg, "_inner", timeperiod + 1 - first))


@windowed("ICHIMOKU", "conversion", "base", "span_a", "span_b", conversion=9, base=26, span=52)
def _ichimoku(df, outs, conversion, base, span):
    """Middles of three ranges; both spans are those of ``base`` bars ago."""
    def middle(n):
        return (rolled(F.max, "high", n) + rolled(F.min, "low", n)) / 2

    df = df.withColumn(outs[0], middle(conversion)).withColumn(outs[1], middle(base)).withColumn("_long", middle(span))
    df = df.withColumn("_lead", (F.col(outs[0]) + F.col(outs[1])) / 2)
    return df.withColumn(outs[2], lagged("_lead", base)).withColumn(outs[3], lagged("_long", base))


# ---- candle patterns -----------------------------------------------------

#: Shapes of a bar (o, h, l, c) and the two before it (o1 ..., o2 ...): 100 bullish, -100 bearish, 0 no match; null without
#: the bars it needs. Each is a condition over neighbouring rows, in SQL.
PATTERNS = {
    "CDLDOJI": (0, "CASE WHEN abs(c - o) <= 0.1 * (h - l) THEN 100 ELSE 0 END"),
    "CDLMARUBOZU": (0, "CASE WHEN h > l AND abs(c - o) >= 0.95 * (h - l) THEN sign(c - o) * 100 ELSE 0 END"),
    "CDLHAMMER": (0, "CASE WHEN c <> o AND least(o, c) - l >= 2 * abs(c - o) AND h - greatest(o, c) <= 0.1 * (h - l) THEN 100 ELSE 0 END"),
    "CDLSHOOTINGSTAR": (0, "CASE WHEN c <> o AND h - greatest(o, c) >= 2 * abs(c - o) AND least(o, c) - l <= 0.1 * (h - l) THEN -100 ELSE 0 END"),
    "CDLSPINNINGTOP": (0, "CASE WHEN abs(c - o) <= 0.3 * (h - l) AND h - greatest(o, c) > abs(c - o) AND least(o, c) - l > abs(c - o) THEN sign(c - o) * 100 ELSE 0 END"),
    "CDLENGULFING": (1, "CASE WHEN c > o AND c1 < o1 AND c >= o1 AND o <= c1 THEN 100 WHEN c < o AND c1 > o1 AND o >= c1 AND c <= o1 THEN -100 ELSE 0 END"),
    "CDLHARAMI": (1, "CASE WHEN c1 < o1 AND c > o AND o > c1 AND c < o1 THEN 100 WHEN c1 > o1 AND c < o AND o < c1 AND c > o1 THEN -100 ELSE 0 END"),
    "CDLPIERCING": (1, "CASE WHEN c1 < o1 AND c > o AND o < c1 AND c > (o1 + c1) / 2 AND c < o1 THEN 100 ELSE 0 END"),
    "CDLDARKCLOUDCOVER": (1, "CASE WHEN c1 > o1 AND c < o AND o > c1 AND c < (o1 + c1) / 2 AND c > o1 THEN -100 ELSE 0 END"),
    "CDLMORNINGSTAR": (2, "CASE WHEN c2 < o2 AND abs(c1 - o1) <= 0.3 * (o2 - c2) AND greatest(o1, c1) <= c2 AND c > o AND c > (o2 + c2) / 2 THEN 100 ELSE 0 END"),
    "CDLEVENINGSTAR": (2, "CASE WHEN c2 > o2 AND abs(c1 - o1) <= 0.3 * (c2 - o2) AND least(o1, c1) >= c2 AND c < o AND c < (o2 + c2) / 2 THEN -100 ELSE 0 END"),
    "CDL3WHITESOLDIERS": (2, "CASE WHEN c > o AND c1 > o1 AND c2 > o2 AND c > c1 AND c1 > c2 THEN 100 ELSE 0 END"),
    "CDL3BLACKCROWS": (2, "CASE WHEN c < o AND c1 < o1 AND c2 < o2 AND c < c1 AND c1 < c2 THEN -100 ELSE 0 END"),
}
_BAR = {"o": "open", "h": "high", "l": "low", "c": "close"}


def _pattern(name: str, back: int, condition: str) -> None:
    @windowed(name)
    def fn(df, outs):
        shape = {f"{k}{i or ''}": F.col(v) if not i else lagged(v, i) for i in range(back + 1) for k, v in _BAR.items()}
        d = df.withColumns(shape)
        return d.withColumn(outs[0], F.when(F.col(f"o{back or ''}").isNotNull(), F.expr(condition).cast("double"))).drop(*shape)


for _name, (_back, _condition) in PATTERNS.items():
    _pattern(_name, _back, _condition)


def _regression(name, expr):
    @windowed(name, timeperiod=14, source="close")
    def fn(df, outs, timeperiod, source):
        n, w = timeperiod, last_rows(timeperiod)
        df = df.withColumn("_i", index())
        full = F.count(source).over(w) == n
        slope = F.regr_slope(source, "_i").over(w)
        mean = F.avg(source).over(w)
        return df.withColumn(outs[0], F.when(full, expr(slope, mean, n)))


_regression("LINEARREG_SLOPE", lambda b, m, n: b)
_regression("LINEARREG", lambda b, m, n: m + b * (n - 1) / 2)
_regression("LINEARREG_INTERCEPT", lambda b, m, n: m - b * (n - 1) / 2)
_regression("LINEARREG_ANGLE", lambda b, m, n: F.degrees(F.atan(b)))
_regression("TSF", lambda b, m, n: m + b * (n + 1) / 2)


@windowed("AROON", "down", "up", timeperiod=14)
def _aroon(df, outs, timeperiod):
    w = last_rows(timeperiod + 1)
    df = df.withColumn("_i", index())
    full = F.count("close").over(w) == timeperiod + 1
    at_low = F.min_by("_i", F.struct("low", -F.col("_i"))).over(w)
    at_high = F.max_by("_i", F.struct("high", "_i")).over(w)

    def pct(at):
        return F.when(full, 100 * (timeperiod - (F.col("_i") - at)) / timeperiod)

    return df.withColumn(outs[0], pct(at_low)).withColumn(outs[1], pct(at_high))


@windowed("AROONOSC", timeperiod=14)
def _aroonosc(df, outs, timeperiod):
    df = _aroon(df, ["_ad", "_au"], timeperiod)
    return df.withColumn(outs[0], F.col("_au") - F.col("_ad"))


@windowed("MAXINDEX", timeperiod=30)
def _maxindex(df, outs, timeperiod):
    df = df.withColumn("_i", index())
    w = last_rows(timeperiod)
    return df.withColumn(outs[0], F.when(F.count("close").over(w) == timeperiod,
                                         F.max_by("_i", F.struct("close", "_i")).over(w)))


@windowed("MININDEX", timeperiod=30)
def _minindex(df, outs, timeperiod):
    df = df.withColumn("_i", index())
    w = last_rows(timeperiod)
    return df.withColumn(outs[0], F.when(F.count("close").over(w) == timeperiod,
                                         F.min_by("_i", F.struct("close", -F.col("_i"))).over(w)))


@windowed("CORREL", timeperiod=30)
def _correl(df, outs, timeperiod):
    w = last_rows(timeperiod)
    return df.withColumn(outs[0], F.when(F.count("close").over(w) == timeperiod, correlation_of("high", "low", w)))


@windowed("BETA", timeperiod=5)
def _beta(df, outs, timeperiod):
    w = last_rows(timeperiod)
    df = df.withColumn("_x", F.try_divide("low", lagged("low")) - 1).withColumn(
        "_y", F.try_divide("high", lagged("high")) - 1)
    return df.withColumn(outs[0], F.when(F.count("_x").over(w) == timeperiod, F.regr_slope("_y", "_x").over(w)))


@windowed("OBV")
def _obv(df, outs):
    s = F.sign(F.col("close") - lagged("close"))
    df = df.withColumn("_sv", F.coalesce(s, F.lit(1.0)) * F.col("volume"))
    return df.withColumn(outs[0], F.sum("_sv").over(to_here()))


def _flow() -> Column:
    rng = F.col("high") - F.col("low")
    return F.coalesce(F.try_divide(2 * F.col("close") - F.col("low") - F.col("high"), rng), F.lit(0.0)) * F.col("volume")


@windowed("AD")
def _ad(df, outs):
    return df.withColumn(outs[0], F.sum(_flow()).over(to_here()))


@windowed("CMF", timeperiod=20)
def _cmf(df, outs, timeperiod):
    return df.withColumn(outs[0], F.try_divide(rolled(F.sum, _flow(), timeperiod), rolled(F.sum, "volume", timeperiod)))


@windowed("MFI", timeperiod=14)
def _mfi(df, outs, timeperiod):
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("_tp", tp).withColumn("_d", F.col("_tp") - lagged("_tp"))
    flow = F.col("_tp") * F.col("volume")
    df = df.withColumn("_pos", F.when(F.col("_d") > 0, flow).when(F.col("_d").isNotNull(), 0.0)).withColumn(
        "_neg", F.when(F.col("_d") < 0, flow).when(F.col("_d").isNotNull(), 0.0))
    p, q = rolled(F.sum, "_pos", timeperiod), rolled(F.sum, "_neg", timeperiod)
    return df.withColumn(outs[0], 100 * F.try_divide(p, p + q))


@windowed("VWMA", timeperiod=20)
def _vwma(df, outs, timeperiod):
    return df.withColumn(outs[0], F.try_divide(
        rolled(F.sum, F.col("close") * F.col("volume"), timeperiod), rolled(F.sum, "volume", timeperiod)))


@windowed("DONCHIAN", "upper", "middle", "lower", timeperiod=20)
def _donchian(df, outs, timeperiod):
    hi, lo = rolled(F.max, "high", timeperiod), rolled(F.min, "low", timeperiod)
    return df.withColumn(outs[0], hi).withColumn(outs[1], (hi + lo) / 2).withColumn(outs[2], lo)


@windowed("ZSCORE", timeperiod=20, source="close")
def _zscore(df, outs, timeperiod, source):
    m, s = rolled(F.avg, source, timeperiod), rolled(F.stddev_samp, source, timeperiod)
    return df.withColumn(outs[0], F.try_divide(F.col(source) - m, s))


@windowed("BIAS", timeperiod=20)
def _bias(df, outs, timeperiod):
    return df.withColumn(outs[0], F.try_divide("close", rolled(F.avg, "close", timeperiod)) - 1)


@windowed("PSY", timeperiod=12)
def _psy(df, outs, timeperiod):
    df = df.withColumn("_up", (F.col("close") > lagged("close")).cast("double"))
    return df.withColumn(outs[0], 100 * rolled(F.avg, "_up", timeperiod))


@windowed("ER", timeperiod=10)
def _er(df, outs, timeperiod):
    df = df.withColumn("_step", F.abs(F.col("close") - lagged("close")))
    move = F.abs(F.col("close") - lagged("close", timeperiod))
    return df.withColumn(outs[0], F.try_divide(move, rolled(F.sum, "_step", timeperiod)))


@windowed("VORTEX", "plus", "minus", timeperiod=14)
def _vortex(df, outs, timeperiod):
    df = (df.withColumn("_tr", true_range())
          .withColumn("_p", F.abs(F.col("high") - lagged("low")))
          .withColumn("_m", F.abs(F.col("low") - lagged("high"))))
    tr = rolled(F.sum, "_tr", timeperiod)
    return df.withColumn(outs[0], F.try_divide(rolled(F.sum, "_p", timeperiod), tr)).withColumn(
        outs[1], F.try_divide(rolled(F.sum, "_m", timeperiod), tr))


@windowed("CHOP", timeperiod=14)
def _chop(df, outs, timeperiod):
    n = timeperiod
    df = df.withColumn("_tr", true_range())
    rng = rolled(F.max, "high", n) - rolled(F.min, "low", n)
    return df.withColumn(outs[0], 100 * F.log10(F.try_divide(rolled(F.sum, "_tr", n), rng)) / float(np.log10(n)))


@windowed("PERCENT_RANK", timeperiod=50)
def _prank(df, outs, timeperiod):
    df = df.withColumn("_list", F.collect_list("close").over(last_rows(timeperiod)))
    below = F.size(F.filter("_list", lambda x: x < F.col("close")))
    return df.withColumn(outs[0], F.when(F.size("_list") == timeperiod, below / F.lit(timeperiod - 1)))


@windowed("QUANTILE", timeperiod=30, q=0.5)
def _quantile(df, outs, timeperiod, q):
    """Linear interpolation between the two rows around position (n - 1) q."""
    n = timeperiod
    df = df.withColumn("_list", F.sort_array(F.collect_list("close").over(last_rows(n))))
    at = (n - 1) * q
    lo, frac = int(at), at - int(at)
    a, b = F.get("_list", F.lit(lo)), F.get("_list", F.lit(min(lo + 1, n - 1)))
    return df.withColumn(outs[0], F.when(F.size("_list") == n, a + (b - a) * frac))


@windowed("MEDIAN", timeperiod=30)
def _median(df, outs, timeperiod):
    return _quantile(df, outs, timeperiod, 0.5)


@windowed("EOM", timeperiod=14)
def _eom(df, outs, timeperiod):
    mid = (F.col("high") + F.col("low")) / 2
    df = df.withColumn("_mid", mid)
    df = df.withColumn("_e", F.try_divide((F.col("_mid") - lagged("_mid")) * (F.col("high") - F.col("low")), F.col("volume")))
    return df.withColumn(outs[0], rolled(F.avg, "_e", timeperiod))


@windowed("PVT")
def _pvt(df, outs):
    df = df.withColumn("_v", F.coalesce(F.try_divide("close", lagged("close")) - 1, F.lit(0.0)) * F.col("volume"))
    return df.withColumn(outs[0], F.sum("_v").over(to_here()))


@windowed("NEW_HIGH", timeperiod=250)
def _new_high(df, outs, timeperiod):
    return df.withColumn(outs[0], (F.col("high") == rolled(F.max, "high", timeperiod)).cast("double"))


@windowed("REALVOL", timeperiod=20, periods=252)
def _realvol(df, outs, timeperiod, periods):
    df = df.withColumn("_r", F.try_divide("close", lagged("close")) - 1)
    return df.withColumn(outs[0], rolled(F.stddev_samp, "_r", timeperiod) * float(np.sqrt(periods)))


# ---- recursive indicators ---------------------------------------------


def smooth(x, alpha: float) -> np.ndarray:
    """e_1 = x_1, e_t = alpha x_t + (1 - alpha) e_(t-1), from the first value on."""
    return pd.Series(np.asarray(x, dtype=float)).ewm(alpha=alpha, adjust=False, ignore_na=False).mean().to_numpy()


def ema(x, n: int) -> np.ndarray:
    return smooth(x, 2.0 / (n + 1))


def wilder(x, n: int) -> np.ndarray:
    return smooth(x, 1.0 / n)


def _after(x: np.ndarray, n: int) -> np.ndarray:
    """Mask the first n rows: the window is not complete there."""
    x = np.array(x, dtype=float)
    x[:n] = np.nan
    return x


def _ratio(a, b):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    return np.divide(a, b, out=np.full(len(a), np.nan), where=(b != 0) & ~np.isnan(b))


def _tr(g) -> np.ndarray:
    prev = g["close"].shift(1)
    return np.nanmax(np.vstack([g["high"] - g["low"], (g["high"] - prev).abs(), (g["low"] - prev).abs()]), axis=0)


@recursive("EMA", timeperiod=30, source="close")
def _ema(g, timeperiod, source):
    return _after(ema(g[source], timeperiod), timeperiod - 1)


@recursive("RSI", timeperiod=14)
def _rsi(g, timeperiod):
    d = g["close"].diff().to_numpy(dtype=float)
    up, dn = wilder(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), timeperiod), wilder(
        np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), timeperiod)
    r = 100 - 100 / (1 + _ratio(up, dn))
    r = np.where(dn == 0, np.where(up == 0, 50.0, 100.0), r)
    return _after(r, timeperiod)


@recursive("STOCHRSI", "k", "d", timeperiod=14, fastk_period=5, fastd_period=3)
def _stochrsi(g, timeperiod, fastk_period, fastd_period):
    r = pd.Series(_rsi(g, timeperiod))
    lo, hi = r.rolling(fastk_period).min(), r.rolling(fastk_period).max()
    k = pd.Series(100 * _ratio(r - lo, hi - lo))
    return k, k.rolling(fastd_period).mean()


@recursive("MACD", "line", "signal", "hist", fastperiod=12, slowperiod=26, signalperiod=9)
def _macd(g, fastperiod, slowperiod, signalperiod):
    line = ema(g["close"], fastperiod) - ema(g["close"], slowperiod)
    sig = ema(line, signalperiod)
    n = slowperiod + signalperiod - 2
    return _after(line, slowperiod - 1), _after(sig, n), _after(line - sig, n)


@recursive("APO", fastperiod=12, slowperiod=26)
def _apo(g, fastperiod, slowperiod):
    return ema(g["close"], fastperiod) - ema(g["close"], slowperiod)


@recursive("PPO", fastperiod=12, slowperiod=26)
def _ppo(g, fastperiod, slowperiod):
    slow = ema(g["close"], slowperiod)
    return 100 * _ratio(ema(g["close"], fastperiod) - slow, slow)


@recursive("DEMA", timeperiod=30)
def _dema(g, timeperiod):
    e = ema(g["close"], timeperiod)
    return _after(2 * e - ema(e, timeperiod), timeperiod - 1)


@recursive("TEMA", timeperiod=30)
def _tema(g, timeperiod):
    e1 = ema(g["close"], timeperiod)
    e2 = ema(e1, timeperiod)
    return _after(3 * e1 - 3 * e2 + ema(e2, timeperiod), timeperiod - 1)


@recursive("TRIX", timeperiod=30)
def _trix(g, timeperiod):
    e = pd.Series(ema(ema(ema(g["close"], timeperiod), timeperiod), timeperiod))
    return _after(100 * _ratio(e - e.shift(1), e.shift(1)), timeperiod)


@recursive("ATR_WILDER", timeperiod=14)
def _atr_wilder(g, timeperiod):
    return _after(wilder(_tr(g), timeperiod), timeperiod - 1)


def _directional(g, n):
    up, dn = g["high"].diff().to_numpy(), (-g["low"].diff()).to_numpy()
    pdm = np.where((up > dn) & (up > 0), up, 0.0)
    mdm = np.where((dn > up) & (dn > 0), dn, 0.0)
    atr = wilder(_tr(g), n)
    p, m = 100 * _ratio(wilder(pdm, n), atr), 100 * _ratio(wilder(mdm, n), atr)
    return p, m, 100 * _ratio(np.abs(p - m), p + m)


@recursive("PLUS_DI", timeperiod=14)
def _plus_di(g, timeperiod):
    return _after(_directional(g, timeperiod)[0], timeperiod)


@recursive("MINUS_DI", timeperiod=14)
def _minus_di(g, timeperiod):
    return _after(_directional(g, timeperiod)[1], timeperiod)


@recursive("DX", timeperiod=14)
def _dx(g, timeperiod):
    return _after(_directional(g, timeperiod)[2], timeperiod)


@recursive("ADX", timeperiod=14)
def _adx(g, timeperiod):
    return _after(wilder(_directional(g, timeperiod)[2], timeperiod), 2 * timeperiod - 1)


@recursive("ADOSC", fastperiod=3, slowperiod=10)
def _adosc(g, fastperiod, slowperiod):
    rng = g["high"] - g["low"]
    ad = (pd.Series(_ratio(2 * g["close"] - g["low"] - g["high"], rng)).fillna(0) * g["volume"]).cumsum()
    return ema(ad, fastperiod) - ema(ad, slowperiod)


@recursive("KELTNER", "upper", "middle", "lower", timeperiod=20, mult=2.0)
def _keltner(g, timeperiod, mult):
    m, a = ema(g["close"], timeperiod), ema(_tr(g), timeperiod)
    return _after(m + mult * a, timeperiod - 1), _after(m, timeperiod - 1), _after(m - mult * a, timeperiod - 1)


@recursive("EWMVAR", decay=0.94)
def _ewmvar(g, decay):
    """Exponentially weighted variance of the one-bar return."""
    r = g["close"] / g["close"].shift(1) - 1
    return smooth(r * r, 1 - decay)


@recursive("KAMA", timeperiod=30)
def _kama(g, timeperiod):
    c = g["close"].to_numpy(dtype=float)
    er = _ratio(g["close"].diff(timeperiod).abs(), g["close"].diff().abs().rolling(timeperiod).sum())
    fast, slow = 2 / 3, 2 / 31
    sc = (np.nan_to_num(er) * (fast - slow) + slow) ** 2
    out = c.copy()
    for i in range(1, len(c)):
        out[i] = c[i] if i < timeperiod else out[i - 1] + sc[i] * (c[i] - out[i - 1])
    return _after(out, timeperiod)


@recursive("SUPERTREND", "line", "direction", timeperiod=10, mult=3.0)
def _supertrend(g, timeperiod, mult):
    """Trailing band: it only tightens while the trend lasts, a close beyond
    it flips the side."""
    c = g["close"].to_numpy(dtype=float)
    mid = ((g["high"] + g["low"]) / 2).to_numpy(dtype=float)
    width = mult * wilder(_tr(g), timeperiod)
    line, side = np.full(len(c), np.nan), np.full(len(c), np.nan)
    up, dn, s = np.nan, np.nan, 1.0
    for i in range(timeperiod - 1, len(c)):
        floor, cap = mid[i] - width[i], mid[i] + width[i]
        if not np.isnan(dn):
            floor = max(floor, dn) if c[i - 1] >= dn else floor
            cap = min(cap, up) if c[i - 1] <= up else cap
            s = -1.0 if s > 0 and c[i] < floor else 1.0 if s < 0 and c[i] > cap else s
        dn, up = floor, cap
        line[i], side[i] = (dn if s > 0 else up), s
    return line, side


@recursive("SAR", acceleration=0.02, maximum=0.2)
def _sar(g, acceleration, maximum):
    h, l = g["high"].to_numpy(dtype=float), g["low"].to_numpy(dtype=float)
    n = len(h)
    out = np.full(n, np.nan)
    if n < 2:
        return out
    long_, af = True, acceleration
    ep, sar = max(h[0], h[1]), l[0]
    for i in range(1, n):
        sar = sar + af * (ep - sar)
        lo = min(l[i - 1], l[max(i - 2, 0)])
        hi = max(h[i - 1], h[max(i - 2, 0)])
        sar = min(sar, lo) if long_ else max(sar, hi)
        if (long_ and l[i] < sar) or (not long_ and h[i] > sar):
            long_, sar, af = not long_, ep, acceleration
            ep = h[i] if long_ else l[i]
        elif (long_ and h[i] > ep) or (not long_ and l[i] < ep):
            ep = h[i] if long_ else l[i]
            af = min(af + acceleration, maximum)
        out[i] = sar
    return out
