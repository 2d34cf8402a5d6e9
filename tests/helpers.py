"""Small panels and comparison helpers."""

import datetime as dt

import numpy as np
import pandas as pd

DAY0 = dt.date(2020, 1, 3)  # a Friday


def friday(i):
    return DAY0 + dt.timedelta(days=7 * i)


def panel(spark, series, **more):
    """series: {sym: [close, ...]}; open/high/low default to the close."""
    rows = [(friday(i), s, float(c)) for s, cs in series.items() for i, c in enumerate(cs) if c is not None]
    d = pd.DataFrame(rows, columns=["date", "sym", "close"])
    for c in ("open", "high", "low"):
        d[c] = d["close"] if c not in more else [float(more[c][s][i]) for s, cs in series.items() for i, x in enumerate(cs) if x is not None]
    d["volume"] = 1.0
    return spark.createDataFrame(d, "date date, sym bigint, close double, open double, high double, low double, volume double")


def values(df, col, by="date"):
    return [x[col] for x in df.orderBy(by).collect()]


def normalised(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if str(s.dtype).startswith("datetime"):
            df[c] = s.dt.strftime("%Y-%m-%d %H:%M:%S.%f").str.replace(" 00:00:00.000000", "")
        elif s.dtype == object:
            df[c] = s.map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns), na_position="first", ignore_index=True, kind="stable")


def assert_equal(got: pd.DataFrame, want: pd.DataFrame):
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    g, w = normalised(got), normalised(want)
    for c in g.columns:
        x, y = g[c], w[c]
        if x.dtype.kind in "fiu" and y.dtype.kind in "fiu":
            ok = (x.isna() & y.isna()) | (x.astype(float) == y.astype(float))
        else:
            ok = (x.isna() & y.isna()) | (x.astype(str) == y.astype(str))
        assert ok.all(), (c, x[~ok].head(3).tolist(), y[~ok].head(3).tolist())
