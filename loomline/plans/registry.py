"""Named queries over the parquet tables and their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.plans.sqlviews import VIEWS
from loomline.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and, where there is one, its SQL."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = with_views(sql)
        return fn

    return deco


def with_views(body: str) -> str:
    """Prefix the view definitions a statement uses."""
    order: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if v not in order and re.search(rf"\b{v}\b", text):
                visit(VIEWS[v])
                order.append(v)

    visit(body)
    body = body.strip()
    recursive = bool(re.match(r"WITH RECURSIVE\b", body, re.I))
    ctes = [f"{v} AS ({VIEWS[v].strip()})" for v in order]
    m = re.match(r"WITH(\s+RECURSIVE)?\s", body, re.I)
    if m:
        body = body[m.end():]
        head = ", ".join(ctes) + (", " if ctes else "")
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}{body}"
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


def r(expr: str, digits: int = 6) -> str:
    """Rounded SQL value without a negative zero; see ``rd`` for the offset."""
    return f"(round({expr} + 3e-{digits + 2}, {digits}) + 0.0)"


def rd(c, digits: int = 6) -> Column:
    """Half-up rounding with a tolerance of 0.03 units, so that the order of a
    floating sum cannot flip an exact half."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(float(f"3e-{digits + 2}")), digits)
