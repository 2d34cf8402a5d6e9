"""Sources, predicates, alignment, bars, selection, set operations."""

from pyspark.sql import functions as F

from loomline.functions.calendar import period_key, season_flags, visible_from
from loomline.functions.indicators import indicator, rolled
from loomline.operators import fundamentals as fund
from loomline.operators import panel as P
from loomline.plans.registry import query, r, rd
from loomline.plans.sqlviews import month, quarter, week
from loomline.session import new_path
from loomline.sources import store, workspace
from loomline.sources.catalog import Catalog


SMA = "CASE WHEN count({x}) OVER w{n} = {n} THEN avg({x}) OVER w{n} END"


def win(*ns):
    return "WINDOW " + ", ".join(
        f"w{n} AS (PARTITION BY sym ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ns
    )


def sma(n, x="close"):
    return SMA.format(x=x, n=n)


@query("momentum_top10", f"""
WITH s AS (SELECT date, sym, close, close / lag(close, 4) OVER (PARTITION BY sym ORDER BY date) - 1 AS mom,
  {sma(10)} AS ma FROM bars_w {win(10)}),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, sym) AS rank
  FROM s WHERE mom IS NOT NULL AND close > ma)
SELECT date, sym, rank, {r('close')} AS close, {r('mom')} AS mom FROM k WHERE rank <= 10""")
def momentum_top10(t):
    b = t.bars("W").select("date", "sym", "close")
    b = indicator(b, "RETURN", prefix="mom", timeperiod=4)
    b = indicator(b, "SMA", prefix="ma", timeperiod=10)
    k = P.top(b.where(F.col("close") > F.col("ma")), "mom", 10)
    return k.select("date", "sym", F.col("rank").cast("bigint").alias("rank"), rd("close").alias("close"), rd("mom").alias("mom"))


# ---- sources ------------------------------------------------------------


@query("s01_get_field", f"SELECT date, sym, {r('close')} AS value FROM bars_w")
def s01(t):
    return Catalog(t).get("price:close").withColumn("value", rd("value"))


@query("s02_get_fields", f"""
SELECT date, sym, {r('close')} AS close, {r('high')} AS high, volume FROM bars_w""")
def s02(t):
    d = Catalog(t).get_many({"close": "price:close", "high": "price:high", "volume": "price:volume"})
    return d.select("date", "sym", rd("close").alias("close"), rd("high").alias("high"), "volume")


@query("s03_search_datasets", """
SELECT 'price:close' AS dataset, count(close) AS n_values, min(date) AS first, max(date) AS last FROM bars_w
UNION ALL SELECT 'daily:close', count(close), min(date), max(date) FROM bars_d""")
def s03(t):
    return Catalog(t).search("clos")


@query("s04_storage_cache", f"""
SELECT date, sym, {r('close')} AS value FROM bars_w""")
def s04(t):
    c = Catalog(t)
    c.set_storage()
    c.get("price:close")
    return c.get("price:close").withColumn("value", rd("value"))  # second read hits the store


@query("s05_universe", """
SELECT u.sym, category, market, count(*) AS n_bars FROM universe u JOIN bars_w USING (sym)
WHERE market IN ('ASIA', 'EUROPE') GROUP BY ALL""")
def s05(t):
    u = Catalog(t).symbols(market=["ASIA", "EUROPE"])
    n = t.bars("W").groupBy("sym").agg(F.count("*").alias("n_bars"))
    return u.join(n, "sym").select("sym", "category", "market", "n_bars")


@query("s06_universe_scope", f"""
SELECT date, sym, {r('close')} AS value FROM bars_w
WHERE sym IN (SELECT sym FROM universe WHERE market = 'ASIA')""")
def s06(t):
    c = Catalog(t)
    with c.universe(market="ASIA"):
        return c.get("price:close").withColumn("value", rd("value"))


@query("s07_workspace_scan", """
SELECT 'epics' AS kind, id, state, priority, 'Epic ' || id || chr(10) || 'size ' || CAST(round(size) AS BIGINT) AS body
FROM epics""")
def s07(t):
    path = new_path(t.spark, "workspace") + "/epics/all"
    e = t.epics().withColumn("_body", F.concat(
        F.lit("Epic "), F.col("id").cast("string"), F.lit("\nsize "), F.round("size").cast("bigint").cast("string")))
    workspace.render(e, ["id", "state", "priority"], "_body").write.option("lineSep", "\f").text(path)
    s = workspace.scan(t.spark, path, record_sep="\f")
    return s.select(
        "kind", F.col("attrs")["id"].cast("bigint").alias("id"), F.trim(F.col("attrs")["state"]).alias("state"),
        F.col("attrs")["priority"].cast("int").alias("priority"), "body",
    )


@query("s08_minute_to_daily", f"""
WITH m AS (SELECT user_id AS sym, date_trunc('minute', ts) AS minute,
    first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2)
SELECT sym, CAST(minute AS DATE) AS date, first(open ORDER BY minute) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY minute) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM m GROUP BY 1, 2""")
def s08(t):
    e = t.events()
    # event ids follow time inside a minute only by tie-break, so order by both
    within = F.struct("ts", "event_id")
    m = e.select("sym", F.date_trunc("minute", "ts").alias("minute"), "price", within.alias("o")).groupBy(
        "sym", "minute").agg(
        F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "o").alias("close"), F.count("*").alias("volume"))
    return m.groupBy("sym", F.to_date("minute").alias("date")).agg(
        F.min_by("open", "minute").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "minute").alias("close"), F.sum("volume").alias("volume"))


@query("s09_store_migration", f"""
SELECT year(date) AS year, count(*) AS n, {r('sum(close)', 3)} AS s FROM bars_d WHERE year(date) >= 1998 GROUP BY 1""")
def s09(t):
    path = new_path(t.spark, "bars")
    store.write_by_year(t.bars("D"), path)
    d = store.read(t.spark, path).where(F.col("year") >= 1998)  # partition pruning
    return d.groupBy(F.col("year").cast("bigint").alias("year")).agg(
        F.count("*").alias("n"), rd(F.sum("close"), 3).alias("s"))


@query("s10_nightly_equity_sink", f"""
SELECT category AS strategy, date, {r('avg(close)')} AS nav FROM bars_m JOIN universe USING (sym) GROUP BY 1, 2""")
def s10(t):
    path = new_path(t.spark, "equity")
    nav = t.bars("M").join(t.universe(), "sym").groupBy(F.col("category").alias("strategy"), "date").agg(
        rd(F.avg("close")).alias("nav"))
    store.write_nightly(nav, path)
    last = nav.where(F.col("date") == nav.agg(F.max("date")).scalar())
    store.write_nightly(last, path)  # the nightly rerun replaces its own partitions only
    return store.read(t.spark, path).select("strategy", F.col("date").cast("date").alias("date"), "nav")


@query("s11_completeness", f"""
WITH z AS (SELECT sym, date, close, (close - avg(close) OVER s) / nullif(stddev_samp(close) OVER s, 0) AS z
  FROM bars_w WINDOW s AS (PARTITION BY sym)),
g AS (SELECT sym, CAST(unnest(generate_series(min(date), (SELECT max(date) FROM bars_w), INTERVAL 7 DAY)) AS DATE) AS date
  FROM bars_w GROUP BY sym)
SELECT sym, count(*) AS expected, count(*) FILTER (z.sym IS NULL) AS missing,
  count(*) FILTER (z.sym IS NOT NULL AND close IS NULL) AS nulls, count(*) FILTER (abs(z) > 3) AS outliers
FROM g LEFT JOIN z USING (sym, date) GROUP BY sym""")
def s11(t):
    from loomline.operators.quality import completeness

    return completeness(t.stored("W").select("date", "sym", "close"), "close", 7, 3.0)


@query("s12_factor_store", f"""
SELECT 'mom' AS factor, year(date) AS year, count(v) AS n, {r('sum(v)', 4)} AS s
FROM (SELECT date, close / lag(close, 4) OVER (PARTITION BY sym ORDER BY date) - 1 AS v FROM bars_w) GROUP BY 2
UNION ALL
SELECT 'ratio', year(date), count(v), {r('sum(v)', 4)}
FROM (SELECT date, close / ({sma(10)}) AS v FROM bars_w {win(10)}) GROUP BY 2""")
def s12(t):
    b = t.bars("W").select("date", "sym", "close")
    b = indicator(b, "RETURN", prefix="mom", timeperiod=4)
    b = indicator(b, "SMA", prefix="ma", timeperiod=10).withColumn("ratio", F.try_divide("close", "ma"))
    long = b.unpivot(["date", "sym"], ["mom", "ratio"], "factor", "value").where(F.col("value").isNotNull())
    path = new_path(t.spark, "factors")
    store.write_by_year(long, path, extra=("factor",))
    return store.read(t.spark, path).groupBy("factor", F.col("year").cast("bigint").alias("year")).agg(
        F.count("value").alias("n"), rd(F.sum("value"), 4).alias("s"))


# ---- projections and predicates -----------------------------------------


@query("p01_compare", f"""
SELECT date, sym, coalesce(close < 1000, false) AS cheap, coalesce(close > ma, false) AS above
FROM (SELECT date, sym, close, {sma(10)} AS ma FROM bars_w {win(10)})""")
def p01(t):
    b = indicator(t.bars("W").select("date", "sym", "close"), "SMA", prefix="ma", timeperiod=10)
    return b.select("date", "sym", P.holds(F.col("close") < 1000).alias("cheap"),
                    P.holds(F.col("close") > F.col("ma")).alias("above"))


@query("p02_boolean_combine", f"""
SELECT date, sym, coalesce(close > ma, false) AND volume > 50 AS both_hold,
  coalesce(close > ma, false) OR volume > 50 AS any_holds
FROM (SELECT date, sym, close, volume, {sma(10)} AS ma FROM bars_w {win(10)})""")
def p02(t):
    b = indicator(t.bars("W").select("date", "sym", "close", "volume"), "SMA", prefix="ma", timeperiod=10)
    up, big = P.holds(F.col("close") > F.col("ma")), P.holds(F.col("volume") > 50)
    return b.select("date", "sym", (up & big).alias("both_hold"), (up | big).alias("any_holds"))


@query("p03_arithmetic", f"""
SELECT date, sym, {r('close * volume', 3)} AS value, {r('(close - open) / nullif(high - low, 0)')} AS body FROM bars_w""")
def p03(t):
    c = F.col
    return t.bars("W").select("date", "sym", rd(c("close") * c("volume"), 3).alias("value"),
                              rd(F.try_divide(c("close") - c("open"), c("high") - c("low"))).alias("body"))


@query("p04_one_symbol", f"SELECT date, {r('close')} AS close FROM bars_w WHERE sym = 7")
def p04(t):
    return t.bars("W").where(F.col("sym") == 7).select("date", rd("close").alias("close"))


@query("p05_mask_dropna", f"""
SELECT date, sym, {r('close')} AS close FROM bars_w WHERE volume > 20
  AND date IN (SELECT date FROM bars_w GROUP BY date HAVING count(close) >= (SELECT max(c) FROM (SELECT count(close) AS c FROM bars_w GROUP BY date)))""")
def p05(t):
    b = t.stored("W").select("date", "sym", "close", "volume")
    widest = b.groupBy("date").agg(F.count("close").alias("c")).agg(F.max("c")).scalar()
    return P.complete_dates(b, "close", widest).where(F.col("volume") > 20).select("date", "sym", rd("close").alias("close"))


@query("p06_liquidity", f"""
SELECT date, sym, coalesce(m > 100000, false) AS liquid
FROM (SELECT date, sym, {sma(30, 'close * volume')} AS m FROM bars_w {win(30)})""")
def p06(t):
    b = t.bars("W").select("date", "sym", "close", "volume")
    m = rolled(F.avg, F.col("close") * F.col("volume"), 30)
    return b.select("date", "sym", P.holds(m > 100000).alias("liquid"))


@query("p07_date_range", f"""
SELECT date, sym, {r('close')} AS close, date > (SELECT max(date) FROM bars_w) - 90 AS recent
FROM bars_w WHERE date BETWEEN DATE '1998-01-01' AND DATE '2001-12-31'""")
def p07(t):
    last = F.date_sub(t.last_date("W"), 90)
    return t.bars("W", "1998-01-01", "2001-12-31").select("date", "sym", rd("close").alias("close"), (F.col("date") > last).alias("recent"))


@query("p07_recent_days", f"""
SELECT date, sym, {r('close')} AS close FROM bars_w WHERE date > (SELECT max(date) FROM bars_w) - 90""")
def p07b(t):
    first = t.spark.range(1).select(F.date_sub(t.last_date("W"), 89).cast("string")).first()[0]
    return t.bars("W", first).select("date", "sym", rd("close").alias("close"))


@query("p08_clip", f"SELECT date, sym, {r('greatest(500, least(3000, close))')} AS value FROM bars_w")
def p08(t):
    return t.bars("W").select("date", "sym", rd(P.clip("close", 500.0, 3000.0)).alias("value"))


@query("p09_negate_rank", """
SELECT date, sym, rank FROM (SELECT date, sym, row_number() OVER (PARTITION BY date ORDER BY close, sym) AS rank FROM bars_w)
WHERE rank <= 5""")
def p09(t):
    b = t.bars("W").select("date", "sym", (-F.col("close")).alias("neg"))
    return P.top(b, "neg", 5).select("date", "sym", F.col("rank").cast("bigint").alias("rank"))


@query("p10_threshold_signal", f"""
SELECT date, sym, coalesce(m > 0.05, false) AS signal FROM (
  SELECT date, sym, close / lag(close, 4) OVER (PARTITION BY sym ORDER BY date) - 1 AS m FROM bars_w)""")
def p10(t):
    from loomline.operators.factors import threshold_signals

    b = indicator(t.bars("W").select("date", "sym", "close"), "RETURN", prefix="prediction", timeperiod=4)
    return threshold_signals(b, 0.05).select("date", "sym", "signal")


@query("p11_season_flags", "SELECT date, sym, " + ", ".join(
    f"CAST(month(date) = {k} AS INTEGER) AS m{k:02d}" for k in range(1, 13)) + " FROM bars_w")
def p11(t):
    return t.bars("W").select("date", "sym", *season_flags("date"))


@query("p12_ratios", f"""
SELECT sym, quarter, {r('(revenue - cost) / nullif(revenue, 0)')} AS gross_margin,
  {r('net / nullif(revenue, 0)')} AS net_margin, {r('net / equity')} AS roe FROM funda""")
def p12(t):
    f = fund.ratios(t.fundamentals())
    return f.select("sym", "quarter", *[rd(c).alias(c) for c in ("gross_margin", "net_margin", "roe")])


@query("p12_price_ratios", f"""
SELECT b.date, b.sym, {r('close / nullif(equity / shares, 0)')} AS pb, {r('close / nullif(net / shares, 0)', 4)} AS pe
FROM bars_w b ASOF LEFT JOIN funda f ON b.sym = f.sym AND b.date >= f.available""")
def p12b(t):
    v = fund.valuation(t.bars("W").select("date", "sym", "close"), t.fundamentals())
    return v.select("date", "sym", rd("pb").alias("pb"), rd("pe", 4).alias("pe"))


@query("p13_growth", f"""
SELECT sym, quarter, {r('revenue / nullif(lag(revenue, 4) OVER q, 0) - 1')} AS revenue_growth,
  {r('ln(shares / lag(shares, 4) OVER q)')} AS net_issuance
FROM funda WINDOW q AS (PARTITION BY sym ORDER BY quarter)""")
def p13(t):
    g = fund.growth(t.fundamentals())
    return g.select("sym", "quarter", rd("revenue_growth").alias("revenue_growth"), rd("net_issuance").alias("net_issuance"))


# ---- joins ---------------------------------------------------------------


@query("j01_align_frequencies", f"""
SELECT w.date, w.sym, {r('w.close')} AS close, {r('m.close')} AS month_close
FROM bars_w w ASOF LEFT JOIN bars_m m ON w.sym = m.sym AND w.date >= m.date""")
def j01(t):
    d = t.stored("D")  # one scan of the trade rows feeds both
    w = P.rollup_bars(d, "W").select("date", "sym", "close")
    m = P.rollup_bars(d, "M").select("date", "sym", F.col("close").alias("month_close"))
    return P.as_of(w, m, ["month_close"]).select("date", "sym", rd("close").alias("close"), rd("month_close").alias("month_close"))


@query("j02_reporting_lag", f"""
SELECT b.date, b.sym, f.quarter, {r('f.net', 3)} AS net
FROM bars_w b ASOF LEFT JOIN funda f ON b.sym = f.sym AND b.date >= f.available""")
def j02(t):
    b = t.bars("W").select("date", "sym")
    return P.as_of(b, fund.with_lag(t.fundamentals(), 45), ["quarter", "net"], "available").select(
        "date", "sym", "quarter", rd("net", 3).alias("net"))


@query("j03_combine", f"""
WITH a AS (SELECT sym, {month('date')} AS date, arg_max(close, date) AS v FROM bars_w GROUP BY 1, 2),
b AS (SELECT sym, {month('available')} AS date, arg_max(net / equity, available) AS v FROM funda GROUP BY 1, 2)
SELECT date, sym, {r('a.v')} AS close, {r('b.v')} AS roe FROM a FULL JOIN b USING (date, sym)""")
def j03(t):
    c = Catalog(t)
    f = P.combine({"close": c.get("price:close"), "roe": c.get("fundamental_features:roe")}, "M")
    return f.select("date", "sym", rd("close").alias("close"), rd("roe").alias("roe"))


@query("j04_backtest_data", f"""
WITH p AS (SELECT date, sym, close / lag(close, 4) OVER (PARTITION BY sym ORDER BY date) - 1 AS prediction FROM bars_w)
SELECT b.date, b.sym, {r('open')} AS open, {r('close')} AS close, volume, {r('prediction')} AS prediction
FROM bars_w b JOIN p USING (date, sym) WHERE prediction IS NOT NULL""")
def j04(t):
    from loomline.operators.factors import backtest_data

    b = t.stored("W")
    p = indicator(b.select("date", "sym", "close"), "RETURN", prefix="prediction", timeperiod=4).select(
        "date", "sym", "prediction").where(F.col("prediction").isNotNull())
    return backtest_data(b, p).select("date", "sym", rd("open").alias("open"), rd("close").alias("close"), "volume",
                                      rd("prediction").alias("prediction"))


_WEIGHTS = """
w AS (SELECT date, sym, volume / sum(volume) OVER (PARTITION BY date) AS weight FROM bars_w)"""


@query("j05_rebalance", f"""
WITH {_WEIGHTS},
c AS (SELECT CAST(date + INTERVAL 7 DAY AS DATE) AS date, sym, weight FROM w),
d AS (SELECT date, sym, coalesce(w.weight, 0) - coalesce(c.weight, 0) AS delta FROM w FULL JOIN c USING (date, sym))
SELECT date, sym, {r('delta')} AS delta, CASE WHEN delta > 0 THEN 'Buy' ELSE 'Sell' END AS side
FROM d WHERE abs(delta) >= 0.02""")
def j05(t):
    b = t.stored("W").select("date", "sym", "volume")
    tot = b.groupBy("date").agg(F.sum("volume").alias("tot"))
    w = b.join(tot, "date").select("date", "sym", (F.col("volume") / F.col("tot")).alias("weight"))
    cur = w.withColumn("date", F.date_add("date", 7))
    return P.rebalance_orders(cur, w, 0.02).withColumn("delta", rd("delta"))


_RET = """
ret AS (SELECT date, sym, close / lag(close) OVER (PARTITION BY sym ORDER BY date) - 1 AS ret FROM bars_w)"""


@query("j06_benchmark", f"""
WITH {_RET},
b AS (SELECT date, avg(ret) AS bench FROM ret GROUP BY date)
SELECT sym, count(*) AS n, {r('regr_slope(ret, bench)')} AS beta, {r('regr_intercept(ret, bench)')} AS alpha
FROM ret JOIN b USING (date) WHERE ret IS NOT NULL GROUP BY sym""")
def j06(t):
    x = indicator(t.stored("W").select("date", "sym", "close"), "RETURN", prefix="ret")
    bench = x.groupBy("date").agg(F.avg("ret").alias("bench"))
    return x.where(F.col("ret").isNotNull()).join(bench, "date").groupBy("sym").agg(
        F.count("*").alias("n"), rd(F.regr_slope("ret", "bench")).alias("beta"),
        rd(F.regr_intercept("ret", "bench")).alias("alpha"))


@query("j16_parameter_grid", f"""
SELECT param, date, count(*) AS n FROM (
  SELECT 10 AS param, date, close, {sma(10)} AS ma FROM bars_w {win(10)}
  UNION ALL SELECT 20, date, close, {sma(20)} FROM bars_w {win(20)}
  UNION ALL SELECT 30, date, close, {sma(30)} FROM bars_w {win(30)}
  UNION ALL SELECT 50, date, close, {sma(50)} FROM bars_w {win(50)})
WHERE close > ma GROUP BY param, date""")
def j16(t):
    grid = [10, 20, 30, 50]
    b = t.bars("W").select("date", "sym", "close")
    # the means are columns of one window pass; only then each row expands
    b = b.select("date", "close", *[rolled(F.avg, "close", n).alias(f"ma{n}") for n in grid])
    b = b.select("date", "close", F.explode(F.array(*[
        F.struct(F.lit(n).alias("param"), F.col(f"ma{n}").alias("ma")) for n in grid])).alias("g"))
    return b.where(F.col("close") > F.col("g.ma")).groupBy("g.param", "date").agg(F.count("*").alias("n"))


@query("j19_category_lookup", f"""
SELECT date, category, count(*) AS n, {r('avg(close)')} AS mean_close FROM bars_w JOIN universe USING (sym) GROUP BY 1, 2""")
def j19(t):
    return t.bars("W").join(t.universe(), "sym").groupBy("date", "category").agg(
        F.count("*").alias("n"), rd(F.avg("close")).alias("mean_close"))


# ---- bars and counts -----------------------------------------------------


for _f, _v in (("D", "bars_d"), ("W", "bars_w"), ("M", "bars_m")):
    @query(f"a01_bars_{_f.lower()}", f"""
    SELECT date, sym, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, volume,
      {r('turnover', 2)} AS turnover, {r('vwap')} AS vwap FROM {_v}""")
    def a01(t, f=_f):
        return t.bars(f).select("date", "sym", *[rd(c).alias(c) for c in ("open", "high", "low", "close")], "volume",
                                rd("turnover", 2).alias("turnover"), rd("vwap").alias("vwap"))


@query("a02_resample", f"""
SELECT freq, date, sym, {r('value')} AS value FROM (
SELECT 'D' AS freq, date, sym, close AS value FROM bars_d
UNION ALL SELECT 'W-FRI', {week('date')}, sym, arg_max(close, date) FROM bars_d GROUP BY ALL
UNION ALL SELECT 'ME', {month('date')}, sym, arg_max(close, date) FROM bars_d GROUP BY ALL)""")
def a02(t):
    b = t.stored("D").select("date", "sym", "close")
    return P.stack({f: P.resample_last(b, f, ["close"]) for f in ("D", "W-FRI", "ME")}, "freq").select(
        "freq", "date", "sym", rd("close").alias("value"))


@query("a03_signal_counts", """
SELECT 'date' AS axis, CAST(date AS VARCHAR) AS key, count(*) FILTER (close > open) AS n FROM bars_w GROUP BY 2
UNION ALL SELECT 'sym', CAST(sym AS VARCHAR), count(*) FILTER (close > open) FROM bars_w GROUP BY 2""")
def a03(t):
    b = t.bars("W").select("date", "sym", (F.col("close") > F.col("open")).alias("s"))
    by = [b.groupBy(F.col(c).cast("string").alias("key")).agg(F.count_if("s").alias("n")).withColumn("axis", F.lit(c))
          for c in ("date", "sym")]
    return by[0].unionByName(by[1])


# ---- selection -----------------------------------------------------------


@query("t01_top", f"""
SELECT date, sym, rank, {r('volume')} AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, sym) AS rank FROM bars_w) WHERE rank <= 10""")
def t01(t):
    return P.top(t.bars("W").select("date", "sym", "volume"), "volume", 10).select(
        "date", "sym", F.col("rank").cast("bigint").alias("rank"), rd("volume").alias("value"))


@query("t01_top_boolean", f"""
SELECT date, sym FROM (SELECT date, sym, row_number() OVER (PARTITION BY date ORDER BY sym) AS rank
  FROM bars_w WHERE close > open) WHERE rank <= 5""")
def t01b(t):
    b = t.bars("W").select("date", "sym", (F.col("close") > F.col("open")).alias("s"))
    return P.top(b, "s", 5).select("date", "sym")


@query("t02_position_limit", f"""
SELECT date, sym FROM (SELECT date, sym, row_number() OVER (PARTITION BY date ORDER BY turnover DESC, sym) AS rank
  FROM bars_w WHERE close > open) WHERE rank <= 30""")
def t02(t):
    b = t.bars("W").where(F.col("close") > F.col("open")).select("date", "sym", "turnover")
    return P.top(b, "turnover", 30).select("date", "sym")


@query("t04_sort", f"""
SELECT sym, CAST(sum(volume) AS DOUBLE) AS volume FROM bars_w GROUP BY sym ORDER BY volume DESC, sym""")
def t04(t):
    return t.bars("W").groupBy("sym").agg(F.sum("volume").alias("volume")).orderBy(F.desc("volume"), "sym")


@query("t05_hold_until", f"""
WITH s AS (SELECT date, sym, coalesce(close > ma, false) AS entry, coalesce(close < mb, false) AS exit_ FROM (
  SELECT date, sym, close, {sma(10)} AS ma, {sma(20)} AS mb FROM bars_w {win(10, 20)})),
e AS (SELECT date, sym, CASE WHEN exit_ THEN 0 WHEN entry THEN 1 END AS ev FROM s)
SELECT date, sym, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY sym ORDER BY date
  ROWS UNBOUNDED PRECEDING), 0) = 1 AS held FROM e""")
def t05(t):
    b = t.bars("W").select("date", "sym", "close")
    s = b.select("date", "sym", P.holds(F.col("close") > rolled(F.avg, "close", 10)).alias("entry"),
                 P.holds(F.col("close") < rolled(F.avg, "close", 20)).alias("exit"))
    return P.hold_until(s).select("date", "sym", "held")


def _mean(n: int) -> str:
    w = f"OVER (PARTITION BY sym ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {w} = {n} THEN avg(close) {w} END"


@query("t06_hold_until_slots", f"""
WITH RECURSIVE b AS (SELECT date, sym, close, volume, coalesce(close > {_mean(10)}, false) AS en, coalesce(close < {_mean(20)}, false) AS ex FROM bars_w),
x AS (SELECT 'volume' AS strategy, date, sym, en, ex, volume AS v FROM b UNION ALL SELECT 'cheap', date, sym, en, ex, -close FROM b),
d AS (SELECT strategy, date, row_number() OVER (PARTITION BY strategy ORDER BY date) AS i, coalesce(list(sym) FILTER (ex), []) AS exits,
  coalesce(list(sym ORDER BY v DESC, sym) FILTER (en AND NOT ex AND v IS NOT NULL), []) AS cands FROM x GROUP BY strategy, date),
f AS (
  SELECT strategy, i, date, list_transform(cands[1:10], lambda s: {{'sym': s, 'since': date}}) AS held, [{{'sym': 0::BIGINT, 'since': date}}][1:0] AS closed FROM d WHERE i = 1
  UNION ALL
  SELECT strategy, i, date, list_concat(kept, list_transform(list_filter(cands, lambda s: NOT list_contains(names, s))[1:10 - len(kept)], lambda s: {{'sym': s, 'since': date}})), gone
  FROM (SELECT *, list_transform(kept, lambda h: h.sym) AS names FROM (
    SELECT d.strategy, d.i, d.date, d.cands, list_filter(f.held, lambda h: NOT list_contains(d.exits, h.sym)) AS kept,
      list_filter(f.held, lambda h: list_contains(d.exits, h.sym)) AS gone
    FROM f JOIN d ON d.strategy = f.strategy AND d.i = f.i + 1))),
o AS (SELECT strategy, date AS exit_date, unnest(closed) AS h FROM f
  UNION ALL SELECT strategy, NULL, unnest(held) FROM f WHERE i = (SELECT max(i) FROM d WHERE d.strategy = f.strategy))
SELECT strategy, h.sym AS sym, h.since AS entry_date, exit_date FROM o""")
def t06(t):
    """Slot-limited holding for two strategies; checked against a plain fold
    in the tests."""
    b = t.stored("W").select("date", "sym", "close", "volume")
    s = b.select("date", "sym", "close", "volume", P.holds(F.col("close") > rolled(F.avg, "close", 10)).alias("entry"),
                 P.holds(F.col("close") < rolled(F.avg, "close", 20)).alias("exit"))
    # the windows come first: exploded rows would count twice in them
    s = s.withColumn("n", F.explode(F.array(F.lit("volume"), F.lit("cheap")))).select(
        "date", "sym", "entry", "exit", F.col("n").alias("strategy"), F.when(F.col("n") == "volume", F.col("volume")).otherwise(-F.col("close")).alias("rank_value"))
    return P.hold_until_slots(s, 10, exit_="exit")


# ---- set operations ------------------------------------------------------


_SCREENS = """
a AS (SELECT date, sym FROM bars_w WHERE close > open),
b AS (SELECT date, sym FROM bars_w WHERE volume > 60)"""


def _screens(t):
    b = t.stored("W")
    return (b.where(F.col("close") > F.col("open")).select("date", "sym"),
            b.where(F.col("volume") > 60).select("date", "sym"))


@query("u01_stack_positions", f"""
WITH {_SCREENS},
s AS (SELECT date, sym, 0.6 AS w FROM a UNION ALL SELECT date, sym, 0.4 FROM b)
SELECT date, sym, {r('CAST(sum(w) AS DOUBLE)')} AS weight FROM s GROUP BY date, sym""")
def u01(t):
    a, b = _screens(t)
    s = P.stack({"a": a, "b": b}).withColumn("w", F.when(F.col("strategy") == "a", 0.6).otherwise(0.4))
    return s.groupBy("date", "sym").agg(rd(F.sum("w")).alias("weight"))


@query("u02_intersect", f"WITH {_SCREENS} SELECT * FROM a INTERSECT SELECT * FROM b")
def u02(t):
    a, b = _screens(t)
    return a.intersect(b)


@query("u03_union", f"WITH {_SCREENS} SELECT * FROM a UNION SELECT * FROM b")
def u03(t):
    a, b = _screens(t)
    return a.union(b).distinct()


@query("u04_to_close", f"WITH {_SCREENS} SELECT * FROM a EXCEPT SELECT * FROM b")
def u04(t):
    current, target = _screens(t)
    return current.join(target, ["date", "sym"], "left_anti")


@query("u05_append_updates", """
SELECT item, actor, 'comment' AS kind, count(*) AS n FROM comments GROUP BY 1, 2
UNION ALL SELECT item, 'system', kind, count(*) FROM item_log GROUP BY 1, 3""")
def u05(t):
    path = new_path(t.spark, "updates")
    store.append(t.comments().select("item", "actor", F.lit("comment").alias("kind"), "text"), path)
    store.append(t.item_log().select("item", F.lit("system").alias("actor"), "kind", F.lit(None).cast("string").alias("text")), path)
    return store.read(t.spark, path).groupBy("item", "actor", "kind").agg(F.count("*").alias("n"))


@query("u06_clean_split", """
SELECT state = 'closed' AS archived, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM epics GROUP BY 1""")
def u06(t):
    from loomline.operators.work import split_completed

    live, done = split_completed(t.epics())
    both = live.withColumn("archived", F.lit(False)).unionByName(done.withColumn("archived", F.lit(True)))
    return both.groupBy("archived").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("f03_dates", f"""
SELECT date, sym, {week('date')} AS week, {month('date')} AS month, {quarter('date')} AS quarter,
  CAST({quarter('date')} + INTERVAL 45 DAY AS DATE) AS visible, date_diff('day', date, {month('date')}) AS days_left
FROM bars_d""")
def f03(t):
    d = F.col("date")
    return t.bars("D").select(
        "date", "sym", period_key(d, "W").alias("week"), period_key(d, "M").alias("month"), period_key(d, "Q").alias("quarter"),
        visible_from(period_key(d, "Q")).alias("visible"), F.datediff(period_key(d, "M"), d).cast("bigint").alias("days_left"))


@query("f04_math", f"""
SELECT date, sym, {r('ln(close)')} AS log_c, {r('exp(-volume / 100)')} AS decay, {r('sqrt(close)')} AS root,
  {r('power(volume, 1.5)', 4)} AS pw, {r('abs(open - close)')} AS gap, {r('greatest(open, close)')} AS hi,
  {r('least(open, close)')} AS lo, CAST(sign(close - open) AS DOUBLE) AS dir, round(volume / 7, 2) AS rnd FROM bars_w""")
def f04(t):
    o, c, v = F.col("open"), F.col("close"), F.col("volume")
    return t.bars("W").select(
        "date", "sym", rd(F.ln(c)).alias("log_c"), rd(F.exp(-v / 100)).alias("decay"), rd(F.sqrt(c)).alias("root"),
        rd(F.pow(v, F.lit(1.5)), 4).alias("pw"), rd(F.abs(o - c)).alias("gap"), rd(F.greatest(o, c)).alias("hi"),
        rd(F.least(o, c)).alias("lo"), F.sign(c - o).alias("dir"), F.round(v / 7, 2).alias("rnd"))
