"""SQL forms of the derived tables of ``loomline.sources.tables``."""


def _bars(key: str) -> str:
    return f"""
SELECT sym, {key} AS date,
  first(price ORDER BY date, seq) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY date, seq) AS close, sum(qty) AS volume, sum(amount) AS turnover,
  sum(amount) / nullif(sum(qty), 0) AS vwap
FROM ticks GROUP BY sym, {key}"""


def week(d: str) -> str:
    return f"CAST(date_trunc('week', {d} - INTERVAL 5 DAY) + INTERVAL 11 DAY AS DATE)"


def month(d: str) -> str:
    return f"last_day({d})"


def quarter(d: str) -> str:
    return f"CAST(date_trunc('quarter', {d}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"


VIEWS = {
    "ticks": """
SELECT l_suppkey AS sym, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price,
  l_quantity AS qty, l_extendedprice AS amount,
  row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS seq
FROM lineitem""",
    "lines": """
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_shipdate AS DATE), l_linenumber, l_partkey, l_quantity,
  l_extendedprice, l_suppkey, l_discount, l_tax, l_returnflag) AS line
FROM lineitem""",
    "bars_d": _bars("date"),
    "bars_w": _bars(week("date")),
    "bars_m": _bars(month("date")),
    "dense": """
SELECT g.date, g.sym,
  last_value(b.open IGNORE NULLS) OVER w AS open,
  last_value(b.close IGNORE NULLS) OVER w AS close,
  b.sym IS NULL AS filled
FROM (SELECT sym, CAST(unnest(generate_series(min(date), (SELECT max(date) FROM bars_w), INTERVAL 7 DAY)) AS DATE) AS date
      FROM bars_w GROUP BY sym) g
LEFT JOIN bars_w b ON b.sym = g.sym AND b.date = g.date
WINDOW w AS (PARTITION BY g.sym ORDER BY g.date ROWS UNBOUNDED PRECEDING)""",
    "universe": """
SELECT s_suppkey AS sym, n_name AS category, r_name AS market
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "funda": f"""
SELECT q.sym, quarter, revenue, cost, tax, revenue - cost - tax AS net, 10000.0 + abs(s_acctbal) AS equity,
  1000.0 + sum(n_lines) OVER (PARTITION BY q.sym ORDER BY quarter ROWS UNBOUNDED PRECEDING) AS shares,
  CAST(quarter + INTERVAL 45 DAY AS DATE) AS available
FROM (SELECT l_suppkey AS sym, {quarter('CAST(l_shipdate AS DATE)')} AS quarter,
        sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity * p_retailprice) AS cost,
        sum(l_extendedprice * l_tax) AS tax, count(*) AS n_lines
      FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) q
JOIN supplier ON q.sym = s_suppkey""",
    "adj": "SELECT sym, min(date) AS date, 0.5 AS factor FROM bars_w WHERE sym % 5 = 0 GROUP BY sym, year(date)",
    "orders_t": """
SELECT l_orderkey * 100 + line AS order_id, l_suppkey AS sym,
  CAST(l_shipdate AS DATE) AS date, CASE WHEN l_returnflag IN ('N', 'A') THEN 'Buy' ELSE 'Sell' END AS side,
  CASE l_linenumber % 3 WHEN 0 THEN 'Market' WHEN 1 THEN 'Limit' ELSE 'StopLoss' END AS type,
  l_quantity AS qty, l_extendedprice / l_quantity AS price,
  l_extendedprice / l_quantity * (1 + l_discount - 0.05::DOUBLE) AS limit_price
FROM lines""",
    "epics": """
SELECT o_orderkey AS id,
  CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'in_progress' ELSE 'open' END AS state,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CAST(o_orderdate AS DATE) AS created,
  o_custkey AS owner, o_totalprice AS size
FROM orders""",
    "tasks": """
SELECT l_orderkey * 100 + line AS id, l_orderkey AS epic_id, CAST(line AS INTEGER) AS seq,
  CASE WHEN l_linestatus = 'F' THEN 'closed' WHEN l_returnflag = 'R' THEN 'in_progress' ELSE 'open' END AS state,
  l_quantity AS effort, line % 3 = 0 AS parallel, ['epic:' || l_orderkey, 'task:' || l_returnflag] AS labels,
  CAST(l_shipdate AS DATE) AS due,
  CASE WHEN line > 1 AND line % 3 <> 0 THEN [l_orderkey * 100 + line - 1] ELSE CAST([] AS BIGINT[]) END AS depends_on
FROM lines""",
    "deps": "SELECT id, epic_id, unnest(depends_on) AS dep_id FROM tasks",
    "item_log": """
SELECT user_id AS item, ts, event_id,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'start' WHEN 'view' THEN 'sync'
    WHEN 'purchase' THEN 'close' ELSE 'reopen' END AS kind, value
FROM events""",
    "remote_items": """
SELECT id, state, CASE WHEN id % 7 = 0 THEN priority % 5 + 1 ELSE priority END AS priority, created, owner, size
FROM epics WHERE id % 11 <> 0""",
    "last_sync": """
SELECT id, state, CASE WHEN id % 13 = 0 THEN priority % 5 + 1 ELSE priority END AS priority, created, owner, size
FROM epics""",
    "comments": "SELECT conv_id AS item, turn, role AS actor, conv_id % 10 AS file, text FROM conversations",
    "feed": "SELECT event_id, ts, user_id AS sym, value AS price, event_type FROM events",
}
