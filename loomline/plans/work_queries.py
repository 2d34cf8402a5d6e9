"""Work items, logs, text, scalar functions."""

from pyspark.sql import functions as F

from loomline.operators import text as X
from loomline.operators import work as W
from loomline.operators.joins import lookup_join
from loomline.plans.registry import query, r, rd
from loomline.session import new_path

_OPEN = """
od AS (SELECT deps.id, count(*) AS n_blocking FROM deps LEFT JOIN tasks s ON s.id = deps.dep_id
  WHERE s.id IS NULL OR s.state <> 'closed' GROUP BY 1)"""
_PROG = "pr AS (SELECT epic_id, count(*) AS n_tasks, count(*) FILTER (state = 'closed') AS n_closed FROM tasks GROUP BY 1)"
_LEV = """
lv AS (SELECT id, max(l) AS level FROM walk GROUP BY id)"""
_WALK = """
kd AS (SELECT d.id, d.dep_id FROM deps d JOIN tasks t ON t.id = d.dep_id),
walk(id, l) AS (SELECT id, 0 FROM tasks UNION ALL SELECT kd.id, walk.l + 1 FROM walk JOIN kd ON kd.dep_id = walk.id)"""


@query("j07_blocked", f"WITH {_OPEN} SELECT t.id, t.epic_id, n_blocking FROM tasks t JOIN od ON od.id = t.id WHERE t.state = 'open'")
def j07(t):
    return W.blocked(t.stored_tasks()).select("id", "epic_id", "n_blocking")


@query("j08_ready", f"WITH {_OPEN} SELECT id, epic_id FROM tasks WHERE state = 'open' AND id NOT IN (SELECT id FROM od)")
def j08(t):
    return W.ready(t.stored_tasks()).select("id", "epic_id")


@query("t03_next_task", f"""
WITH {_OPEN}, {_PROG} SELECT t.id, t.epic_id, e.priority, {r('n_closed::DOUBLE / n_tasks')} AS progress, e.state AS epic_state
FROM tasks t JOIN epics e ON e.id = t.epic_id JOIN pr ON pr.epic_id = t.epic_id
WHERE t.state = 'open' AND t.id NOT IN (SELECT id FROM od) ORDER BY e.priority, n_closed::DOUBLE / n_tasks DESC, t.id LIMIT 1""")
def t03(t):
    return W.next_task(t.stored_tasks(), t.epics()).select("id", "epic_id", "priority", rd("progress").alias("progress"), "epic_state")


_SYNC = """
j AS (SELECT coalesce(l.id, m.id) AS id, l.id IS NOT NULL AS hl, m.id IS NOT NULL AS hr, s.id IS NOT NULL AS hs,
  (l.state, l.priority, l.owner) IS NOT DISTINCT FROM (m.state, m.priority, m.owner) AS same,
  (l.state, l.priority, l.owner) IS NOT DISTINCT FROM (s.state, s.priority, s.owner) AS ls,
  (m.state, m.priority, m.owner) IS NOT DISTINCT FROM (s.state, s.priority, s.owner) AS rs
  FROM (SELECT * FROM epics WHERE id % 19 <> 0) l FULL JOIN remote_items m ON l.id = m.id LEFT JOIN last_sync s ON s.id = coalesce(l.id, m.id))"""
_FIELDS = ["state", "priority", "owner"]


@query("j09_sync", f"""
WITH {_SYNC} SELECT id, CASE WHEN NOT hr THEN 'push' WHEN NOT hl THEN 'pull' WHEN same THEN 'none'
  WHEN NOT (hs AND ls) AND NOT (hs AND rs) THEN 'conflict' WHEN NOT (hs AND ls) THEN 'push' ELSE 'pull' END AS action FROM j""")
def j09(t):
    return W.sync(t.epics().where(F.col("id") % 19 != 0), t.remote_items(), t.last_sync(), _FIELDS).select("id", "action")


@query("j10_import", """
SELECT id, state, priority, owner FROM remote_items WHERE id NOT IN (SELECT id FROM epics WHERE id % 19 <> 0)""")
def j10(t):
    return W.import_new(t.epics().where(F.col("id") % 19 != 0), t.remote_items()).select("id", "state", "priority", "owner")


@query("j11_remap_ids", """
WITH m AS (SELECT id AS old, id * 7 + 3 AS new FROM tasks WHERE state <> 'closed'),
d AS (SELECT t.id, coalesce(m.new, d.dep_id) AS dep FROM tasks t JOIN deps d ON d.id = t.id LEFT JOIN m ON m.old = d.dep_id)
SELECT t.id, coalesce(m.new, t.id) AS new_id, coalesce(m.new, t.id) || '.md' AS file,
  coalesce((SELECT string_agg(CAST(dep AS VARCHAR), ',') FROM d WHERE d.id = t.id), '') AS deps
FROM tasks t LEFT JOIN m ON m.old = t.id""")
def j11(t):
    tasks = t.stored_tasks()
    m = tasks.where(F.col("state") != "closed").select(F.col("id").alias("old"), (F.col("id") * 7 + 3).alias("new"))
    return W.remap_ids(tasks, m).select("id", "new_id", "file", F.array_join(F.col("depends_on").cast("array<string>"), ",").alias("deps"))


@query("j12_lineage", """
WITH k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM tasks),
c AS (SELECT event_id AS commit, k.id AS task_id FROM events LEFT JOIN k ON event_id % 17 <> 0 AND k.n = event_id % (SELECT count(*) FROM tasks))
SELECT c.commit, c.task_id, t.epic_id, e.owner AS prd_id,
  CASE WHEN t.id IS NULL THEN 'task' WHEN e.id IS NULL THEN 'epic' WHEN p.c_custkey IS NULL THEN 'prd' ELSE 'none' END AS gap
FROM c LEFT JOIN tasks t ON t.id = c.task_id LEFT JOIN epics e ON e.id = t.epic_id AND e.id % 17 <> 0 LEFT JOIN customer p ON p.c_custkey = e.owner""")
def j12(t):
    tasks = t.stored_tasks()
    e = F.col("event_id")
    n = tasks.agg(F.count("*")).scalar()
    linked = t.raw("events").select(e.alias("commit"), F.when(e % 17 != 0, e % n).alias("n"))
    commits = lookup_join(linked, W.numbered(tasks.select(F.col("id").alias("task_id")), "task_id", "n"), "n").select("commit", "task_id")
    prds = t.raw("customer").select(F.col("c_custkey").alias("id"))
    return W.lineage(commits, tasks.withColumnRenamed("epic_id", "task_epic"), t.epics().where(F.col("id") % 17 != 0), prds)


@query("j13_epic_show", f"""
WITH {_PROG} SELECT e.id AS epic_id, e.state AS epic_state, e.priority, coalesce(n_tasks, 0) AS n_tasks, coalesce(n_closed, 0) AS n_closed,
  t.id AS task_id, t.state AS task_state, t.effort FROM epics e LEFT JOIN pr ON pr.epic_id = e.id LEFT JOIN tasks t ON t.epic_id = e.id""")
def j13(t):
    return W.show(t.epics(), t.stored_tasks())


@query("j14_dependency_levels", f"""
WITH RECURSIVE {_WALK}, {_LEV} SELECT t.id, t.epic_id, CAST(level AS INTEGER) AS level, t.parallel FROM tasks t JOIN lv ON lv.id = t.id""")
def j14(t):
    tasks = t.stored_tasks()
    return W.levels(tasks).join(tasks.select("id", "epic_id", "parallel"), "id").select("id", "epic_id", "level", "parallel")


@query("j15_validate", """
WITH tt AS (SELECT * FROM tasks UNION ALL SELECT * FROM tasks WHERE id % 97 = 0), ee AS (SELECT * FROM epics WHERE id % 50 <> 0)
SELECT 'orphan_task' AS violation, id FROM tt WHERE epic_id NOT IN (SELECT id FROM ee)
UNION ALL SELECT 'missing_dependency', id FROM (SELECT id, unnest(depends_on) AS d FROM tt) WHERE d NOT IN (SELECT id FROM tt)
UNION ALL SELECT 'duplicate_id', id FROM tt GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'open_task_in_closed_epic', epic_id FROM tt WHERE state <> 'closed' AND epic_id IN (SELECT id FROM ee WHERE state = 'closed')""")
def j15(t):
    tasks = t.stored_tasks()
    return W.validate(tasks.unionByName(tasks.where(F.col("id") % 97 == 0)), t.epics().where(F.col("id") % 50 != 0))


@query("a04_epic_progress", f"WITH {_PROG} SELECT epic_id, n_tasks, n_closed, {r('n_closed::DOUBLE / n_tasks')} AS progress FROM pr")
def a04(t):
    return W.progress(t.tasks()).withColumn("progress", rd("progress"))


@query("a05_status_dashboard", """
WITH i AS (SELECT 'epic' AS kind, state FROM epics UNION ALL SELECT 'task', state FROM tasks UNION ALL SELECT 'prd', CASE WHEN c_acctbal < 0 THEN 'closed' ELSE 'open' END FROM customer)
SELECT kind, state, count(*) AS n, CAST(grouping_id(kind, state) AS BIGINT) AS lvl FROM i GROUP BY ROLLUP (kind, state)""")
def a05(t):
    prd = t.raw("customer").select(F.lit("prd").alias("kind"), F.when(F.col("c_acctbal") < 0, "closed").otherwise("open").alias("state"))
    items = t.epics().select(F.lit("epic").alias("kind"), "state").unionByName(
        t.tasks().select(F.lit("task").alias("kind"), "state")).unionByName(prd)
    return W.status_dashboard(items)


@query("a06_standup", """
SELECT CAST(ts AS DATE) AS day, count(*) FILTER (kind = 'close') AS completed, count(*) FILTER (kind = 'create') AS created,
  count(*) FILTER (kind = 'start') AS started, count(*) FILTER (kind = 'reopen') AS reopened, count(DISTINCT item) AS items FROM item_log GROUP BY 1""")
def a06(t):
    return W.standup(t.item_log())


@query("a07_document_list", """
SELECT c_custkey AS prd_id, count(e.id) AS n_epics, count(*) FILTER (e.state = 'closed') AS closed, count(*) FILTER (e.state = 'in_progress') AS in_progress,
  count(*) FILTER (e.state = 'open') AS open FROM customer LEFT JOIN epics e ON e.owner = c_custkey GROUP BY 1""")
def a07(t):
    s = F.col("state")
    by = t.epics().groupBy(F.col("owner").alias("prd_id")).agg(
        F.count("*").alias("n_epics"), *[F.count_if(s == v).alias(v) for v in ("closed", "in_progress", "open")])
    return t.raw("customer").select(F.col("c_custkey").alias("prd_id")).join(by, "prd_id", "left").fillna(0)


_FOLD = """
f AS (SELECT item, ts, event_id, CASE kind WHEN 'create' THEN 'open' WHEN 'start' THEN 'in_progress' WHEN 'close' THEN 'closed' WHEN 'reopen' THEN 'open' END AS st FROM item_log),
fold AS (SELECT item, coalesce(last(st ORDER BY ts, event_id) FILTER (st IS NOT NULL), 'open') AS state, max(ts) FILTER (st IS NOT NULL) AS since,
  min(ts) AS first_ts, count(*) AS n_events FROM f GROUP BY item)"""


@query("l01_state_fold", f"WITH {_FOLD} SELECT item, state, since, n_events FROM fold")
def l01(t):
    return W.fold_state(t.item_log()).select("item", "state", "since", "n_events")


@query("a08_in_progress", f"""
WITH {_FOLD} SELECT item, c_name AS owner, date_diff('day', CAST(since AS DATE), (SELECT max(CAST(ts AS DATE)) FROM item_log)) AS age
FROM fold LEFT JOIN customer ON c_custkey = item WHERE state = 'in_progress'""")
def a08(t):
    last = t.item_log().agg(F.max(F.to_date("ts"))).scalar()
    s = W.fold_state(t.item_log()).where(F.col("state") == "in_progress")
    return s.join(t.raw("customer"), F.col("item") == F.col("c_custkey"), "left").select(
        "item", F.col("c_name").alias("owner"), F.datediff(last, F.to_date("since")).cast("bigint").alias("age"))


@query("a09_labels", """
SELECT label, split_part(label, ':', 1) AS prefix, count(*) AS n FROM (SELECT unnest(labels) AS label FROM tasks) GROUP BY 1""")
def a09(t):
    return W.label_counts(t.tasks()).select("label", "prefix", "n")


_LOGLINES = """
lg AS (SELECT event_id AS file, 'tests/test_' || user_id || '.py::case_' || event_id || ' ' ||
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'FAILED' WHEN 'signup' THEN 'SKIPPED' ELSE 'PASSED' END AS line FROM events)"""


@query("a16_test_summary", f"""
WITH {_LOGLINES}, s AS (SELECT line, lower(regexp_extract(line, ' (PASSED|FAILED|ERROR|SKIPPED)$', 1)) AS status FROM lg)
SELECT status, CAST(NULL AS VARCHAR) AS failure, count(*) AS n FROM s GROUP BY 1
UNION ALL SELECT status, line, 1 FROM s WHERE status IN ('failed', 'error')""")
def a16(t):
    e, c = t.raw("events"), F.col("event_type")
    st = F.when(c == "error", "ERROR").when(c == "click", "FAILED").when(c == "signup", "SKIPPED").otherwise("PASSED")
    lines = e.select(F.concat(F.lit("tests/test_"), F.col("user_id").cast("string"), F.lit(".py::case_"),
                              F.col("event_id").cast("string"), F.lit(" "), st).alias("line"))
    n, fails = X.test_summary(lines)
    return n.select("status", F.lit(None).cast("string").alias("failure"), "n").unionByName(
        fails.select("status", F.col("line").alias("failure"), F.lit(1).cast("bigint").alias("n")))


@query("a17_log_reduction", """
WITH l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line) AS rank FROM l WHERE trim(line) <> '')
SELECT k.doc_id, rank, md5(line) AS line, k.n, t.n_lines FROM k JOIN (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines FROM l GROUP BY 1) t USING (doc_id) WHERE rank <= 3""")
def a17(t):
    return X.reduce_logs(t.raw("documents").select("doc_id", "text")).select(
        "doc_id", F.col("rank").cast("bigint").alias("rank"), F.md5("line").alias("line"), "n", "n_lines")


@query("a18_review_triage", rf"""
SELECT file, CASE WHEN regexp_matches(lower(text), '{X.ACCEPT}') THEN 'accept' WHEN regexp_matches(lower(text), '{X.IGNORE}') THEN 'ignore' ELSE 'review' END AS verdict,
  count(*) AS n FROM comments GROUP BY 1, 2""")
def a18(t):
    return X.triage(t.comments()).groupBy("file", "verdict").agg(F.count("*").alias("n"))


@query("a19_parallel_streams", f"""
WITH RECURSIVE {_WALK}, {_LEV}, s AS (SELECT epic_id, CAST(level AS INTEGER) AS level, count(*) AS n FROM tasks t JOIN lv ON lv.id = t.id GROUP BY 1, 2)
SELECT *, max(n) OVER (PARTITION BY epic_id) AS widest FROM s""")
def a19(t):
    return W.streams(t.stored_tasks())


@query("a20_effort", f"""
WITH RECURSIVE {_WALK}, {_LEV}, s AS (SELECT epic_id, level, sum(effort) AS total, sum(CASE WHEN state = 'closed' THEN effort ELSE 0 END) AS closed, max(effort) AS longest
  FROM tasks t JOIN lv ON lv.id = t.id GROUP BY 1, 2)
SELECT epic_id, sum(total) AS total, sum(closed) AS closed, sum(total) - sum(closed) AS open, sum(longest) AS parallel FROM s GROUP BY 1""")
def a20(t):
    return W.effort(t.stored_tasks()).select("epic_id", "total", "closed", "open", "parallel")


# ---- change data ------------------------------------------------------------


@query("l02_latest_fields", """
WITH e AS (SELECT user_id AS item, ts, event_id, CASE WHEN event_type = 'purchase' THEN value END AS price,
  CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events)
SELECT item, last(price ORDER BY ts, event_id) FILTER (price IS NOT NULL) AS price, last(k ORDER BY ts, event_id) FILTER (k IS NOT NULL) AS k FROM e GROUP BY item""")
def l02(t):
    e, c = t.raw("events"), F.col("event_type")
    log = e.select(F.col("user_id").alias("item"), "ts", "event_id", F.when(c == "purchase", F.col("value")).alias("price"),
                   F.when(c == "click", F.get_json_object("props", "$.k").cast("bigint")).alias("k"))
    return W.latest_fields(log, ["price", "k"])


@query("l03_snapshot_diff", """
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM last_sync WHERE id % 23 <> 0) o FULL JOIN remote_items n ON o.id = n.id
WHERE o.id IS NULL OR n.id IS NULL OR o.priority <> n.priority OR o.state <> n.state""")
def l03(t):
    return W.snapshot_diff(t.last_sync().where(F.col("id") % 23 != 0), t.remote_items(), ["state", "priority"])


@query("l04_state_durations", """
WITH f AS (SELECT item, ts, event_id, CASE kind WHEN 'create' THEN 'open' WHEN 'start' THEN 'in_progress' WHEN 'close' THEN 'closed' WHEN 'reopen' THEN 'open' END AS state FROM item_log),
n AS (SELECT *, lead(ts) OVER (PARTITION BY item ORDER BY ts, event_id) AS nx FROM f WHERE state IS NOT NULL)
SELECT item, state, count(*) AS n, CAST(sum(epoch_us(nx) - epoch_us(ts)) AS BIGINT) AS micros FROM n WHERE nx IS NOT NULL GROUP BY 1, 2""")
def l04(t):
    return W.state_durations(t.item_log())


@query("l05_publication_counts", """
WITH rt AS (SELECT id, CASE WHEN id % 7 = 0 THEN effort + 1 ELSE effort END AS effort, state FROM tasks WHERE id % 11 <> 0)
SELECT t.epic_id, count(*) FILTER (rt.id IS NULL) AS local_only, count(*) FILTER (rt.id IS NOT NULL AND rt.effort = t.effort) AS synced,
  count(*) FILTER (rt.effort <> t.effort) AS stale FROM tasks t LEFT JOIN rt ON rt.id = t.id GROUP BY 1""")
def l05(t):
    remote = t.stored_tasks().where(F.col("id") % 11 != 0).withColumn(
        "effort", F.when(F.col("id") % 7 == 0, F.col("effort") + 1).otherwise(F.col("effort")))
    return W.publication(t.stored_tasks(), remote, ["effort", "state"])


# ---- scalar functions ---------------------------------------------------------


@query("f01_strings", """
SELECT id, split_part(labels[2], ':', 2) AS flag, lpad(CAST(seq AS VARCHAR), 3, '0') || '.md' AS file, contains(labels[1], '99') AS has_99,
  labels[1] ILIKE 'EPIC:1%' AS starts_1, regexp_replace(labels[1], '^epic:', 'feature:') AS renamed FROM tasks""")
def f01(t):
    l = F.col("labels")
    return t.tasks().select(
        "id", F.split_part(l[1], F.lit(":"), F.lit(2)).alias("flag"), F.concat(F.lpad(F.col("seq").cast("string"), 3, "0"), F.lit(".md")).alias("file"),
        F.contains(l[0], F.lit("99")).alias("has_99"), l[0].ilike("EPIC:1%").alias("starts_1"),
        F.regexp_replace(l[0], "^epic:", "feature:").alias("renamed"))


_TERMS = ("the", "data", "security", "system", "error")


@query("f02_search", f"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word IN {_TERMS} GROUP BY 1, 2),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, count(*) AS n_terms, {r('sum(tf * ln((SELECT count(*) FROM documents) / df))')} AS score FROM tf JOIN df USING (word) GROUP BY 1""")
def f02(t):
    return X.search(t.raw("documents").select("doc_id", "text"), list(_TERMS)).withColumn("score", rd("score"))


_EVERYTHING = ("security", "open", "epic", "the", "user", "in_progress")


@query("f02_search_everything", f"""
WITH i AS (
  SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'epic', CAST(id AS VARCHAR), 'epic ' || id || ' ' || state || ' priority ' || priority || ' owner ' || owner FROM epics
  UNION ALL SELECT 'task', CAST(id AS VARCHAR), state || ' ' || labels[1] || ' ' || labels[2] FROM tasks
  UNION ALL SELECT 'comment', conv_id || '/' || turn, role || ' ' || text FROM conversations),
w AS (SELECT kind, id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM i),
tf AS (SELECT kind, id, word, count(*) AS tf FROM w WHERE word IN {_EVERYTHING} GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1)
SELECT kind, id, count(*) AS n_terms, {r('sum(tf * ln((SELECT count(*) FROM i) / df))')} AS score FROM tf JOIN df USING (word) GROUP BY 1, 2""")
def f02_all(t):
    """Documents first; epics, tasks and comments are a second batch of the same index, written twice."""
    e = t.epics().select(F.lit("epic").alias("kind"), F.col("id").cast("string").alias("id"), F.concat_ws(
        " ", F.lit("epic"), "id", "state", F.lit("priority"), "priority", F.lit("owner"), "owner").alias("text"))
    k = t.once("task-texts", lambda: t.tasks().select(
        F.lit("task").alias("kind"), F.col("id").cast("string").alias("id"), F.concat_ws(" ", "state", F.concat_ws(" ", "labels")).alias("text")))
    c = t.comments().select(F.lit("comment").alias("kind"), F.concat_ws("/", "item", "turn").alias("id"), F.concat_ws(" ", "actor", "text").alias("text"))
    path = new_path(t.spark, "index")
    X.index_items(t.raw("documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text"), path, 0)
    for _ in range(2):
        X.index_items(e.unionByName(k).unionByName(c), path, 1)
    return X.search_index(t.spark, path, list(_EVERYTHING)).withColumn("score", rd("score"))


@query("f05_collections", """
SELECT date, sym, CAST(len(list_filter([open, high, low, close], lambda x: x > 2000)) AS INTEGER) AS n_high, list_sum(list_transform([open, close], lambda x: x * 2)) AS twice,
  list_contains([1, 2, 3], sym % 7) AS hit, greatest(open, close) AS best, map_extract(MAP {'o': open, 'c': close}, 'c')[1] AS c FROM bars_w""")
def f05(t):
    c = F.col
    arr = F.array("open", "high", "low", "close")
    m = F.create_map(F.lit("o"), c("open"), F.lit("c"), c("close"))
    return t.bars("W").select(
        "date", "sym", F.size(F.filter(arr, lambda x: x > 2000)).alias("n_high"),
        F.aggregate(F.transform(F.array("open", "close"), lambda x: x * 2), F.lit(0.0), lambda a, x: a + x).alias("twice"),
        F.array_contains(F.array(F.lit(1), F.lit(2), F.lit(3)), (c("sym") % 7).cast("int")).alias("hit"),
        F.array_max(F.array("open", "close")).alias("best"), m["c"].alias("c"))


@query("f06_display", f"""
SELECT date, sym, format('{{:,}}', CAST(volume AS BIGINT)) AS volume, printf('%.2f%%', {r('close / open - 1', 4)} * 100) AS change FROM bars_w""")
def f06(t):
    c = F.col
    return t.bars("W").select("date", "sym", F.format_number(c("volume").cast("bigint"), 0).alias("volume"),
                              F.format_string("%.2f%%", rd(c("close") / c("open") - 1, 4) * 100).alias("change"))
