import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomline.operators import work as W

SCHEMA = "id bigint, epic_id bigint, state string, effort double, depends_on array<bigint>"


def tasks(spark, rows):
    return spark.createDataFrame([(i, 1, s, 1.0, d) for i, s, d in rows], SCHEMA)


def test_blocked_ready_unknown(spark):
    t = tasks(spark, [(1, "closed", []), (2, "open", [1]), (3, "open", [2]), (4, "open", [99]), (5, "in_progress", [])])
    assert {x["id"] for x in W.blocked(t).collect()} == {3, 4}
    assert {x["id"] for x in W.ready(t).collect()} == {2}


def test_levels_and_effort(spark):
    t = tasks(spark, [(1, "open", []), (2, "open", [1]), (3, "open", [1, 2]), (4, "open", []), (5, "open", [77])])
    lv = {x["id"]: x["level"] for x in W.levels(t).collect()}
    assert lv == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0}
    e = W.effort(t).first()
    assert (e["total"], e["parallel"]) == (5.0, 3.0)


def test_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        W.levels(tasks(spark, [(1, "open", [2]), (2, "open", [1])]))


def test_cycles_behind_chains_and_forks_are_errors(spark):
    with pytest.raises(ValueError):  # a chain that runs into a cycle
        W.levels(tasks(spark, [(1, "open", [2]), (2, "open", [3]), (3, "open", [2]), (4, "open", [])]))
    with pytest.raises(ValueError):  # tasks with two dependencies in a cycle
        W.levels(tasks(spark, [(1, "open", [2, 4]), (2, "open", [3]), (3, "open", [1, 4]), (4, "open", [])]))


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, made = 10_000, []
    real = W.written
    monkeypatch.setattr(W, "written", lambda df, label: made.append(label) or real(df, label))
    name = {i: (i * 7919) % n for i in range(n)}
    t = spark.range(n).select(
        ((F.col("id") * 7919) % n).alias("id"), F.lit(1).alias("epic_id"),
        F.when(F.col("id") > 0, F.array(((F.col("id") - 1) * 7919) % n)).otherwise(F.array().cast("array<bigint>")).alias("depends_on"))
    assert {x["id"]: x["level"] for x in W.levels(t).collect()} == {name[i]: i for i in range(n)}
    assert made.count("pointers") / 2 < 20


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_of_random_graphs(spark, seed):
    r = random.Random(seed)
    rows = [(i, "open", sorted({r.randrange(i) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))}) if i else []) for i in range(60)]
    rows += [(100 + i, "open", [3]) for i in range(1500)]  # a task that many share
    want = {}
    for i, _, deps in rows:
        want[i] = max((want[d] + 1 for d in deps), default=0)
    assert {x["id"]: x["level"] for x in W.levels(tasks(spark, rows)).collect()} == want


def test_shared_dependency_and_missing_links(spark):
    rows = [(i, "open", [1] if i > 1 else []) for i in range(1, 3001)]
    assert W.blocked(tasks(spark, rows)).count() == 2999
    t = spark.createDataFrame([(i, 10) for i in range(5)] + [(9, None)], "id bigint, task_epic bigint")
    commits = spark.range(6000).select(F.col("id").alias("commit"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 2).otherwise(F.col("id") % 11).cast("long").alias("task_id"))
    epics, prds = spark.createDataFrame([(10, 7)], "id bigint, owner bigint"), spark.createDataFrame([(7,)], "id bigint")
    got = {r["gap"]: r["n"] for r in W.lineage(commits, t, epics, prds).groupBy("gap").agg(F.count("*").alias("n")).collect()}
    known = sum(1 for i in range(6000) if i % 3 == 2 and i % 11 < 5)
    null_epic = sum(1 for i in range(6000) if i % 3 == 2 and i % 11 == 9)
    assert got == {"none": 2000 + known, "epic": null_epic, "task": 6000 - 2000 - known - null_epic}


def log(spark, rows):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, m), e, k) for i, m, e, k in rows], "item bigint, ts timestamp_ntz, event_id bigint, kind string")


def test_reopen_tie_by_event_id(spark):
    d = W.fold_state(log(spark, [(1, 0, 1, "create"), (1, 5, 2, "close"), (1, 5, 3, "reopen"), (2, 0, 4, "sync"), (3, 0, 5, "start")]))
    assert {x["item"]: x["state"] for x in d.collect()} == {1: "open", 2: "open", 3: "in_progress"}


def test_durations_cross_buckets(spark):
    rows = [(1, dt.datetime(2024, 1, 1, h), i, k) for i, (h, k) in enumerate([(0, "create"), (5, "start"), (6, "close")])]
    d = W.state_durations(spark.createDataFrame(rows, "item bigint, ts timestamp_ntz, event_id bigint, kind string"))
    assert {x["state"]: x["micros"] / 3.6e9 for x in d.collect()} == {"open": 5.0, "in_progress": 1.0}


def test_sync_twice_is_quiet(spark):
    f = ["v"]
    mk = lambda rows: spark.createDataFrame(rows, "id bigint, v int")
    local, remote, last = mk([(1, 1), (2, 5), (4, 1)]), mk([(1, 1), (2, 1), (3, 1), (4, 7)]), mk([(1, 1), (2, 1), (4, 2)])
    a = W.sync(local, remote, last, f)
    assert {x["id"]: x["action"] for x in a.collect()} == {1: "none", 2: "push", 3: "pull", 4: "conflict"}
    done = W.apply_sync(a, f)
    side = lambda name: done.where(F.col("side").isin("both", name)).drop("side")
    assert sorted((r["id"], r["v"]) for r in side("local").collect()) == [(1, 1), (2, 5), (3, 1), (4, 1)]
    assert sorted((r["id"], r["v"]) for r in side("remote").collect()) == [(1, 1), (2, 5), (3, 1), (4, 7)]
    again = W.sync(side("local"), side("remote"), side("local").where("id < 4").unionByName(last.where("id = 4")), f)
    assert {r["id"]: r["action"] for r in again.where("action <> 'none'").collect()} == {4: "conflict"}


def test_split_union_is_identity(spark):
    t = tasks(spark, [(1, "closed", []), (2, "open", []), (3, None, [])])
    live, done = W.split_completed(t)
    assert sorted(map(str, live.unionByName(done).collect())) == sorted(map(str, t.collect()))


def test_remap(spark):
    t = tasks(spark, [(1, "open", []), (2, "open", [1, 9])])
    m = spark.createDataFrame([(1, 101), (2, 102)], "old bigint, new bigint")
    got = {x["id"]: (x["new_id"], x["depends_on"], x["file"]) for x in W.remap_ids(t, m).collect()}
    assert got == {1: (101, [], "101.md"), 2: (102, [101, 9], "102.md")}


def test_validate(spark):
    t = tasks(spark, [(1, "open", []), (1, "open", []), (2, "closed", [50])])
    e = spark.createDataFrame([(1, "closed")], "id bigint, state string")
    got = sorted((x["violation"], x["id"]) for x in W.validate(t, e).collect())
    assert got == [("duplicate_id", 1), ("missing_dependency", 2), ("open_task_in_closed_epic", 1)]


def test_workspace_files(spark, tmp_path):
    from loomline.sources import workspace

    d = tmp_path / "epics" / "login"
    d.mkdir(parents=True)
    (d / "001.md").write_text("---\nname: First\nparallel: true\nurl: http://x\n---\n# Title\nBody\n")
    (d / "002.md").write_text("no header\n")
    rows = {x["path"][-6:]: x for x in workspace.scan(spark, str(tmp_path)).collect()}
    assert rows["001.md"]["attrs"] == {"name": "First", "parallel": "true", "url": "http://x"}
    assert rows["001.md"]["kind"] == "epics" and rows["001.md"]["body"].startswith("# Title")
    assert rows["002.md"]["attrs"] is None and rows["002.md"]["body"] == "no header"


def test_index_reads_the_folders_of_its_terms(spark):
    from loomline.operators import text as X
    from loomline.session import new_path

    items = spark.createDataFrame([("a", "1", "Red fox, red hen"), ("a", "2", "blue Fox"), ("b", "3", None), ("b", "4", "été red")], "kind string, id string, text string")
    path = new_path(spark, "index")
    X.index_items(items.where("kind = 'a'"), path, 0)
    for _ in range(2):  # a repeated batch replaces itself
        X.index_items(items.where("kind = 'b'"), path, 1)
    found = X.search_index(spark, path, ["RED", "fox", "été", "none"])
    want = X.search(items.select(F.col("id").alias("doc_id"), "text"), ["red", "fox", "été"])
    assert {r["id"]: (r["n_terms"], r["score"]) for r in found.collect()} == {r["doc_id"]: (r["n_terms"], r["score"]) for r in want.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*In\(word", plan)
    assert {r["id"] for r in X.search_index(spark, path, ["red"], ["b"]).collect()} == {"4"}


def test_index_counts_inside_rows_and_splits_a_frequent_word(spark):
    from loomline.operators import text as X
    from loomline.session import new_path

    items = spark.range(0, 60000, 1, 8).select(F.lit("t").alias("kind"), F.col("id").cast("string").alias("id"), F.lit("open open now").alias("text"))
    more = spark.createDataFrame([("t", "7", "open, OPEN soon"), ("t", "x", ""), ("t", "y", None)], "kind string, id string, text string")
    path = new_path(spark, "index")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        X.index_items(items.unionByName(more), path, 0)
    finally:
        spark.conf.set(size, before)
    got = {r["id"]: (r["n_terms"], r["score"]) for r in X.search_index(spark, path, ["soon", "open"]).collect()}
    often = math.log(60003 / 60000)
    assert len(got) == 60000 and got["8"] == (1, pytest.approx(2 * often))
    assert got["7"] == (2, pytest.approx(4 * often + math.log(60003)))
    parts = spark.read.parquet(f"{path}/postings").where("word = 'open'").select(F.input_file_name()).distinct().count()
    assert parts > 1  # all in one task before


def test_index_lists_items_by_word_and_groups_matches_once(spark):
    from loomline.operators import text as X
    from loomline.session import new_path

    rows = [("a", str(i), "common word common" if i % 2 else "common only") for i in range(3000)] + [("b", "7", "word"), ("a", "7", "word common"), ("a", None, "word"), (None, "9", "word")]
    items = spark.createDataFrame(rows, "kind string, id string, text string").repartition(2)
    path = new_path(spark, "index")
    X.index_items(items, path, 0)
    postings = spark.read.parquet(f"{path}/postings")
    assert postings.where("word = 'common'").count() <= 4 and postings.where("word = 'common'").selectExpr("sum(size(ids))").first()[0] == 3001  # a row an item before
    found = X.search_index(spark, path, ["word", "common", "nowhere"])
    got = {(r["kind"], r["id"]): (r["n_terms"], r["score"]) for r in found.collect()}
    word, common = math.log(3004 / 1503), math.log(3004 / 3000)  # item 7 has two rows of either and counts once
    assert got["a", "7"] == (2, pytest.approx(2 * word + 3 * common)) and got["b", "7"] == (1, pytest.approx(word)) and got["a", "8"] == (1, pytest.approx(common))
    assert got["a", None] == got[None, "9"] == (1, pytest.approx(word)) and len(got) == 3003
    assert X.search_index(spark, path, ["nowhere"]).count() == X.search_index(spark, path, []).count() == 0
