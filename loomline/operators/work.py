"""Work items: state, dependencies, sync, lineage, estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.joins import lookup_join
from loomline.session import written


def split_completed(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live and completed items; their union is the input."""
    done = F.coalesce(F.col("state") == "closed", F.lit(False))
    return items.where(~done), items.where(done)


# ---- event log -----------------------------------------------------------


def event_order(ts="ts", event_id="event_id") -> Column:
    """Time, then id, in one decimal: a fixed-width buffer keeps ``max_by`` in
    a hash aggregate."""
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(20,0)")
    return micros * F.lit(10**15).cast("decimal(16,0)") + F.col(event_id).cast("decimal(18,0)")


# What each logged action makes of an item (fixed values); others keep it.
STATE_AFTER = {"create": "open", "start": "in_progress", "close": "closed", "reopen": "open"}
STATES = ("open", "in_progress", "closed")


def _state(kind="kind") -> Column:
    m = F.create_map(*[F.lit(x) for kv in STATE_AFTER.items() for x in kv])
    return m[F.col(kind)]


def fold_state(log: DataFrame) -> DataFrame:
    """Current state per item: the last state-changing event wins."""
    # states as numbers: fixed-width buffers keep a hash aggregate
    code = F.create_map(*[x for i, v in enumerate(STATES) for x in (F.lit(v), F.lit(i))])
    name = F.array(*[F.lit(v) for v in STATES])
    s = log.withColumn("_s", code[_state()]).withColumn("_o", event_order())
    o = F.when(F.col("_s").isNotNull(), F.col("_o"))
    return s.groupBy("item").agg(
        F.get(name, F.coalesce(F.max_by("_s", o), F.lit(0))).alias("state"),
        F.max(F.when(F.col("_s").isNotNull(), F.col("ts"))).alias("since"),
        F.min("ts").alias("first_ts"), F.count("*").alias("n_events"))


def latest_fields(log: DataFrame, fields: list[str]) -> DataFrame:
    """Latest value per field; null means not changed."""
    d = log.withColumn("_o", event_order())
    return d.groupBy("item").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_o"))).alias(f) for f in fields])


def next_event_time(log: DataFrame, bucket: str = "hour") -> DataFrame:
    """``next_ts`` of each event of its item. Events are ordered inside time
    buckets, and buckets are chained by their first events, so an item with
    very many events spreads over many tasks."""
    b = log.withColumn("_b", F.date_trunc(bucket, F.col("ts").cast("timestamp")))
    heads = b.groupBy("item", "_b").agg(F.min("ts").alias("_first"))
    chain = heads.withColumn("_next", F.lead("_first").over(Window.partitionBy("item").orderBy("_b"))).drop("_first")
    w = Window.partitionBy("item", "_b").orderBy("ts", "event_id")
    return b.withColumn("_in", F.lead("ts").over(w)).join(chain, ["item", "_b"]).withColumn(
        "next_ts", F.coalesce("_in", "_next")).drop("_in", "_next", "_b")


def state_durations(log: DataFrame) -> DataFrame:
    """Seconds spent in each state per item, over closed intervals."""
    changes = log.withColumn("state", _state()).where(F.col("state").isNotNull())
    d = next_event_time(changes).where(F.col("next_ts").isNotNull())
    micros = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return d.groupBy("item", "state").agg(F.count("*").alias("n"), F.sum(micros).alias("micros"))


def standup(log: DataFrame) -> DataFrame:
    k = F.col("kind")
    return log.groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(k == "close").alias("completed"), F.count_if(k == "create").alias("created"),
        F.count_if(k == "start").alias("started"), F.count_if(k == "reopen").alias("reopened"),
        F.countDistinct("item").alias("items"))


# ---- dependencies ---------------------------------------------------------


def open_dependencies(tasks: DataFrame) -> DataFrame:
    """(id, n_blocking): dependencies that are not closed. An unknown
    dependency blocks."""
    e = tasks.select("id", F.explode("depends_on").alias("dep_id"))
    s = tasks.select(F.col("id").alias("dep_id"), F.col("state").alias("dep_state"))
    # A dependency that very many tasks share is one key.
    j = lookup_join(e, s, "dep_id").where(F.coalesce(F.col("dep_state") != "closed", F.lit(True)))
    return j.groupBy("id").agg(F.count("*").alias("n_blocking"))


def blocked(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("state") == "open").join(open_dependencies(tasks), "id")


def ready(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("state") == "open").join(open_dependencies(tasks), "id", "left_anti")


def progress(tasks: DataFrame) -> DataFrame:
    done = F.count_if(F.col("state") == "closed")
    return tasks.groupBy("epic_id").agg(F.count("*").alias("n_tasks"), done.alias("n_closed")).withColumn(
        "progress", F.try_divide("n_closed", "n_tasks"))


def next_task(tasks: DataFrame, epics: DataFrame, n: int = 1) -> DataFrame:
    """Ready tasks by priority, then the epic nearest to completion, then age."""
    e = epics.select(F.col("id").alias("epic_id"), "priority", F.col("state").alias("epic_state"))
    j = ready(tasks).join(e, "epic_id").join(progress(tasks), "epic_id")
    return j.orderBy("priority", F.desc("progress"), "id").limit(n)


def levels(tasks: DataFrame) -> DataFrame:
    """(id, level): 0 without dependencies, else 1 + the highest level among
    them. Edges to unknown ids do not count. A cycle raises ValueError.

    A task with one dependency points at it; pointers are doubled, so a chain
    takes as many rounds as its length has binary digits. What is left are
    tasks with several dependencies, whose edges lead past the chains between
    them: these are peeled, a round for each such task on a path. Rounds are
    written, so lineage stays short and a lost executor repeats one at most.
    """
    ids = tasks.select("id")
    edges = tasks.select("id", F.explode(F.array_distinct("depends_on")).alias("dep_id"))
    edges = written(lookup_join(edges, ids.select(F.col("id").alias("dep_id"), F.lit(True).alias("known")), "dep_id", "inner").drop("known"), "edges")
    degree = written(edges.groupBy("id").agg(F.count("*").alias("n"), F.min("dep_id").alias("dep_id")), "degrees")
    # (id, stop, steps): where a chain has led so far; a stop with a pointer of its own leads on.
    moving = degree.where("n = 1").select("id", F.col("dep_id").alias("stop"), F.lit(1).alias("steps"))
    rounds = max(degree.count(), 1).bit_length() + 1
    done = []
    for _ in range(rounds):
        moving = written(moving, "pointers")
        next_ = moving.unionByName(reduce(DataFrame.unionByName, done)) if done else moving
        next_ = next_.select(F.col("id").alias("stop"), F.col("stop").alias("_stop"), F.col("steps").alias("_steps"))
        led = written(lookup_join(moving, next_, "stop"), "pointers")
        done.append(led.where("_stop IS NULL").select("id", "stop", "steps"))
        moving = led.where("_stop IS NOT NULL").select("id", F.col("_stop").alias("stop"), (F.col("steps") + F.col("_steps")).alias("steps"))
        if moving.isEmpty():
            break
    else:
        raise ValueError("dependency cycle")
    chains = reduce(DataFrame.unionByName, done)
    several = degree.where("n > 1").select("id")
    roots = ids.join(degree.select("id"), "id", "left_anti").withColumn("level", F.lit(0))
    if several.isEmpty():
        # all chains end at tasks without dependencies
        return roots.unionByName(chains.select("id", F.col("steps").alias("level")))
    own = edges.join(several, "id", "left_semi")
    own = lookup_join(written(own, "edges"), chains.select(F.col("id").alias("dep_id"), "stop", "steps"), "dep_id")
    own = own.select("id", F.coalesce("stop", "dep_id").alias("stop"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    own = written(own.groupBy("id", "stop").agg(F.max("steps").alias("steps")), "edges")
    rest = written(own.join(several.withColumnRenamed("id", "stop"), "stop", "left_semi"), "edges")
    values = [own.join(several.withColumnRenamed("id", "stop"), "stop", "left_anti").select("id", F.col("steps").alias("level"))]
    left, placed = several, []
    while True:
        ready = left.join(rest.select("id").distinct(), "id", "left_anti")
        known = reduce(DataFrame.unionByName, values).groupBy("id").agg(F.max("level").alias("level"))
        front = written(ready.join(known, "id"), "front")
        if front.isEmpty():
            raise ValueError("dependency cycle")
        placed.append(front)
        if rest.isEmpty():
            break
        met = written(lookup_join(rest, front.select(F.col("id").alias("stop"), "level"), "stop"), "edges")
        values.append(met.where("level IS NOT NULL").select("id", (F.col("steps") + F.col("level")).alias("level")))
        rest = met.where("level IS NULL").drop("level")
        left = written(left.join(front.select("id"), "id", "left_anti"), "left")
    ends = roots.unionByName(reduce(DataFrame.unionByName, placed))
    along = lookup_join(written(chains, "pointers"), ends.select(F.col("id").alias("stop"), "level"), "stop", "inner")
    return ends.unionByName(along.select("id", (F.col("steps") + F.col("level")).alias("level")))


def streams(tasks: DataFrame) -> DataFrame:
    """Tasks per epic and level, with the widest level of the epic."""
    lv = levels(tasks).join(tasks.select("id", "epic_id"), "id").groupBy("epic_id", "level").agg(F.count("*").alias("n"))
    wide = lv.groupBy("epic_id").agg(F.max("n").alias("widest"))
    return lv.join(wide, "epic_id")


def effort(tasks: DataFrame) -> DataFrame:
    """Total, closed and open effort; serial against fully parallel."""
    t = tasks.join(levels(tasks), "id")
    e, done = F.col("effort"), F.col("state") == "closed"
    by_level = t.groupBy("epic_id", "level").agg(
        F.sum(e).alias("total"), F.sum(F.when(done, e).otherwise(0.0)).alias("closed"), F.max(e).alias("longest"))
    return by_level.groupBy("epic_id").agg(
        F.sum("total").alias("total"), F.sum("closed").alias("closed"), F.sum("longest").alias("parallel")).withColumn(
        "open", F.col("total") - F.col("closed"))


# ---- sync and lineage -------------------------------------------------------


def _same(a: list[str], b: list[str]) -> Column:
    return F.struct(*a).eqNullSafe(F.struct(*b))


def _pre(df: DataFrame, p: str, fields: list[str], key: str = "id") -> DataFrame:
    return df.select(key, *[F.col(f).alias(f"{p}_{f}") for f in fields], F.lit(True).alias(f"{p}_has"))


def sync(local: DataFrame, remote: DataFrame, last: DataFrame, fields: list[str]) -> DataFrame:
    """Action per id: push, pull, conflict or none, against the last synced
    snapshot."""
    j = _pre(local, "l", fields).join(_pre(remote, "r", fields), "id", "full_outer").join(_pre(last, "s", fields), "id", "left")
    lf, rf, sf = ([f"{p}_{f}" for f in fields] for p in "lrs")
    has = {p: F.col(f"{p}_has").isNotNull() for p in "lrs"}
    lc, rc = ~(has["s"] & _same(lf, sf)), ~(has["s"] & _same(rf, sf))
    action = (
        F.when(~has["r"], "push").when(~has["l"], "pull").when(_same(lf, rf), "none")
        .when(lc & rc, "conflict").when(lc, "push").otherwise("pull"))
    return j.select("id", action.alias("action"), *lf, *rf)


def apply_sync(actions: DataFrame, fields: list[str]) -> DataFrame:
    """State after push and pull. A conflict keeps both sides: two rows of
    which ``side`` tells local from remote; it is ``both`` for all others."""
    both = F.array(F.lit("local"), F.lit("remote"))
    sides = F.when(F.col("action") == "conflict", both).otherwise(F.array(F.lit("both")))
    rows = actions.withColumn("side", F.explode(sides))
    take_remote = (F.col("action") == "pull") | (F.col("side") == "remote")
    return rows.select("id", "side", *[F.when(take_remote, F.col(f"r_{f}")).otherwise(F.col(f"l_{f}")).alias(f) for f in fields])


def import_new(local: DataFrame, remote: DataFrame) -> DataFrame:
    return remote.join(local.select("id"), "id", "left_anti")


def remap_ids(tasks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace temporary ids (old to new) in ids and dependency references."""
    refs = tasks.select("id", F.posexplode("depends_on").alias("_pos", "dep_id"))
    m = mapping.select(F.col("old").alias("dep_id"), F.col("new").alias("_new"))
    back = lookup_join(refs, m, "dep_id").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("_new", "dep_id").alias("d")))).alias("_d"))
    own = mapping.select(F.col("old").alias("id"), F.col("new").alias("_id"))
    j = tasks.join(back, "id", "left").join(own, "id", "left")
    return j.withColumn("depends_on", F.coalesce(F.col("_d.d"), F.array().cast("array<bigint>"))).withColumn(
        "new_id", F.coalesce("_id", "id")).withColumn(
        "file", F.concat(F.col("new_id").cast("string"), F.lit(".md"))).drop("_d", "_id")


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``name``: the row's number from 0 in the order of a unique key. Rows are
    dealt into ranges and numbered inside; only range sizes meet in one place."""
    dealt = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_place", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("_range", F.shiftright("_place", 33)), "numbered")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).drop("_size")
    return dealt.join(before, "_range").withColumn(name, F.col("_before") + F.col("_place") - F.shiftleft("_range", 33)).drop("_range", "_place", "_before")


def lineage(commits: DataFrame, tasks: DataFrame, epics: DataFrame, prds: DataFrame) -> DataFrame:
    """Commit to issue to epic to document; the first missing link is named.
    Commits without a link are set aside and those of hot issues meet a
    broadcast of these; epics and documents are joined to tasks, not to commits."""
    t = tasks.select(F.col("id").alias("task_id"), F.col("task_epic").alias("epic_id"))
    e = epics.select(F.col("id").alias("epic_id"), F.col("owner").alias("prd_id"), F.lit(True).alias("_e"))
    p = prds.select(F.col("id").alias("prd_id"), F.lit(True).alias("_p"))
    e = lookup_join(e, p, "prd_id")
    t = lookup_join(t.withColumn("_t", F.lit(True)), e, "epic_id")
    j = lookup_join(commits, t, "task_id")
    gap = (F.when(F.col("_t").isNull(), "task").when(F.col("_e").isNull(), "epic").when(F.col("_p").isNull(), "prd").otherwise("none"))
    return j.select("commit", "task_id", "epic_id", "prd_id", gap.alias("gap"))


def show(epics: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each parent with its children, one row per child; a parent without
    children keeps one row. Children are not packed into one cell."""
    p = progress(tasks).select("epic_id", "n_tasks", "n_closed")
    e = epics.select(F.col("id").alias("epic_id"), F.col("state").alias("epic_state"), "priority").join(p, "epic_id", "left")
    c = tasks.select("epic_id", F.col("id").alias("task_id"), F.col("state").alias("task_state"), "effort")
    return e.fillna(0, ["n_tasks", "n_closed"]).join(c, "epic_id", "left")


def validate(tasks: DataFrame, epics: DataFrame) -> DataFrame:
    """One row per violation."""
    e = epics.select(F.col("id").alias("epic_id"), F.col("state").alias("_es"))
    orphan = tasks.join(e, "epic_id", "left_anti").select(F.lit("orphan_task").alias("violation"), "id")
    refs = tasks.select("id", F.explode("depends_on").alias("dep_id"))
    missing = refs.join(tasks.select(F.col("id").alias("dep_id")), "dep_id", "left_anti").select(
        F.lit("missing_dependency").alias("violation"), "id")
    twice = tasks.groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(
        F.lit("duplicate_id").alias("violation"), "id")
    late = tasks.where(F.col("state") != "closed").join(e.where(F.col("_es") == "closed"), "epic_id", "left_semi").select(
        F.lit("open_task_in_closed_epic").alias("violation"), F.col("epic_id").alias("id")).distinct()
    return reduce(DataFrame.unionByName, [orphan, missing, twice, late])


def snapshot_diff(old: DataFrame, new: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    j = _pre(old, "o", fields, key).join(_pre(new, "n", fields, key), key, "full_outer")
    same = _same([f"o_{f}" for f in fields], [f"n_{f}" for f in fields])
    change = (F.when(F.col("o_has").isNull(), "added").when(F.col("n_has").isNull(), "removed")
              .when(same, "same").otherwise("changed"))
    return j.select(key, change.alias("change")).where(F.col("change") != "same")


def publication(local: DataFrame, remote: DataFrame, fields: list[str]) -> DataFrame:
    """Per epic: tasks only local, synced, stale."""
    j = _pre(local.withColumn("e", F.col("epic_id")), "l", [*fields, "e"]).join(_pre(remote, "r", fields), "id", "left")
    same = _same([f"l_{f}" for f in fields], [f"r_{f}" for f in fields])
    has = F.col("r_has").isNotNull()
    return j.groupBy(F.col("l_e").alias("epic_id")).agg(
        F.count_if(~has).alias("local_only"), F.count_if(has & same).alias("synced"), F.count_if(has & ~same).alias("stale"))


# ---- listings -----------------------------------------------------------------


def status_dashboard(items: DataFrame) -> DataFrame:
    """Counts by kind and state with totals."""
    return items.rollup("kind", "state").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("lvl"))


def label_counts(tasks: DataFrame) -> DataFrame:
    l = tasks.select(F.explode("labels").alias("label"))
    return l.groupBy("label").agg(F.count("*").alias("n")).withColumn("prefix", F.split_part("label", F.lit(":"), F.lit(1)))
