"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic). The cells'
token weights are raked until their marginals over each of the three match the
targets, which are the corpus's own shares raised to a power below one. A
document is kept with a probability in proportion to its cell's raked over its
actual weight, with a common factor that meets the token budget and at most 1.

DataFrame operations throughout. A source with a third of all rows is counted
by partial aggregates and adds one row a task.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import discard, written

DIMS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Raking ends when a sweep finds every marginal this near to its target, relative to it.
TOLERANCE = 1e-9
#: Sweeps of one plan, and the number at which raking fails.
ROUND, MOST = 3, 3000
#: So many cells are raked by one task, without a shuffle; more are dealt by the values of each dimension.
FEW = 20_000


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: str = "text") -> Column:
    """A coarse topic by form: markup-like, list-like, long or plain prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    marks = n - F.length(F.translate(t, "#$%&*{}<>=", ""))
    lines = n - F.length(F.translate(t, "\n", "")) + 1
    return F.when(marks * 50 > n, "markup").when(lines * 80 > n, "list").when(n >= 8000, "long").otherwise("prose")


def features(docs: DataFrame, topic: Column | None = None, source: str = "source", lang: str = "lang", text: str = "text") -> DataFrame:
    """Each row as a struct ``row`` with its cell and tokens; a null source, language or topic is a cell of its own."""
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(topic if topic is not None else topic_of(text), F.lit("")).alias("topic"),
        token_count(text).alias("tokens"),
    )


def raked(cells: DataFrame, powers: dict[str, float] = POWERS, sweeps: int = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """``(source, lang, topic, share, weight)`` of ``(source, lang, topic, tokens)``: actual and raked shares of tokens.

    Sweeps go on until one finds all marginals within ``tolerance`` of their
    targets; it is an error if ``sweeps`` do not get there. Where no weights of
    the given cells meet all targets (a source that alone has a language and
    nothing else, with two different targets), sweeps end with a warning when
    they move no weight any more: the last dimension is met then.

    Cells without tokens have no share. Windows run over cells, of which there
    are as many as combinations and not as documents. Every few sweeps are
    written, so the plan stays short and a lost executor costs these.
    """
    size = cells.where("tokens > 0").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
    total, few = size["tokens"] or 0, size["n"] <= FEW
    now = (cells.coalesce(1) if few else cells).where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(max(total, 1))).withColumn("weight", F.col("share"))
    for dim, power in powers.items():
        own = Window.partitionBy(dim)
        now = now.withColumn("t", F.pow(F.sum("share").over(own), F.lit(power))).withColumn("n", F.count("*").over(own))
        whole = now.agg(F.sum(F.col("t") / F.col("n"))).first()[0] or 1.0  # each value of the dimension once
        now = now.withColumn(f"to_{dim}", F.col("t") / F.lit(whole)).drop("t", "n")
    kept, last = now.columns, None
    for done in range(ROUND, sweeps + ROUND, ROUND):
        for _ in range(ROUND):
            now = now.withColumn("before", F.col("weight")).withColumn("off", F.lit(0.0))
            for dim in powers:
                now = now.withColumn("by", F.col(f"to_{dim}") / F.sum("weight").over(Window.partitionBy(dim)))
                now = now.withColumn("weight", F.col("weight") * F.col("by")).withColumn("off", F.greatest("off", F.abs(F.col("by") - 1)))
        moved = F.abs(F.col("weight") - F.col("before")) / (F.col("before") + F.col("share") * 1e-9)  # a weight may vanish
        new = written(now.select(*kept, "off", moved.alias("moved")), "mix-sweep")
        if last is not None:
            discard(last)
        last, now = new, (new.coalesce(1) if few else new).select(*kept)
        s = new.agg(F.max("off").alias("off"), F.max("moved").alias("moved")).first()
        if s["off"] is None or s["off"] <= tolerance:
            break
        if s["moved"] <= tolerance / 1000:
            warnings.warn(f"no weights meet all targets: a marginal stays {s['off']:.2g} off", stacklevel=2)
            break
    else:
        raise RuntimeError(f"raking is {s['off']:.2g} off its targets after {done} sweeps")
    return now.select(*DIMS, "share", "weight")


def budget_factor(cells: DataFrame, budget: float, rounds: int = 30) -> float:
    """The factor at which the expected share of tokens kept is ``budget``; probabilities stay at 1 at most."""
    factor = budget
    for _ in range(rounds):
        full = F.col("weight") * factor >= F.col("share")
        s = cells.agg(F.sum(F.when(full, F.col("share"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        if not s["rest"]:
            break
        new = (budget - (s["full"] or 0.0)) / s["rest"]
        if new <= factor * (1 + 1e-12):
            break
        factor = new
    return factor


def draw(key: str = "row.doc_id", text: str = "row.text") -> Column:
    """A number in [0, 1) that depends on the id alone, or on the text where the id is null."""
    name = F.coalesce(F.col(key).cast("string"), F.col(text), F.lit(""))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mixed(docs: DataFrame, budget: float = 0.8, powers: dict[str, float] = POWERS, sweeps: int = MOST, topic: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as ``row`` with source, lang, topic, tokens, probability and keep.

    Rows without tokens carry no weight and are kept. A repeated row shares the
    fate of its copies. An empty table gives no rows.
    """
    rows = features(docs, topic, text=text)
    counted = written(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    cells = raked(counted, powers, sweeps)
    factor = budget_factor(cells, budget)
    p = cells.select(*DIMS, F.least(F.lit(1.0), F.col("weight") * F.lit(factor) / F.col("share")).alias("probability"))
    out = rows.join(p, list(DIMS), "left")
    chance = F.when(F.col("tokens") == 0, 1.0).otherwise(F.col("probability"))
    return out.select("row", *DIMS, "tokens", chance.alias("probability")).withColumn("keep", draw(f"row.`{key}`", f"row.`{text}`") < F.col("probability"))


def mixed_sql(budget: float = 0.8, powers: dict[str, float] = POWERS, sweeps: int = 100, rounds: int = 12) -> str:
    """DuckDB form of the query above; SQL cannot ask whether it has converged, so it does a fixed and ample number of sweeps."""
    white = r"[^\x20\x09-\x0D]+"
    parts = [
        f"""f AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
  CAST(len(regexp_extract_all(coalesce(text, ''), '{white}')) AS BIGINT) AS tokens FROM documents)""",
        """d AS (SELECT doc_id, source, lang, tokens, CASE WHEN (n - length(translate(text, '#$%&*{}<>=', ''))) * 50 > n THEN 'markup'
  WHEN (n - length(replace(text, chr(10), '')) + 1) * 80 > n THEN 'list' WHEN n >= 8000 THEN 'long' ELSE 'prose' END AS topic, coalesce(CAST(doc_id AS VARCHAR), text) AS name FROM f)""",
        """c0 AS (SELECT source, lang, topic, sum(tokens) / (SELECT sum(tokens) FROM d) AS share, sum(tokens) / (SELECT sum(tokens) FROM d) AS weight
  FROM d GROUP BY ALL HAVING sum(tokens) > 0)""",
    ]
    for dim, power in powers.items():
        own = f"SELECT {dim}, pow(sum(share), {power}::DOUBLE) AS t FROM c0 GROUP BY {dim}"
        parts.append(f"t_{dim} AS (SELECT {dim}, t / sum(t) OVER () AS target FROM ({own}))")
    n = 0
    for _ in range(sweeps):
        for dim in powers:
            parts.append(
                f"c{n + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, share, weight * (target / sum(weight) OVER (PARTITION BY c.{dim})) AS weight FROM c{n} c JOIN t_{dim} t ON t.{dim} = c.{dim})"
            )
            n += 1
    parts.append(f"k0 AS (SELECT {budget}::DOUBLE AS k)")
    for i in range(rounds):
        parts.append(
            f"k{i + 1} AS MATERIALIZED (SELECT greatest(max(k), coalesce(({budget}::DOUBLE - coalesce(sum(share) FILTER (weight * k >= share), 0)) / nullif(sum(weight) FILTER (weight * k < share), 0), max(k))) AS k FROM c{n}, k{i})"
        )
    parts.append(f"p AS (SELECT d.*, CASE WHEN tokens = 0 THEN 1.0 ELSE least(1.0, c.weight * k / share) END AS probability FROM d LEFT JOIN c{n} c USING (source, lang, topic), k{rounds})")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, tokens, round(probability, 6) + 0.0 AS probability, CAST('0x' || substr(md5(name), 1, 13) AS UBIGINT) / 4503599627370496.0::DOUBLE < probability AS keep FROM p"
