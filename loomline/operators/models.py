"""Forecast and text models on ``pyspark.ml``."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.factors import time_folds
from loomline.operators.text import WORD_GAP
from loomline.session import batches_of, written

SEED = 7


def estimator(model: str, n_estimators: int = 20, max_depth: int = 3, learning_rate: float = 0.1, reg: float = 0.0):
    """A regressor by the documented names; boosted trees stand in for the
    external boosters."""
    if model in ("lightgbm", "xgboost", "gbt"):
        return GBTRegressor(featuresCol="x", labelCol="label", maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, seed=SEED)
    if model == "random_forest":
        return RandomForestRegressor(featuresCol="x", labelCol="label", numTrees=n_estimators, maxDepth=max_depth, seed=SEED)
    mix = {"linear": 0.0, "ridge": 0.0, "lasso": 1.0}
    if model in mix:
        return LinearRegression(featuresCol="x", labelCol="label", regParam=0.0 if model == "linear" else reg, elasticNetParam=mix[model])
    raise ValueError(f"unknown model {model!r}")


class MLEngine:
    """Fit on time-ordered folds and predict their test dates. ``data`` is read twice."""

    def __init__(self, data: DataFrame, names: list[str], train_length: int, test_length: int, n_splits: int, lookahead: int):
        # iterative fits read the rows many times: written once, a folder for each part of a fold, so that a fit reads its own
        folds = time_folds(data, train_length, test_length, n_splits, lookahead)
        self.rows = written(data.join(folds, "date"), "folds", "fold", "part")
        self.names, self.n_splits = names, n_splits
        self.models: list = []

    def fit_fold(self, k: int, model: str, **params):
        train = self.rows.where((F.col("fold") == k) & (F.col("part") == "train"))
        return Pipeline(stages=[VectorAssembler(inputCols=self.names, outputCol="x"), estimator(model, **params)]).fit(train)

    def train_predict(self, model: str, **params) -> DataFrame:
        """(date, sym, fold, label, prediction) over all test folds."""
        out = None
        self.models = []
        for k in range(self.n_splits):
            m = self.fit_fold(k, model, **params)
            self.models.append(m)
            p = m.transform(self.rows.where((F.col("fold") == k) & (F.col("part") == "test"))).select(
                "date", "sym", "fold", "label", "prediction")
            out = p if out is None else out.unionByName(p)
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a prediction by the model of the latest fold; rows
        that lack a feature get none. Train first."""
        if not self.models:
            raise ValueError("train before predicting")
        whole = rows.na.drop(subset=self.names)
        keys = [c for c in rows.columns if c not in self.names]
        done = self.models[0].transform(whole).select(*rows.columns, "prediction")
        lacking = rows.where(" OR ".join(f"`{c}` IS NULL" for c in self.names)) if keys else rows.limit(0)
        return done.unionByName(lacking.withColumn("prediction", F.lit(None).cast("double")))

    def importances(self) -> DataFrame:
        """Features by mean importance over the fitted folds."""
        rows = []
        for k, m in enumerate(self.models):
            last = m.stages[-1]
            v = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
            rows += [(k, f, abs(float(x))) for f, x in zip(self.names, v.toArray())]
        d = self.rows.sparkSession.createDataFrame(rows, "fold int, feature string, importance double")
        return d.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


def auto_search(engine: MLEngine, grid: list[dict], metric, max_trials: int | None = None, time_budget: float | None = None) -> DataFrame:
    """Score every setting by ``metric(predictions) -> (score)`` and rank them.
    Stops by count or elapsed time; settings that were not tried come last and
    are marked so. All settings share one scoring job."""
    start, parts, names = time.monotonic(), [], []
    for i, g in enumerate(grid):
        name = ",".join(f"{k}={v}" for k, v in sorted(g.items()))
        names.append((name, i))
        if (max_trials is not None and i >= max_trials) or (time_budget is not None and parts and time.monotonic() - start > time_budget):
            continue
        parts.append(engine.train_predict(**g).withColumn("setting", F.lit(name)))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    every = engine.rows.sparkSession.createDataFrame(names, "setting string, position int")
    scored = metric(allp).withColumn("tried", F.lit(True))
    out = every.join(scored, "setting", "left").withColumn("tried", F.coalesce("tried", F.lit(False)))
    return out.orderBy(F.desc("tried"), F.desc_nulls_last("score"), "setting")


def best_setting(ranked: DataFrame, grid: list[dict]) -> dict:
    """The arguments of the best setting of ``auto_search``, to train with."""
    return grid[ranked.where("tried").first()["position"]]


def cluster_assets(profile: DataFrame, cols: list[str], k: int) -> DataFrame:
    d = profile.na.drop(subset=cols)
    p = Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True),
        KMeans(featuresCol="x", predictionCol="cluster", k=k, seed=SEED, maxIter=20)])
    return p.fit(d).transform(d).select("sym", "cluster")


def _tokens() -> RegexTokenizer:
    return RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD_GAP, toLowercase=True, minTokenLength=1)


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, words), written once: models read them many times and split no text again."""
    return written(_tokens().transform(docs.select("doc_id", "text")).select("doc_id", "words"), "tokens")


# ---- topics ---------------------------------------------------------------------------

#: Words of documents whose topics are found at once, and words whose sums are added up at once.
WORDS_AT_ONCE, SUMS_AT_ONCE = 1 << 15, 1 << 20


def _digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    i = 1 / (y * y)
    return np.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i / 252)) - sum(1 / (x + j) for j in range(6))


def _trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    i = 1 / (y * y)
    return 1 / y + i / 2 + i / y * (1 / 6 - i * (1 / 30 - i / 42)) + sum(1 / (x + j) ** 2 for j in range(6))


def _expected_logs(x: np.ndarray, axis: int = 0) -> np.ndarray:
    """Expected logarithms of Dirichlet shares."""
    return _digamma(x) - _digamma(x.sum(axis=axis, keepdims=True))


def document_topics(ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, beta: np.ndarray, alpha: np.ndarray):
    """Shares of topics in some documents, whose terms and counts stand one after another, until they change by less than
    a thousandth: the Dirichlet parameters, and for each term its count over its chance. After two steps a document goes on
    from where they point to (SQUAREM), as the first round alone has thousands of small ones; documents that are done drop out."""
    gamma, odds = np.ones((len(alpha), len(sizes))), np.zeros(len(ids), "float32")
    live, at = np.arange(len(sizes)), np.arange(len(ids))
    b, c, n, g, before = beta[:, ids], counts.astype("float32"), sizes, gamma, None
    while len(live):
        t = np.exp(_expected_logs(g)).astype("float32")
        r = c / ((np.repeat(t, n, axis=1) * b).sum(axis=0) + np.float32(1e-30))
        new = alpha[:, None] + t * np.add.reduceat(b * r, np.cumsum(n) - n, axis=1)
        move = new - g
        go = np.abs(move).mean(axis=0) > 1e-3
        gamma[:, live], odds[at] = new, r
        if before is None:
            g, before = new, move
        else:
            bend = move - before
            far = np.clip(np.sqrt((before**2).sum(axis=0) / np.maximum((bend**2).sum(axis=0), 1e-30)), 1, 256)
            g, before = np.maximum(g - before + 2 * far * before + far * far * bend, alpha[:, None]), None
        if not go.all():
            keep = np.repeat(go, n)
            live, n, at, b, c, g = live[go], n[go], at[keep], b[:, keep], c[keep], g[:, go]
            before = None if before is None else before[:, go]
    return gamma, odds


def _encoded(words: DataFrame, known: list[str]) -> DataFrame:
    """(ids, counts) of the known terms of each document that has any, written."""
    terms = words.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        value_set = pa.array(terms.value, pa.string())
        for batch in batches:
            w = batch["words"]
            at = pc.index_in(w.flatten(), value_set=value_set)
            has = at.is_valid().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(w)), pc.fill_null(pc.list_value_length(w), 0).to_numpy())[has]
            key, n = np.unique(of * len(value_set) + at.drop_null().to_numpy(), return_counts=True)
            ends = np.append(np.flatnonzero(np.diff(key // len(value_set), prepend=-1)), len(key))
            lists = (pa.ListArray.from_arrays(pa.array(ends, "int32"), pa.array(x, "int32")) for x in (key % len(value_set), n))
            yield pa.RecordBatch.from_arrays(list(lists), ["ids", "counts"])

    with batches_of(words.sparkSession, "16m"):
        return written(words.select("words").mapInArrow(run, "ids array<int>, counts array<int>"), "word-counts")


def _round(docs: DataFrame, beta: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """What all documents add to each term, a column a topic: a task's sums by term are added by Spark. Two more rows have
    the sums of the documents' expected logarithms and the number of documents."""
    k, terms = beta.shape
    shared = docs.sparkSession.sparkContext.broadcast((beta.astype("float32"), alpha))

    def run(batches):
        b, a = shared.value
        total, logs, n_docs, waiting = np.zeros((k, terms)), np.zeros(k), 0, [[], []]

        def add():
            ids = np.concatenate(waiting[0])
            weights = np.concatenate(waiting[1], axis=1)
            for i in range(k):
                total[i] += np.bincount(ids, weights[i], minlength=terms)
            waiting[0].clear(), waiting[1].clear()

        for batch in batches:
            ids, counts = (batch[x].flatten().to_numpy() for x in ("ids", "counts"))
            sizes = pc.list_value_length(batch["ids"]).to_numpy()
            ends = np.cumsum(sizes)
            part = (ends - 1) // WORDS_AT_ONCE if len(ends) else ends
            for lo, hi in zip(np.flatnonzero(np.diff(part, prepend=-1)), [*np.flatnonzero(np.diff(part)) + 1, len(part)], strict=True):
                x = slice(ends[lo] - sizes[lo], ends[hi - 1])
                gamma, odds = document_topics(ids[x], counts[x], sizes[lo:hi], b, a)
                e = _expected_logs(gamma)
                logs += e.sum(axis=1)
                n_docs += hi - lo
                waiting[0].append(ids[x])
                waiting[1].append(np.repeat(np.exp(e).astype("float32"), sizes[lo:hi], axis=1) * odds)
                if sum(map(len, waiting[0])) > SUMS_AT_ONCE:
                    add()
        if n_docs:
            if waiting[0]:
                add()
            some = np.flatnonzero(total.any(axis=0))
            values = np.column_stack([total[:, some], logs, np.full(k, n_docs)])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [terms, terms + 1]), "int32"), *map(pa.array, values)], ["id", *names])

    names = [f"s{i}" for i in range(k)]
    with batches_of(docs.sparkSession, "16m"):
        sums = docs.mapInArrow(run, "id int, " + ", ".join(f"{c} double" for c in names)).groupBy("id").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    shared.unpersist()
    out = np.zeros((terms + 2, k))
    out[sums["id"].to_numpy()] = np.column_stack([sums[c].to_numpy() for c in names])
    return out


def _new_alpha(alpha: np.ndarray, logs: np.ndarray, n: float, rate: float) -> np.ndarray:
    """A Newton step towards the likeliest parameters of the documents' shares, unless one would not stay above zero."""
    slope = n * (logs - _expected_logs(alpha))
    q = -n * _trigamma(alpha)
    b = (slope / q).sum() / (1 / (n * _trigamma(alpha.sum())) + (1 / q).sum())
    new = alpha - rate * (slope - b) / q
    return new if (new > 0).all() else alpha


def topics(docs: DataFrame, k: int, vocab: int = 1 << 18, terms: int = 10, rounds: int = 10) -> DataFrame:
    """Top terms of each topic by online variational Bayes, every round over all documents, with the rates and first
    values of ``pyspark.ml.clustering.LDA``. ``vocab`` is the number of most frequent terms that the model knows and bounds
    what the driver holds; of the vocabulary only the top terms go into the result's plan. Documents begin a round with equal
    shares, so the topics do not depend on how they are dealt to tasks, but for the order of sums."""
    w = tokens(docs)
    known = sorted(CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocab, minDF=2.0).fit(w).vocabulary)
    counts = _encoded(w, known)
    weights, alpha = np.random.default_rng(SEED).gamma(100, 1 / 100, (k, len(known))), np.full(k, 1 / k)
    for i in range(1, rounds + 1):
        beta = np.exp(_expected_logs(weights, axis=1))
        sums = _round(counts, beta, alpha)
        rate, n = (1024 + i) ** -0.51, sums[-1, 0]
        weights = (1 - rate) * weights + rate * (1 / k + sums[:-2].T * beta)
        alpha = _new_alpha(alpha, sums[-2] / n, n, rate) if n else alpha
    shares = weights / weights.sum(axis=1, keepdims=True)
    best = np.argsort(-shares, axis=1, kind="stable")[:, :terms]
    top = [(t, i, known[j], float(shares[t, j])) for t in range(k) for i, j in enumerate(best[t])]
    return docs.sparkSession.createDataFrame(top, "topic int, rank int, term string, weight double")


# ---- word vectors ---------------------------------------------------------------------

#: Words of text that one task trains on, and that it takes at a step.
PART_WORDS, STEP_WORDS = 1_000_000, 512
#: Largest distance of two words that are trained as neighbours, other words drawn at a step, their weight, and the rate.
WINDOW, DRAWN, NEGATIVES, RATE = 5, 64, 5.0, 0.25


def _start(seeds: np.ndarray, size: int) -> np.ndarray:
    """Small vectors that depend on the seeds alone, so that every task starts a word alike."""
    with np.errstate(over="ignore"):
        x = seeds.astype("uint64")[:, None] + np.arange(1, size + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x >> np.uint64(40)).astype("float32") / 2**24 - 0.5) / size).astype("float32")


def _odds(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _climb(v: np.ndarray, seen: np.ndarray, ids: np.ndarray, slope: np.ndarray) -> None:
    """A step up the slopes, summed by word, in rates that fall with what a word has moved (Adagrad)."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    at, g = ids[order][first], np.add.reduceat(slope[order], first, axis=0)
    seen[at] += g * g
    v[at] += RATE * g / np.sqrt(seen[at])


def skip_grams(ids: np.ndarray, doc: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
    """One pass of skip-gram with negative sampling over numbered words, in place. ``near`` has the vectors of words,
    ``far`` those of neighbours. Distances are drawn up to WINDOW for each word, and the other words from the text itself."""
    rng = np.random.default_rng(SEED)
    seen_near, seen_far = np.ones_like(near), np.ones_like(far)
    for lo in range(0, len(ids), STEP_WORDS):
        i, d = ids[lo:lo + STEP_WORDS], doc[lo:lo + STEP_WORDS]
        x, y, reach = near[i], far[i], rng.integers(1, WINDOW + 1, len(i))
        dx, dy, pairs = np.zeros_like(x), np.zeros_like(y), np.zeros(len(i), "float32")
        for k in range(1, min(WINDOW, len(i) - 1) + 1):
            same = d[k:] == d[:-k]
            for a, b in ((slice(None, -k), slice(k, None)), (slice(k, None), slice(None, -k))):
                use = (same & (reach[a] >= k)).astype("float32")
                e = (use * (1 - _odds(np.einsum("ij,ij->i", x[a], y[b]))))[:, None]
                dx[a] += e * y[b]
                dy[b] += e * x[a]
                pairs[a] += use
        other = ids[rng.integers(0, len(ids), DRAWN)]
        z = far[other]
        e = _odds(x @ z.T) * (pairs * (NEGATIVES / DRAWN))[:, None]
        _climb(near, seen_near, i, dx - e @ z)
        _climb(far, seen_far, np.concatenate([i, other]), np.concatenate([dy, -(e.T @ x)]))


class WordVectors:
    """A stored table ``(word, c, vector)``."""

    def __init__(self, table: DataFrame):
        self.table = table

    def getVectors(self) -> DataFrame:
        return self.table.select("word", "vector")

    def findSynonyms(self, word: str, num: int) -> DataFrame:
        """``(word, similarity)`` of the words with the largest cosine, ties to the smaller word."""
        def inner(v, w):
            return F.aggregate(F.zip_with(v, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)

        one = self.table.where(F.col("word") == word).select(F.col("vector").alias("_v"))
        v, w = F.col("vector"), F.col("_v")
        d = self.table.where(F.col("word") != word).join(F.broadcast(one))
        d = d.select("word", F.try_divide(inner(v, w), F.sqrt(inner(v, v) * inner(w, w))).alias("similarity"))
        return d.orderBy(F.desc_nulls_last("similarity"), "word").limit(num)


def word_counts(words: DataFrame) -> DataFrame:
    """(word, c) of stored ``tokens``, written."""
    return written(words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c")), "word-frequencies")


def word_vectors(words: DataFrame, size: int = 16, min_count: int = 5, rounds: int = 1, counts: DataFrame | None = None) -> WordVectors:
    """Word vectors of stored ``tokens`` by skip-gram; words below ``min_count`` have none and are no neighbours.

    The text is dealt to parts of bounded size. A part meets the vectors of its own words only, trains them, and gives
    them back; each word's are averaged over its parts by how often it is there. No vocabulary is on the driver or in
    one task as a whole.
    """
    counts = word_counts(words) if counts is None else counts
    parts = max(1, -(-int(counts.agg(F.sum("c")).first()[0] or 0) // PART_WORDS))
    dealt = words.select(F.pmod(F.xxhash64("doc_id", "words"), F.lit(parts)).cast("int").alias("part"), "words")
    known = counts.where(F.col("c") >= min_count)
    held = dealt.select("part", F.explode(F.array_distinct("words")).alias("word")).distinct().join(known, "word")
    held = written(held.select("part", "word", F.xxhash64("word", F.lit(SEED)).alias("seed")), "words-of-parts")
    a, b = ([f"{x}{i}" for i in range(size)] for x in "ab")

    def train(text: pa.Table, local: pa.Table) -> pa.Table:
        local = local.combine_chunks()
        v = [_start(local["seed"].to_numpy(), size), np.zeros((local.num_rows, size), "float32")] if a[0] not in local.column_names else [
            np.column_stack([local[c].to_numpy() for c in x]).astype("float32") for x in (a, b)]
        ids, docs = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        for n, chunk in enumerate(text["words"].chunks if local.num_rows else []):
            at = pc.index_in(chunk.flatten(), value_set=local["word"].combine_chunks())
            has = at.is_valid().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(chunk)), pc.fill_null(pc.list_value_length(chunk), 0).to_numpy())
            ids.append(at.drop_null().to_numpy().astype("int64"))
            docs.append(of[has] + (n << 32))
        ids = np.concatenate(ids)
        if len(ids):
            skip_grams(ids, np.concatenate(docs), *v)
        n = np.bincount(ids, minlength=local.num_rows)
        columns = {c: x[:, i] for names, x in ((a, v[0]), (b, v[1])) for i, c in enumerate(names)}
        return pa.table({"word": local["word"], "n": pa.array(n, "int64"), **{c: pa.array(x) for c, x in columns.items()}})

    schema = "word string, n long, " + ", ".join(f"{c} float" for c in a + b)
    vectors = None
    for _ in range(rounds):
        local = held if vectors is None else held.join(vectors, "word")
        trained = dealt.groupBy("part").cogroup(local.groupBy("part")).applyInArrow(train, schema)
        mean = trained.groupBy("word").agg(*((F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("float").alias(c) for c in a + b))
        vectors = written(mean, "trained") if rounds > 1 else mean
    return WordVectors(written(vectors.join(known, "word").select("word", "c", F.array(*a).alias("vector")), "word-vectors"))
