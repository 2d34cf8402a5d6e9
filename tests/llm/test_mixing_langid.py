"""Raking and evidence fusion against plain Python."""

import collections
import math

import numpy as np
import pytest
from conftest import SF
from llm.data import edge_docs, no_docs
from pyspark.sql import functions as F

from loomline.llm import langid, mixing


def test_raked_marginals_meet_the_targets(spark):
    rows = [(s, g, t, 1 + 37 * i % 101 * (9 if s == "a" else 1)) for i, (s, g, t) in enumerate((s, g, t) for s in "abc" for g in ("en", "fr") for t in "xyz")]
    rows.append(("d", "en", "x", 0))
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    powers = {"source": 0.5, "lang": 0.0, "topic": 1.0}
    got = mixing.raked(cells, powers, sweeps=60).collect()
    assert len(got) == 18
    total = sum(r[3] for r in rows)
    for dim, power in powers.items():
        share = collections.Counter()
        for r in rows[:-1]:
            share[dict(zip(mixing.DIMS, r, strict=False))[dim]] += r[3] / total
        want = {k: v**power for k, v in share.items()}
        has = collections.Counter()
        for r in got:
            has[r[dim]] += r["weight"]
        for k, v in want.items():
            assert has[k] == pytest.approx(v / sum(want.values()), rel=1e-4)


def tied(off):
    """Tokens of 8 sources x 4 languages x 4 topics: a share ``off`` of a source is not in its own language."""
    r = np.random.default_rng(3)
    x = r.uniform(0.5, 2, (8, 4, 4)) * np.array([30, 1, 8, 2, 1, 5, 1, 3])[:, None, None]
    x *= np.where(np.arange(8)[:, None] % 4 == np.arange(4), 1 - off, off / 3)[:, :, None]
    return np.maximum(1, np.round(1e7 * x)).astype(int)


def rake(tokens, powers, sweeps):
    """Weights after so many sweeps, the targets, and the largest relative error of a marginal."""
    share = tokens / tokens.sum()
    w = share.copy()
    targets = []
    for d, p in enumerate(powers.values()):
        t = share.sum(axis=tuple(i for i in range(3) if i != d), keepdims=True) ** p
        targets.append((tuple(i for i in range(3) if i != d), t / t.sum()))
    for _ in range(sweeps):
        for other, t in targets:
            w = w * (t / w.sum(axis=other, keepdims=True))
    return w, max(np.abs(w.sum(axis=o, keepdims=True) / t - 1).max() for o, t in targets)


@pytest.mark.parametrize("few", [0, 1000])
def test_raking_goes_on_until_the_marginals_meet_their_targets(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    tokens = tied(0.05)
    want, error = rake(tokens, mixing.POWERS, 2000)
    assert error < 1e-12 and rake(tokens, mixing.POWERS, 6)[1] > 0.01
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(n)) for (i, j, k), n in np.ndenumerate(tokens)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").coalesce(1)
    got = {tuple(r)[:3]: r["weight"] for r in mixing.raked(cells).collect()}
    assert len(got) == want.size
    for (i, j, k), w in np.ndenumerate(want):
        assert got[f"s{i}", f"l{j}", f"t{k}"] == pytest.approx(w, rel=1e-6)
    with pytest.raises(RuntimeError, match="off its targets"):
        mixing.raked(cells, sweeps=6)


def test_targets_that_contradict_each_other_end_with_a_warning(spark):
    rows = [("a", "en", "x", 900), ("b", "fr", "x", 100)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="no weights meet all targets"):
        got = {r["lang"]: r["weight"] for r in mixing.raked(cells).collect()}
    assert got == pytest.approx({"en": 0.9**0.7 / (0.9**0.7 + 0.1**0.7), "fr": 0.1**0.7 / (0.9**0.7 + 0.1**0.7)})


@pytest.mark.parametrize("budget", [0.1, 0.5, 0.9, 1.0])
def test_budget_is_met_with_probabilities_of_one_at_most(spark, budget):
    rows = [(0.6, 0.2), (0.3, 0.4), (0.1, 0.4)]
    k = mixing.budget_factor(spark.createDataFrame(rows, "share double, weight double"), budget)
    assert sum(min(s, w * k) for s, w in rows) == pytest.approx(budget, rel=1e-6)


def test_mixture_edges(spark):
    d = edge_docs(spark)
    got = mixing.mixed(d).collect()
    assert len(got) == d.count()
    for r in got:
        assert 0 <= r["probability"] <= 1 and (r["tokens"] > 0 or r["keep"]) and r["row"]["block"] == 6
    assert len({r["keep"] for r in got if r["row"]["doc_id"] == 10}) == 1
    assert {r["source"] for r in got} >= {"", "a"}
    assert mixing.mixed(no_docs(spark)).collect() == []
    plan = mixing.mixed(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_kept_tokens_come_near_the_budget(spark):
    d = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    kept = mixing.mixed(d, budget=0.5).agg(F.sum(F.when(F.col("keep"), F.col("tokens"))) / F.sum("tokens")).first()[0]
    assert 0.4 < kept < 0.6


# ---- languages ---------------------------------------------------------

LANGS = ("de", "en", "es", "fr")


def fuse(rows, profile):
    """(page_id, text_lang, lang, confidence) by loops."""
    seen = []
    for i, url, page in rows:
        text = np.frombuffer(langid.visible_text(page or "").encode(), np.uint8)
        h, _ = langid.trigram_buckets(text, np.array([0, len(text)]))
        like = profile[:, h].astype(np.float64).mean(axis=1) * min(len(h), 60) if len(h) else np.zeros(4)
        post = np.exp(like - like.max())
        post /= post.sum()
        m = langid.re.search(r"""<html[^>]*\slang\s*=\s*["']?([A-Za-z]+)""", page or "", langid.re.I)
        code = m.group(1).lower() if m else ""
        m = langid.re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
        seen.append((i, (m.group(1) if m else "").lower(), code if code in LANGS or not code else "other", like, post))
    total = sum(s[4] for s in seen)
    said, sums = collections.defaultdict(lambda: np.zeros(4)), collections.defaultdict(lambda: np.zeros(4))
    for _, host, code, _, post in seen:
        said[code] += post
        for level in {("h", host), ("d", ".".join(host.split(".")[-2:])), ("s", host.split(".")[-1])}:
            sums[level] += post
    base = (total + 1) / (total.sum() + 4)
    out = []
    for i, host, code, like, post in seen:
        prior = base
        for level in (("s", host.split(".")[-1]), ("d", ".".join(host.split(".")[-2:]))):
            prior = (sums[level] + 5 * prior) / (sums[level].sum() + 5)
        others = np.maximum(sums["h", host] - post, 0)
        prior = (others + 5 * prior) / (max(sums["h", host].sum() - post.sum(), 0) + 5)
        logs = like + np.log((said[code] + 1) / (total + 6)) + np.log(prior)
        p = np.exp(logs - logs.max())
        p /= p.sum()
        out.append((i, LANGS[int(post.argmax())], LANGS[int(p.argmax())], p.max()))
    return out


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 0.5) for r in rows], "page_id long, url string, html string, n int, counts string, prior double").repartition(2)


def test_fusion_equals_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profile = langid.profiles(docs)
    assert np.exp(profile.astype(float)).sum(axis=1) == pytest.approx(np.ones(4), rel=1e-4)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    rows += [
        (900, None, None), (901, "", ""), (None, "https://u@www.x.de:80/a", '<HTML class=a LANG="xx-YY"><p>der und die</p>'), (903, "http://www.x.de", "<html lang=de>"),
        (904, "http://www.x.de", "<html lang=de>"), (904, "http://www.x.de", "<html lang=de>"), (905, "not a url", "plain words and the <b>text</b>" * 5000),
        (906, "http://tionsh.example.net/", "<html lang='fr'><script>the and of</script>le la &eacute;t&eacute;"),
    ]
    got = langid.fused(pages(spark, rows), profile).collect()
    key = lambda r: (str(r[0]), r[-1])
    want = sorted(fuse(rows, profile), key=key)
    assert len(got) == len(want)
    for g, w in zip(sorted(((r["page_id"], r["text_lang"], r["lang"], r["confidence"]) for r in got), key=key), want, strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-6)


def test_declared_languages_are_found_again(spark):
    profile = langid.profiles(spark.read.parquet(f"{SF}/documents.parquet"))
    got = langid.fused(spark.read.parquet(f"{SF}/pages.parquet"), profile)
    assert got.where("lang = declared").count() >= 0.95 * got.count()
    without = langid.fused(spark.read.parquet(f"{SF}/pages.parquet").withColumn("html", F.regexp_replace("html", "<html[^>]*>", "<html>")), profile)
    assert without.join(got.select("page_id", F.col("declared").alias("d")), "page_id").where("lang = d").count() >= 0.9 * got.count()


def test_no_pages_and_no_documents(spark):
    flat = langid.profiles(no_docs(spark))
    assert (flat == flat[0, 0]).all()
    assert langid.fused(pages(spark, []), flat).collect() == []
    assert math.isclose(langid.fused(pages(spark, [(1, None, None)]), flat).first()["confidence"], 0.25, rel_tol=1e-6)


def test_languages_follow_the_labels_of_the_documents(spark, tmp_path):
    from loomline.llm.queries import QUERIES

    said = {"en": "the house and the garden with their trees ", "it": "la casa e il giardino con gli alberi della zia ", "fr": "la maison et le jardin avec les arbres "}
    docs = [(i, said[g] * 40, g, "a", None) for i, g in enumerate(said)] + [(8, "1 2 3", "xx", "a", 5), (9, "no label", None, "a", 8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, f"http://h{i}.org/", f"<html><p>{text * 3}</p></html>") for i, text in enumerate(said.values())]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["lang"] for r in QUERIES["op9_language_fusion"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(said))


def test_visible_text():
    """As two passes of ``<!--.*?-->|<(script|style)\\b.*?</\\1\\s*>`` and ``<[^>]*>`` would leave it; hostile pages take linear time."""
    import html
    import random
    import re
    import time

    hidden = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
    rng = random.Random(5)
    bits = ["<!--", "-->", "<script>", "</script >", "<STYLE a>", "</style>", "<scripted>", "<", ">", "a", " ", "<p>", "&amp;", "<script", "</Script>"]
    for _ in range(3000):
        page = "".join(rng.choices(bits, k=rng.randrange(12)))
        want = html.unescape(re.sub(r"<[^>]*>", " ", hidden.sub(" ", page)))
        assert langid.visible_text(page) == want, page
    start = time.perf_counter()
    for bit in ("<", "<script ", "<!--", "<style><script>", "<!-- <b"):
        langid.visible_text(bit * 200_000)
    assert time.perf_counter() - start < 20


def test_a_host_with_most_pages(spark, monkeypatch):
    """The host that is joined by a broadcast gives the same rows as by the ordinary join."""
    from loomline.operators import joins

    rows = [(i, f"http://{'big.example.de' if i % 3 else f'h{i % 7}.example.fr'}/{i}", f"<html lang='{'de' if i % 2 else 'fr'}'>wort und der das {i}</html>") for i in range(120)]
    rows += [(500, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    profile = np.log(np.full((2, langid.BUCKETS), 1 / langid.BUCKETS, np.float32))
    plain = sorted(map(tuple, langid.fused(pages, profile, ("de", "fr")).collect()))
    monkeypatch.setattr(langid, "lookup_join", lambda *a: joins.lookup_join(*a, share=10, least=5))
    assert sorted(map(tuple, langid.fused(pages, profile, ("de", "fr")).collect())) == plain and len(plain) == 121
