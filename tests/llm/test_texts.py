"""Operators on texts against brute force, on hand-made cases and on sf0.001."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from llm.data import edge_docs, no_docs, texts_of, words

from loomline.llm import common, nearcopies, pii, ppm, quality, substrings

WORD = r"[^\x20\x09-\x0D]+"


def lower(text):
    return (text or "").encode().lower().decode()


def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(params=["edges", "sf0.001"])
def docs(request, spark):
    return edge_docs(spark) if request.param == "edges" else sf_docs(spark)


def test_words_and_hashes():
    texts = ["a  bé\tc", None, "", " x ", "long" * 1000, "a"]
    buf, at = common.text_buffer(pa.array(texts, pa.string()))
    start, end, first = common.words_of(buf, at)
    got = [[bytes(buf[start[i] : end[i]]).decode() for i in range(first[k], first[k + 1])] for k in range(len(texts))]
    assert got == [re.findall(WORD, t or "") for t in texts]
    h = common.word_hashes(buf, start, end)
    flat = [w for t in got for w in t]
    assert all((flat[i] == flat[j]) == (h[i] == h[j]) for i in range(len(flat)) for j in range(len(flat)))
    w = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    x = common.window_hashes(w, 3)
    assert x[0] == x[3] and len(set(x.tolist())) == 4 and not len(common.window_hashes(w, 8))
    assert [list(range(a, b)) for a, b in common.pieces(np.array([0, 5, 6, 30, 31]), 6)] == [[0, 1], [2], [3]]


# ---- op1 ---------------------------------------------------------------


def ppm_brute(rows, order):
    trained = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for d, _ in rows]
    seen, words_, = defaultdict(Counter), Counter()
    stream = [[255] * order + list(lower(t).encode()) + [254] for _, t in rows]
    for b, t in zip(stream, trained, strict=True):
        if t:
            for i in range(order, len(b)):
                for j in range(order + 1):
                    seen[tuple(b[i - j : i])][b[i]] += 1
    for (_, text), t in zip(rows, trained, strict=True):
        if t:
            words_.update(re.findall(WORD, lower(text)))
            words_[None] += 1

    def logp(history, s):
        gone, out = set(), 0.0
        for j in range(order, -1, -1):
            c = seen.get(tuple(history[order - j :]))
            if c is None:
                continue
            left = {a: n for a, n in c.items() if a not in gone}
            n, d = sum(left.values()), len(left)
            if s in left:
                return out + math.log10(left[s] / (n + d))
            if d:
                out += math.log10(d / (n + d))
            gone |= set(c)
        return out - math.log10(255 - len(gone))

    n, v = sum(words_.values()), len(words_)
    out = []
    for (d, text), t, b in zip(rows, trained, stream, strict=True):
        own = [*re.findall(WORD, lower(text)), None]
        base = sum(math.log10((words_[w] + 1) / (n + v + 1)) for w in own)
        score = sum(logp(b[i - order : i], b[i]) for i in range(order, len(b))) if len(b) < 20_000 else None
        out.append((d, not t, len(own), sum(words_[w] > 0 for w in own), n, base, score))
    return out


def test_ppm_equals_brute_force(spark, docs):
    got = ppm.ppm_scores(docs, order=3).collect()
    want = ppm_brute(texts_of(docs), 3)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert w[6] is None or g[6] == pytest.approx(w[6], rel=1e-9)


def test_ppm_probabilities_sum_to_one(spark):
    """Over all symbols after any context, seen or not."""
    rows = [(1, "abracadabra"), (3, "abra cad"), (5, "banana")]
    seen = spark.createDataFrame(rows, "doc_id long, text string")
    order = 2
    buf, at = common.text_buffer(pa.array([t for _, t in rows]))
    grams = Counter(ppm.grams_of(buf, at, order)[0].tolist())
    for context in (b"ab", b"zz", b"na", bytes([255, 255]), b"za"):
        every = {(context[0] * 256 + context[1]) * 256 + s: 0 for s in range(255)}
        counts = spark.createDataFrame([(g, n) for g, n in {**every, **grams}.items()], "gram long, n long")
        logs = {r["gram"]: r["logp"] for r in ppm.code_lengths(counts, order).collect()}
        assert sum(10 ** logs[g] for g in every) == pytest.approx(1)
    assert ppm.ppm_scores(seen, order=order).count() == 3


def test_ppm_without_rows_or_training(spark):
    assert ppm.ppm_scores(no_docs(spark)).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = ppm.ppm_scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string"), order=2).first()
    assert (r["train_tokens"], r["n_known"]) == (0, 0) and r["score"] == pytest.approx(-3 * math.log10(255))
    with pytest.raises(ValueError):
        ppm.ppm_scores(no_docs(spark), order=7)


# ---- op3 ---------------------------------------------------------------

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def strict_brute(text):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_strict_spans_equal_the_plain_patterns():
    r = random.Random(1)
    cases = ["a@b.c@d.e", "x@@y.z", "1.2.3.4.5.6.7.8", "01.002.3.4", "4111 1111 1111 1111", "+1 (", "++1 23456789 0", "a.@b-.c"]
    cases += ["".join(r.choice("a1.@-+ 9(2)0é") for _ in range(r.randint(0, 40))) for _ in range(20_000)]
    for t in cases:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.strict_and_loose(t)[0]] == strict_brute(t), t


def test_personal_data_keeps_the_base(spark, docs):
    got = pii.personal_data(docs).collect()
    texts = texts_of(docs)
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in texts)
    by = {d: strict_brute(t or "") for d, t in texts}
    for r in got:
        base = by[r["doc_id"]]
        out = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(out).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert set(out) <= set(r["spans"].split(",")) | {""}


def test_em_and_classifier_find_what_labelers_agree_on():
    good = pii._pattern(3, (1, 0, 2, 2, 2))  # a loose phone number after a cue
    bad = pii._pattern(3, (1, 0, 0, 1, 1))
    strong, noise = pii._pattern(3, (2, 2, 2, 2, 2)), pii._pattern(2, (1, 1, 0, 1, 1))
    counts = {strong: 900, good: 60, bad: 500, noise: 4000}
    p = pii.train(counts, pii.estimate(counts))
    assert p[strong] > 0.9 > 0.1 > p[noise] and p[bad] < 0.1 and p[good] > p[bad]
    assert pii.train({strong: 5}, pii.estimate({strong: 5}))[strong] > 0.5


def test_mask_and_empty_table(spark):
    assert pii.personal_data(no_docs(spark)).collect() == []
    d = spark.createDataFrame([("é a@b.cd +1 22 333 4444 x",), (None,), ("",)], "text string")
    assert [r[0] for r in d.select(pii.masked("text", [])).collect()] == ["é <EMAIL> <PHONE> x", None, ""]


# ---- op4 ---------------------------------------------------------------


def near_brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    out = [(d, len(sets[i]), first.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)]
    return Counter((*x, x[0] == x[2]) for x in out)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_copies_equal_brute_force(spark, docs, size, percent):
    got = Counter(tuple(r) for r in nearcopies.near_copies(docs, size, percent).collect())
    assert got == near_brute(texts_of(docs), size, percent)


def near_group(n, length=60):
    """Copies of one text with random replacements: many lie close to the threshold."""
    rows = []
    base = words(5, length, 10_000)
    for i in range(n):
        r, w = random.Random(i), list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(length)] = f"x{r.randrange(10_000)}"
        rows.append((i * 7 % n, " ".join(w)))
    common_part = words(6, 12, 10_000)  # and texts that share a passage and nothing else
    return rows + [(n + i, " ".join(common_part + words(1000 + i, 25, 10_000))) for i in range(n)]


def test_large_groups_are_split_and_no_link_is_lost(spark, monkeypatch):
    rows = near_group(150)
    monkeypatch.setattr(nearcopies, "NODE", 16)
    monkeypatch.setattr(nearcopies, "CHUNK", 16)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in nearcopies.near_copies(d, 3, 85).collect())
    assert got == near_brute(rows, 3, 85)


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["id"]: r["label"] for r in nearcopies.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 150: 100, 200: 100}


def test_near_copies_of_nothing(spark):
    assert nearcopies.near_copies(no_docs(spark)).collect() == []


# ---- op6 ---------------------------------------------------------------


def repeats_brute(rows, window):
    seen, split = Counter(), [re.findall(WORD, t or "") for _, t in rows]
    for w in split:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_cover_gives_every_shift():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_repeats_equal_brute_force(spark, docs):
    got = Counter(tuple(r) for r in substrings.remove_repeats(docs).collect())
    assert got == repeats_brute(texts_of(docs), 35)


@pytest.mark.parametrize("window", [21, 24, 35])
def test_repeats_at_every_offset(spark, window, monkeypatch):
    """A passage of exactly one window at 60 offsets, of one word less, within one text, and a periodic text."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 3000)
    passage, short = words(1, window, 10**6), words(2, window - 1, 10**6)
    rows = [(i, " ".join(words(50 + i, i, 10**6) + passage + words(150 + i, 5, 10**6))) for i in range(60)]
    rows += [(100 + i, " ".join(words(250 + i, i, 10**6) + short + words(350 + i, 3, 10**6))) for i in range(5)]
    twice = words(3, window, 10**6)
    rows += [(200, " ".join(twice + ["between"] + twice)), (201, "la " * 100), (202, "la " * window), (203, None)]
    got = Counter(tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).collect())
    assert got == repeats_brute(rows, window)


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(no_docs(spark)).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(no_docs(spark), window=20)


# ---- op7 ---------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and held.predicted[held.quality == 1].mean() > 0.97
    assert set(got.held_out[got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)]) == {True}


def test_quality_score_is_the_softmax_of_the_mean():
    rng = np.random.default_rng(0)
    examples = [(y, np.unique(rng.integers(y * 50, 100 + y * 50, 30)).astype(np.int32), None) for y in (0, 1) * 20]
    examples = [(y, r, np.full(len(r), 1 / len(r), np.float32)) for y, r, _ in examples]
    m = quality.train(examples)
    scores = [1 / (1 + np.exp(-(w @ m.weights[r] + m.offset))) for _, r, w in examples]
    assert np.mean([(s > 0.5) == y for s, (y, _, _) in zip(scores, examples, strict=True)]) > 0.9
    one, two = m.score(pa.array(["Some text, twice.", None, ""])), m.score(pa.array(["Some text, twice."]))
    assert one[0] == pytest.approx(two[0]) and one[1] == one[2] == pytest.approx(1 / (1 + np.exp(-m.offset)))


@pytest.mark.parametrize("texts", [["a a b", "", "xyz  xyz", "\u00e9t\u00e9 -", "\t \n"], ["ab", "ab"], [""], ["word " * 50, "w"]])
def test_quality_features_against_plain_python(texts):
    """Features that are equal share a row, and n-grams are those of the word between two spaces."""
    buf, at = common.text_buffer(pa.array(texts))
    words_, pairs, *grams = list(quality.feature_rows(buf, at))
    rows = {}
    for i, t in enumerate(texts):
        split = [w.encode() for w in re.findall(WORD, t)]
        assert len(words_[0][words_[1][i] : words_[1][i + 1]]) == len(split)
        for w, r in zip(split, words_[0][words_[1][i] : words_[1][i + 1]], strict=True):
            assert rows.setdefault(w, r) == r
        same = [0 if j == 0 else 2 if split[j - 1] == w else 1 for j, w in enumerate(split)]  # first, other, the same
        assert [rows.setdefault(("same", x), r) == r for x, r in zip(same, pairs[0][pairs[1][i] : pairs[1][i + 1]], strict=True)] == [True] * len(split)
        for n, (row, place) in zip(quality.NGRAMS, grams, strict=True):
            whole = b" " + re.sub(rb"[\x20\x09-\x0D]", b" ", t.encode()) + b" "
            want = [whole[j : j + n] for j in range(len(whole) - n + 1) if b" " not in whole[j + 1 : j + n - 1]]
            got = row[place[i] : place[i + 1]]
            assert [rows.setdefault((n, g), r) == r for g, r in zip(want, got, strict=True)] == [True] * len(want)
    assert len(set(rows.values())) >= len(rows) - 1  # hashing into 262,144 rows


def test_quality_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, w * 300) for i, w in enumerate(["good fine ", "bad poor "] * 20)] + [(3, "zzz")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    taken = []

    def spy(examples, **options):
        taken.append(len(examples))
        return quality.Model(np.zeros(quality.ROWS, np.float32), 0.0)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "train", spy)
        for size in (quality.SAMPLE_BYTES, 9000, 0):
            quality.fit(docs, labels, sample_bytes=size)
    learned = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40))
    assert taken[0] == learned and 2 <= taken[1] <= 4 and taken[2] == 0


def test_candidates_for_pii_take_linear_time():
    """As many strict spans as loose ones, in a text of a megabyte."""
    import time

    text = "mail ann.lee@example.com or bob (at) example (dot) org, 555 010 9999 or 999.999.999.999; " * 12_000
    start = time.perf_counter()
    strict, loose = pii.strict_and_loose(text)
    assert len(strict) >= 12_000 and len(loose) >= 12_000 and time.perf_counter() - start < 20


def test_quality_edges(spark):
    d = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 1, 0), (5, 0, 0), (99, 0, 1), (9, 2, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(d, labels).collect()
    assert len(got) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality.quality_scores(d, labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(no_docs(spark), labels).collect() == []
