"""Language of pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the likelihood of the visible
text under byte-trigram profiles learned from labelled documents, the language
that the markup declares, and a prior for the host that is smoothed towards its
domain, the domain towards the address suffix, the suffix towards all pages.
How far declarations can be trusted and the priors are grouped aggregates of
the text posteriors; a page's own posterior is taken out of its host's counts.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import LOWER, pieces, text_buffer, written
from loomline.operators.joins import lookup_join

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 14
PIECE_BYTES = 2 << 20
#: Trigrams of a text that count as independent at most; pseudo-counts of each smoothing step.
EFFECTIVE, STRENGTH = 60.0, 5.0

_HIDDEN = re.compile(r"<!--|<(script|style)\b", re.I)
_SHOWN = {0: re.compile("-->"), 6: re.compile(r"</script\s*>", re.I), 5: re.compile(r"</style\s*>", re.I)}  # by length of the name
_TAG = re.compile(r"<[^>]*>")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def visible_text(page: str) -> str:
    """The text without comments, scripts, styles and tags; what is never closed stays. The time is linear in the page:
    a kind that has no end ahead is not looked for again, and tags only before the last ``>``."""
    parts, at, start, endless = [], 0, 0, set()
    while opened := _HIDDEN.search(page, start):
        kind = len(opened[1] or "")
        closed = None if kind in endless else _SHOWN[kind].search(page, opened.end())
        if closed:
            parts += [page[at : opened.start()], " "]
            at = start = closed.end()
        else:
            endless.add(kind)
            start = opened.start() + 1
    left = "".join([*parts, page[at:]])
    last = left.rfind(">") + 1
    return entities.unescape(_TAG.sub(" ", left[:last]) + left[last:])


def trigram_buckets(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each text, lower-cased, anything but letters as one kind of gap; and the texts' places."""
    x = np.where(_LETTER[buf], LOWER[buf], 0x20).astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    g = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]
    ok = x[1:-1] != 0x20
    inner = at[1:-1]
    for shift in (1, 2):  # trigrams that would run over the end of a text
        edge = inner - shift
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    place = np.flatnonzero(ok)
    h = (g[place] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)
    return h.astype(np.int64), np.searchsorted(place, at)


def _profile_counts(languages: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            lang = np.array([languages.index(x) for x in b.column("lang").to_pylist()], np.int64)
            buf, at = text_buffer(b.column("text"))
            for i, j in pieces(at, PIECE_BYTES):
                h, place = trigram_buckets(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                own = np.repeat(lang[i:j], np.diff(place))
                total += np.bincount(own * BUCKETS + h, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.record_batch([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket], pa.int64())], names=["lang", "bucket", "n"])

    return run


def languages_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[str, ...]:
    """All labels of documents with a letter at least, by name; ``LANGUAGES`` where nothing is labelled."""
    labelled = docs.where((F.trim(lang) != "") & F.col(text).rlike(r"[A-Za-z]|[^\x00-\x7F]"))
    return tuple(sorted(r[0] for r in labelled.groupBy(F.col(lang)).count().collect())) or LANGUAGES


def profiles(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Log probability of each trigram bucket in each language, from all documents labelled with one of them."""
    known = docs.where(F.col(lang).isin(*languages)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = known.mapInArrow(_profile_counts(languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.ones((len(languages), BUCKETS))
    found = counted.toArrow()  # at most languages * BUCKETS rows
    counts[found["lang"].to_numpy(), found["bucket"].to_numpy()] += found["n"].to_numpy()
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(page: str | Column, profile: np.ndarray) -> Column:
    """Log likelihood of the visible text in each language; zeros for a page without text."""

    @F.arrow_udf("array<double>")
    def evidence(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), len(profile)))
        for k, value in enumerate(column):
            shown = visible_text(value.as_py() or "").encode()
            buf = np.frombuffer(shown, np.uint8)
            h, _ = trigram_buckets(buf, np.array([0, len(buf)]))
            if len(h):
                out[k] = profile[:, h].mean(axis=1) * min(len(h), EFFECTIVE)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(profile), pa.int32()), pa.array(out.ravel()))

    return evidence(page)


def declared_language(page: str | Column, languages: tuple[str, ...]) -> Column:
    """The declared language, ``other`` for one that is not asked for, empty without a declaration."""
    page = F.col(page) if isinstance(page, str) else page
    code = F.lower(F.regexp_extract(F.coalesce(page, F.lit("")), r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z]+)""", 1))
    return F.when(code.isin(*languages) | (code == ""), code).otherwise("other")


def _normalised(logs: Column) -> Column:
    """Probabilities from an array of logarithms."""
    top = F.array_max(logs)
    p = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda s, y: s + y))


def _sums(n: int) -> list[Column]:
    return [F.sum(F.element_at("post", i + 1)).alias(f"s{i}") for i in range(n)]


def fused(pages: DataFrame, profile: np.ndarray, languages: tuple[str, ...] = LANGUAGES, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``(page_id, host, declared, text_lang, lang, confidence)`` for every row.

    ``lang`` is the language of the largest posterior, ``confidence`` that
    posterior; ties go to the language that comes first by name. A page
    without text has the evidence of its declaration and host alone; without
    an address its host is empty. Repeated rows count as often as they occur.
    An empty table gives no rows; other columns are ignored.
    """
    n = len(languages)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), host.alias("host"), declared_language(page, languages).alias("declared"), text_evidence(F.col(page), profile).alias("loglik"))
    rows = rows.withColumns({
        "domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1), "post": _normalised(F.col("loglik")),
    })
    rows = written(rows, "language-evidence")

    # P(declared | language): at most a row for each language, other and none
    said = rows.groupBy("declared").agg(*_sums(n))
    every = said.agg(*(F.sum(f"s{i}").alias(f"t{i}") for i in range(n))).first()
    total = [every[f"t{i}"] or 0.0 for i in range(n)]
    trust = said.select("declared", F.array(*(F.log((F.col(f"s{i}") + 1) / F.lit(total[i] + n + 2)) for i in range(n))).alias("said"))

    # priors, level by level; each level has fewer rows than the one below
    whole = sum(total)
    globally = F.array(*(F.lit((t + 1) / (whole + n)) for t in total))

    def smoothed(counts: Column, size: Column, parent: Column) -> Column:
        return F.zip_with(counts, parent, lambda c, p: (c + STRENGTH * p) / (size + STRENGTH))

    counts = F.array(*(F.col(f"s{i}") for i in range(n)))
    size = sum((F.col(f"s{i}") for i in range(1, n)), F.col("s0"))
    hosts = written(rows.groupBy("host", "domain", "suffix").agg(*_sums(n)), "language-hosts")
    adding = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    suffixes = hosts.groupBy("suffix").agg(*adding).select("suffix", smoothed(counts, size, globally).alias("above"))
    domains = hosts.groupBy("domain", "suffix").agg(*adding).join(suffixes, "suffix").select("domain", smoothed(counts, size, F.col("above")).alias("parent"))
    hosts = lookup_join(hosts, domains, "domain", "inner").select("host", counts.alias("counts"), size.alias("size"), "parent")

    at = lookup_join(rows, hosts, "host", "inner").join(trust, "declared")
    others = F.zip_with("counts", "post", lambda c, p: F.greatest(c - p, F.lit(0.0)))
    own = F.aggregate("post", F.lit(0.0), lambda s, p: s + p)
    prior = smoothed(others, F.greatest(F.col("size") - own, F.lit(0.0)), F.col("parent"))
    at = at.withColumn("prior", prior)
    logs = F.zip_with(F.zip_with("loglik", "said", lambda a, b: a + b), "prior", lambda a, p: a + F.log(p))
    at = at.withColumn("posterior", _normalised(logs))
    names = F.array(*(F.lit(x) for x in languages))

    def best(c: str) -> Column:
        return F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))

    return at.select("page_id", "host", "declared", best("post").alias("text_lang"), best("posterior").alias("lang"), F.array_max("posterior").alias("confidence"))
