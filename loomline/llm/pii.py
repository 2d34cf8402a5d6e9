"""Personal data by weak supervision.

Candidate spans are what loose patterns find. Labelers vote on each: a strict
pattern, a gazetteer, the words before it, its borders and its shape.
Expectation-maximisation over the vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data; a logistic classifier
of spans is trained on these probabilities and decides. What the strict
patterns accept is always kept.

Votes and features take few values, so the corpus is reduced to counts of
vote patterns by one aggregation; no span leaves the executors.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import give_back, lean_memory, written

lean_memory()

KINDS = ("email", "ip", "card", "phone")
#: Words that name a kind, and domain ends, card and country prefixes in use.
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
}
DOMAINS = {"com", "net", "org", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "us"}
CARDS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")
COUNTRIES = ("1", "7", "33", "34", "39", "44", "49", "52", "55", "61", "81", "86", "91")

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")
#: Forms that the strict patterns leave out: national phone numbers, and addresses written out.
_LOOSE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_LOOSE_EMAIL = re.compile(r"(?: at |\[at\]|\(at\))([A-Za-z0-9-]{1,63}(?: dot |\[dot\]|\(dot\)|\.)[A-Za-z]{2,10})(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: a match begins where the run of local characters before its @ does."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at + 1) if start == at else last
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _IP.finditer(text):
        yield m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))


def _cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            yield m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _PHONE.finditer(text):
        yield m.start(), m.end(), 9 <= len(_DIGITS.findall(m.group())) <= 15


def strict_and_loose(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans ``(kind, start, end)`` of the strict patterns, and further candidates that overlap none of them."""
    strict, loose = [], []
    for kind, found in enumerate(([(*x, True) for x in _emails(text)], _ips(text), _cards(text), _phones(text))):
        for start, end, ok in found:
            (strict if ok else loose).append((kind, start, end))
    loose += [(3, m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)]
    for m in _LOOSE_EMAIL.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            loose.append((0, start, m.end()))
    if loose:
        taken = sorted((s, e) for _, s, e in strict)
        starts, free = [s for s, _ in taken], []
        for kind, s, e in sorted(loose, key=lambda x: (x[1], -x[2], x[0])):
            i = bisect_left(starts, e) - 1
            if (i < 0 or taken[i][1] <= s) and (not free or free[-1][2] <= s):
                free.append((kind, s, e))
        loose = free
    return strict, loose


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """What each labeler says: 2 for, 1 against, 0 nothing."""
    span = text[start:end]
    digits = "".join(_DIGITS.findall(span)) if kind else ""
    before = text[max(0, start - 40) : start].lower()
    if kind == 0:
        listed = 2 if re.split(r"[^A-Za-z0-9-]+", span)[-1].lower() in DOMAINS else 1
        shape = 2 if 6 <= end - start <= 60 else 1
    elif kind == 1:
        parts = [p.lstrip("0") or "0" for p in span.split(".")]
        listed = 1 if any(len(p) > 3 or int(p) > 255 for p in parts) or parts[0] in ("0", "127") else 2
        shape = 2 if all(len(p) <= 3 for p in span.split(".")) else 1
    elif kind == 2:
        listed = 2 if digits.startswith(CARDS) else 1
        shape = 2 if len(digits) in (15, 16) else 1
    else:
        listed = 0 if span[0] != "+" else 2 if digits.startswith(COUNTRIES) else 1
        shape = 2 if 9 <= len(digits) <= 13 else 1
    cue = 2 if any(w.strip(".,:;()") in CUES[KINDS[kind]] for w in before.split()[-4:]) else 0
    glued = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "=\"'_/")) or (end < len(text) and (text[end].isalnum() or text[end] in "\"'_/"))
    return (2 if strict else 1), listed, cue, (1 if glued else 2), shape


LABELERS = 5


def _pattern(kind: int, v: tuple[int, ...]) -> int:
    code = kind
    for x in v:
        code = code * 3 + x
    return code


_SPAN = "array<struct<kind:int,start:int,stop:int,strict:boolean,pattern:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("strict", pa.bool_()), ("pattern", pa.int32())]))


def candidates(text: str | Column) -> Column:
    """All candidate spans of a text with their vote patterns; code points, end exclusive."""

    @F.arrow_udf(_SPAN)
    def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for value in column:
                t = value.as_py() or ""
                strict, loose = strict_and_loose(t)
                out.append([
                    {"kind": k, "start": s, "stop": e, "strict": ok, "pattern": _pattern(k, votes(t, k, s, e, ok))}
                    for spans, ok in ((strict, True), (loose, False)) for k, s, e in spans
                ])
            yield pa.array(out, _SPAN_TYPE)
        column = out = None
        give_back()

    return find(text)


def estimate(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """For each vote pattern the probability that it is personal data, by EM over a model of independent labelers.

    It starts from the strict pattern being right nine times in ten.
    """
    code = np.array(sorted(counts))
    n = np.array([counts[c] for c in code], float)
    kind = code // 3**LABELERS
    v = np.stack([code // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)], axis=1)
    post = np.where(v[:, 0] == 2, 0.9, 0.1)
    for _ in range(rounds):
        logit = np.zeros(len(code))
        for k in np.unique(kind):
            own = kind == k
            p1 = ((post * n)[own].sum() + 1) / (n[own].sum() + 2)
            logit[own] += np.log(p1 / (1 - p1))
        for j in range(LABELERS):
            for value in (0, 1, 2):
                has = v[:, j] == value
                a = ((post * n)[has].sum() + 0.5) / ((post * n).sum() + 1.5)
                b = (((1 - post) * n)[has].sum() + 0.5) / (((1 - post) * n).sum() + 1.5)
                logit[has] += np.log(a / b)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return dict(zip(code.tolist(), post.tolist(), strict=True))


def _features(code: np.ndarray) -> np.ndarray:
    kind = code // 3**LABELERS
    cols = [np.ones(len(code)), *(kind == k for k in range(len(KINDS)))]
    for j in range(LABELERS):
        value = code // 3 ** (LABELERS - 1 - j) % 3
        cols += [value == 1, value == 2]
    return np.stack(cols, axis=1).astype(float)


def train(counts: dict[int, int], soft: dict[int, float], steps: int = 50, penalty: float = 1.0) -> dict[int, float]:
    """A ridge-penalised logistic classifier of spans, fitted to the soft labels by Newton steps; its probability for each pattern."""
    code = np.array(sorted(counts))
    x, y, n = _features(code), np.array([soft[c] for c in code]), np.array([counts[c] for c in code], float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + penalty * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(code.tolist(), (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def accepted_patterns(found: DataFrame, threshold: float) -> list[int]:
    """Vote patterns whose spans the classifier accepts, from the ``spans`` of the whole corpus."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.pattern").count().collect()  # at most 4 * 3^5 rows
    counts = {r["pattern"]: r["count"] for r in rows}
    if not counts:
        return []
    return sorted(c for c, p in train(counts, estimate(counts)).items() if p >= threshold)


def chosen(patterns: list[int]) -> Column:
    """Of ``spans``, the strict ones and those with an accepted pattern, by kind and start."""
    ok = F.array(*(F.lit(p) for p in patterns)) if patterns else F.array().cast("array<int>")
    kept = F.filter("spans", lambda s: s["strict"] | F.array_contains(ok, s["pattern"]))
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["strict"].alias("strict"))))


def _written_out(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def personal_data(docs: DataFrame, threshold: float = 0.9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row.

    The counts and the hash are of the strict patterns; ``spans`` holds these
    and the candidates that the trained classifier gives ``threshold`` or more.
    A null text is empty. Repeated rows each count. An empty table gives no
    rows; other columns are ignored.
    """
    found = written(docs.select(F.col(key).cast("long").alias("doc_id"), candidates(F.col(text)).alias("spans")), "pii-spans")
    every = chosen(accepted_patterns(found, threshold))
    base = F.filter("every", lambda s: s["strict"])
    out = found.select("doc_id", every.alias("every")).withColumn("base", base)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    return out.select("doc_id", *counts, F.sha2(_written_out(F.col("base")), 256).alias("base_sha256"), _written_out(F.col("every")).alias("spans"))


def masked(text: str | Column, accepted: list[int]) -> Column:
    """The text with each strict span, and each candidate of an accepted pattern, replaced by its kind in angle
    brackets; overlapping spans give one mark."""
    fine = frozenset(accepted)

    @F.arrow_udf("string")
    def replace(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for value in column:
                t = value.as_py()
                strict, loose = strict_and_loose(t or "")
                marks = strict + [x for x in loose if _pattern(x[0], votes(t, *x, False)) in fine]
                if marks:
                    parts, last = [], 0
                    for kind, start, stop in sorted(marks, key=lambda x: (x[1], -x[2])):
                        if start >= last:
                            parts += [t[last:start], f"<{KINDS[kind].upper()}>"]
                        last = max(last, stop)
                    t = "".join([*parts, t[last:]])
                out.append(t)
            yield pa.array(out, pa.string())
        column = out = None
        give_back()

    return replace(text)
