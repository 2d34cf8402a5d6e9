"""Operators on conversations against plain Python."""

import hashlib
import random
import zlib

import pytest

from loomline.llm import audit, prefixtrie
from loomline.llm.common import written

CONV = "conv_id long, turn long, role string, text string, depth long, c long, single boolean"


def rows_of(conversations):
    return [tuple(r)[:4] for r in conversations.select("conv_id", "turn", "role", "text").collect()]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 7, 8, True) for r in rows], CONV).repartition(parts)


def hard_rows():
    r = random.Random(5)
    rows = []
    for c in list(range(-7, 60)) + [10**12]:
        for t in range(r.choice([1, 2, 3, 5, 11])):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a.", "b", "", None, "c d?", "é漢𝄞!"])))
    rows += [(3, None, None, None), (3, None, "user", "x"), (4, 1, "user", "again"), (4, 1, "user", "again")]  # null and repeated turns
    rows += [(None, 0, "user", "nobody's")]
    rows += [(70 + i, t, "user", f"turn {t}.") for i in range(12) for t in range(300)]  # long equal conversations
    rows += [(90, t, "user", "long " * 20_000) for t in range(2)]  # very long texts
    return rows


def ordered(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items() if c is not None}


def brute_trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            n = nodes.setdefault(tuple(turns[:d]), {"members": [], "ends": [], "children": set()})
            n["members"].append(c)
            if d == len(turns):
                n["ends"].append(c)
            else:
                n["children"].add(tuple(turns[: d + 1]))
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        n = nodes[p]
        leaves[p] = sum(leaves[x] for x in n["children"]) or 1
        saved[p] = sum(saved[x] for x in n["children"]) + ((len(n["members"]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(n["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else -(10**15), len(n["members"]), len(n["children"]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest())
        for p, n in nodes.items())


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(abs(c) % 5 * (1 if c >= 0 else -1)), [])[:h] + own[h:]
    return out


def trie_rows(df):
    return sorted(tuple(-(10**15) if x is None else x for x in r) for r in df.collect())


@pytest.mark.parametrize("cells", [prefixtrie.CELLS, 64])
def test_trie_against_brute_force(spark, cells):
    rows = hard_rows()
    convs = written(frame(spark, rows), "test")
    assert trie_rows(prefixtrie.rebuilt_trie(convs, cells)) == brute_trie(rebuilt(ordered(rows)))


def test_plain_trie_and_ranges_that_split_conversations(spark):
    rows = [(c, t, "user", f"turn {t} {c == 2 and t > 350}") for c in range(3) for t in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie_rows(prefixtrie.prefix_trie(frame(spark, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_trie(ordered(rows))


def test_trie_of_nothing(spark):
    assert prefixtrie.rebuilt_trie(frame(spark, [])).count() == 0
    assert prefixtrie.rebuilt_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    lone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(lone, 0, "user", "a")]
    assert trie_rows(prefixtrie.rebuilt_trie(frame(spark, rows))) == brute_trie({lone: []})
    rows += [(c, 0, "user", "a") for c in range(201, 260, 5)]
    assert trie_rows(prefixtrie.rebuilt_trie(frame(spark, rows))) == brute_trie(rebuilt(ordered(rows)))


def test_estimates_are_never_too_low(spark):
    members, _ = prefixtrie.plain_members(prefixtrie.prefix_states(frame(spark, hard_rows())))
    members = written(members, "test")
    rows = prefixtrie.screened(members).collect()
    times = {}
    for r in rows:
        times[r["d1"]] = times.get(r["d1"], 0) + 1
    assert all(times[r["d1"]] == 1 for r in rows if r["single"])
    assert sum(r["single"] for r in rows) > 0.8 * sum(times[r["d1"]] == 1 for r in rows)


# ---- repair ----------------------------------------------------------------


def brute_damage(rows):
    out = {}
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        out.setdefault(c, [])
        if what == 0:
            continue
        role = "user" if what == 4 else role
        text = "" if what == 1 else "".join(x for x in text if x not in ".!?") if what == 2 else text
        out[c] += [(t is not None, t or 0, role, text)] * (2 if what == 3 else 1)
    return {c: sorted(v) for c, v in out.items()}


def faults_of(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def brute_repair(turns, faults):
    """Least (cost, edits) from the end of the rows backwards, then along them; states: nothing, s, u, a."""
    big = 10**9
    turn = {0: 2, 1: 2, 3: 2, 2: 3}
    keeps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def close(best, end):
        best = dict(best)
        for _ in range(3):
            for q in range(4):
                c, e, t = best[turn[q]]
                role = "user:" if turn[q] == 2 else "assistant:"
                if (c + 3, "I" + e) < best[q][:2]:
                    best[q] = (c + 3, "I" + e, [role, *t])
        return best

    best = close({q: (0 if q in (0, 3) else big, "", []) for q in range(4)}, True)
    for (role, text), fault in zip(reversed(turns), reversed(faults), strict=True):
        new = {}
        for q in range(4):
            options = [(best[q][0] + 4, "D" + best[q][1], best[q][2])]
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                if (q, role[:1]) in keeps:
                    c, e, t = best[keeps[q, role[:1]]]
                    options.append((c + more, "K" + e, [f"{role}:{text}", *t]))
                c, e, t = best[turn[q]]
                options.append((c + 3 + more, "R" + e, [f"{'user' if turn[q] == 2 else 'assistant'}:{text}", *t]))
            new[q] = min(options)
        best = close(new, False)
    c, e, t = best[0]
    return c, e, hashlib.sha256("\n".join(t).encode()).hexdigest()


def brute_audit(rows):
    out = []
    for c, v in brute_damage(rows).items():
        faults = faults_of(v)
        turns = {x[1] for x in v if x[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:], strict=False))
        repair = brute_repair([x[2:] for x in v], faults)
        out.append((c, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, *repair))
    return sorted(out, key=str)


def test_audit_against_brute_force(spark):
    r = random.Random(8)
    rows = hard_rows() + [(None, 1, None, None), (None, None, "system", "hello")]
    for c in range(1000, 1100):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t * r.choice([1, 1, 2]), r.choice(["user", "assistant", "system", "tool", ""]), r.choice(["a.", "b!", "c", " ", "d? \n", None, "e. "])))
    got = sorted((tuple(x) for x in audit.audited_damage(frame(spark, rows)).collect()), key=str)
    assert got == brute_audit(rows)


def test_audit_of_nothing(spark):
    assert audit.audited_damage(frame(spark, [])).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = audit.audited_damage(frame(spark, [(lost, 0, "user", "a")])).collect()
    assert [tuple(x) for x in row] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def repaired(turns, faults, strings=audit.Strings):
    work = audit.Repair(strings)
    for (role, text), fault in zip(turns, faults, strict=True):
        work.add(role, text, fault)
    return work.finish(), work.held


def long_turns(seed, n):
    r = random.Random(seed)
    turns = [(r.choice(["user", "assistant", "user", "assistant", "system", "tool"]), r.choice("abc")) for _ in range(n)]
    return turns, [r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]


def test_edit_strings_of_many_short_conversations():
    for seed in range(3000):
        turns, faults = long_turns(seed, seed % 9)
        assert repaired(turns, faults)[0] == brute_repair(turns, faults)


def test_hash_collisions_are_seen():
    class Colliding(audit.Strings):
        def __init__(self):
            super().__init__(lambda h, c: 0)

    for seed in range(300):
        turns, faults = long_turns(seed, 40)
        assert repaired(turns, faults, Colliding)[0] == brute_repair(turns, faults)


def test_long_conversations_wait_for_few_rows():
    turns, faults = long_turns(1, 20_000)
    result, held = repaired(turns, faults)
    assert held < 1000
    turns, faults = turns[:2000], faults[:2000]
    assert repaired(turns, faults)[0] == brute_repair(turns, faults)
