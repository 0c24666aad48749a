import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from buslens.llm.mixing import fair_mix, mixed_documents

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size string, Target int"


def rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice([None, "", " \t\n"] + [" ".join(rng.choice(["a", "é b", "x\ny"]) for _ in range(rng.randint(1, 30)))] * 8)
        out.append((rng.choice([i, i, i, None]), text, None, rng.choice(["b", "a", "z", None, "é"] + ["hot"] * 4), 1, "clash", 5))
    return out + out[:3]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def goals(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, out, free = Fraction(3, 2) * sum(sizes.values()), {}, set(names)
    while free:
        level = budget / sum(weight[s] for s in free)
        stopped = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not stopped:
            return out | {s: level * weight[s] for s in free}
        for s in stopped:
            out[s] = Fraction(2 * sizes[s])
            budget -= out[s]
        free -= stopped
    return out


def brute(data, quantum):
    """All copies in parts, in one list by virtual finish time, cut at the budget."""
    docs = [(r[0], r[3], len(words(r[1]))) for r in data]
    sizes = defaultdict(int)
    for _, s, n in docs:
        sizes[s] += n
    want, parts = goals(sizes), []
    for s in sizes:
        for k in range(2):
            before = k * sizes[s]
            for i, (d, _, n) in sorted(((i, d) for i, d in enumerate(docs) if d[1] == s), key=lambda x: (hashlib.md5(f"mix-1:{'null' if x[1][0] is None else x[1][0]}".encode()).hexdigest(), x[1][2])):
                for at in range(0, n, quantum):
                    size = min(quantum, n - at)
                    parts.append((float(before + at + size) / float(want[s]), s is not None, s or "", len(parts), i, size))
                before += n
    left, taken = int(Fraction(3, 2) * sum(sizes.values())), Counter()
    for _, _, _, _, i, size in sorted(parts):
        taken[i] += min(size, left)
        left -= min(size, left)
    assert left == 0
    return Counter((d, n, sizes[s], round(float(want[s]), 6), taken[i]) for i, (d, s, n) in enumerate(docs)), want


@pytest.mark.parametrize("quantum", [1, 7, 256])
def test_mix_is_brute_force(spark, quantum):
    data = rows(3, 80)
    got = fair_mix(spark.createDataFrame(data, SHAPE), quantum=quantum).collect()
    found, want = brute(data, quantum)
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == found
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.part for r in got)
    by_source = Counter()
    for r in got:
        by_source[r.source] += r.taken
    assert all(abs(by_source[s] - float(want[s])) <= len(want) * min(quantum, 30) + 1 for s in want)


def test_one_very_long_text_does_not_upset_the_targets(spark):
    data = [(0, "w " * 40_000, None, "a", 1, "", 0)] + [(i, "w x y", None, "ab"[i % 2], 1, "", 0) for i in range(1, 9001)]
    got = fair_mix(spark.createDataFrame(data, SHAPE)).groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 512 for r in got)


def test_mixed_documents_hold_what_was_taken(spark):
    data = rows(4, 60)
    docs = spark.createDataFrame(data, SHAPE)
    plan, got = fair_mix(docs).collect(), mixed_documents(docs).collect()
    want = Counter()
    for r in plan:
        want[r.source] += r.taken
    assert Counter({s: n for s, n in want.items() if n}) == +sum((Counter({r.source: len(words(r.text))}) for r in got), Counter())
    assert got and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_empty_and_wordless(spark):
    assert fair_mix(spark.createDataFrame([], SHAPE)).collect() == []
    assert mixed_documents(spark.createDataFrame([], SHAPE)).collect() == []
    got = fair_mix(spark.createDataFrame([(1, None, None, None, 0, "", 0), (2, " ", None, "a", 0, "", 0)], SHAPE)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
