import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from buslens.llm.line_dedup import dedup_lines
from buslens.llm.near_duplicates import keep_one
from buslens.llm.ngram_join import ngram_groups
from buslens.llm.words import grams, hash_words, steps

SHAPE = "doc_id long, text string, n_shingles string, Mark int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def near_copies(seed, n, vocabulary=60, length=40):
    """Texts with exact and near copies, a large group of near copies, short and empty ones."""
    rng = random.Random(seed)
    texts = []
    base = [f"common{i}" for i in range(length)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and texts:
            text = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(["x", "Y", f"w{rng.randint(0, vocabulary)}"])
            texts.append(" ".join(text))
        elif kind < 0.6:
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(length)] = f"edit{rng.randint(0, 10**6)}"
            texts.append(" ".join(text))
        else:
            texts.append(rng.choice([None, "", " \n", "one", "one two", "One two three"] + [" ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(rng.randint(1, length)))] * 12))
    return texts


def shingles(text, n):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups_of(sets, percent):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 4)])
def test_ngram_join_is_brute_force(spark, seed, block):
    texts = near_copies(seed, 130)
    rng = random.Random(seed)
    data = [(rng.choice([100 + i, 100 + i, None if i % 9 == 0 else 100 + i]), t, "clash", 1) for i, t in enumerate(texts)] + [(5000, "one two", "", 0)] * 2
    root = groups_of([shingles(t, 4) for _, t, _, _ in data], 85)
    want = Counter()
    for (d, t, _, _), r in zip(data, root):
        n = len(shingles(t, 4))
        ids = [x[0] for x, y in zip(data, root) if y == r and x[0] is not None]
        want[d, n, d if not n else min(ids, default=None)] += 1
    got = ngram_groups(spark.createDataFrame(data, SHAPE), 4, 85, bits=12, block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_keep_one_of_each_group(spark):
    data = [(i, t, "clash", 1) for i, t in enumerate(near_copies(5, 100))] + [(3000, "one two", "", 0)] * 3 + [(None, "just me and nobody else", "", 0)] * 2
    root = groups_of([shingles(t, 5) for _, t, _, _ in data], 80)
    got = keep_one(spark.createDataFrame(data, SHAPE), 5, 80).collect()
    want = Counter()
    for r in set(root):
        members = [x for x, y in zip(data, root) if y == r]
        want[min((x[0] is None, x[0] or 0) for x in members)] += 1
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == want


def test_ngram_join_of_nothing(spark):
    assert ngram_groups(spark.createDataFrame([], SHAPE)).collect() == []
    got = ngram_groups(spark.createDataFrame([(1, None, "", 0), (2, "", "", 0), (None, " ", "", 0)], SHAPE)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def lines_removed(data, percent=80):
    """By definition: every pair of lines."""
    order = sorted(((d is None, d or 0, k), set(words(line))) for d, t in dict.fromkeys(data) for k, line in enumerate((t or "").split("\n") if t is not None else []))
    gone, earlier = set(), []
    for place, s in order:
        if s:
            if any(100 * len(s & e) >= percent * len(s | e) for e in earlier):
                gone.add(place)
            earlier.append(s)
    return gone


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 4)])
def test_line_dedup_is_brute_force(spark, seed, block):
    rng = random.Random(seed)
    texts = [t for t in near_copies(seed + 10, 200, length=25) if t is not None]
    data = []
    for i in range(60):
        data.append((i, rng.choice([None, ""] + ["\n".join(rng.choice(texts + ["", " "]) for _ in range(rng.randint(1, 6)))] * 10)))
    data += [(None, "alone one two three\nalone one two three four")] + data[:2]
    gone = lines_removed(data)
    want = Counter()
    for d, t in data:
        parts = t.split("\n") if t is not None else []
        drop = {k for k in range(len(parts)) if (d is None, d or 0, k) in gone}
        want[d, "\n".join(p for k, p in enumerate(parts) if k not in drop) if t is not None else None, len(parts), len(drop)] += 1
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in data], SHAPE)
    got = dedup_lines(df, bits=12, block=block).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == want


def test_line_dedup_of_very_many_lines(spark):
    many = "\n".join(f"line number {i} of many" for i in range(70_000))
    rows = [(1, many, "", 0), (2, "line number 69999 of many\nmy own words here now", "", 0)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, SHAPE)).collect()}
    assert (got[1].n_lines, got[1].n_removed, got[1].text) == (70_000, 0, many)
    assert (got[2].text, got[2].n_removed) == ("my own words here now", 1)


def test_packed_postings_of_line_dedup_grow_with_the_input(spark, monkeypatch):
    import buslens.llm.line_dedup as line_dedup

    def packed_rows(n, slots):
        """Of n lines on so many shuffle partitions, with 100 lines a batch."""
        count, real = spark.sparkContext.accumulator(0), line_dedup._postings

        def counted(*args):
            build = real(*args)

            def run(batches):
                for batch in build(batches):
                    count.add(batch.num_rows)
                    yield batch
            return run

        rng = random.Random(n)
        lines = [" ".join(f"w{rng.randrange(n // 2)}" for _ in range(10)) for _ in range(n)]
        rows = [(i, "\n".join(lines[i:i + 20]), "", 0) for i in range(0, n, 20)]
        with monkeypatch.context() as patch:
            patch.setattr(line_dedup, "_postings", counted)
            spark.conf.set("spark.sql.shuffle.partitions", slots)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
            try:
                assert len(dedup_lines(spark.createDataFrame(rows, SHAPE).repartition(4)).collect()) == len(rows)
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", 4)
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        return count.value

    small, large = packed_rows(3_000, 4), packed_rows(15_000, 20)
    assert 0 < large < 7.5 * small


def test_line_dedup_of_nothing(spark):
    assert dedup_lines(spark.createDataFrame([], SHAPE)).collect() == []
    assert [tuple(r) for r in dedup_lines(spark.createDataFrame([(1, None, "", 0)], SHAPE)).collect()] == [(1, None, 0, 0)]


def test_a_word_hashes_alike_beside_a_long_one():
    for other in ("y" * 300, " " * 300 + "z", "y" * 70_000):
        alone, beside = (next(steps(pa.array([t])))[2:] for t in ("same words", f"same words {other}"))
        assert hash_words(*alone)[0].tolist() == hash_words(*beside)[0][:2].tolist()


def test_two_python_steps_are_not_in_one_task(spark, monkeypatch):
    import buslens.llm.ngram_join as join

    plans = []

    def staged(df, name, real=join.staged):
        if name == "segments":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return real(df, name)

    monkeypatch.setattr(join, "staged", staged)
    assert len(ngram_groups(spark.createDataFrame([(1, "a b c d e f g h", "", 0), (2, "a b c d e f g h i", "", 0), (3, "other", "", 0)], SHAPE)).collect()) == 3
    assert plans and all("Broadcast" not in p for p in plans)


def test_words_and_grams():
    rng = random.Random(7)
    texts = ["".join(rng.choice("abAB é\t\n\x0b ") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "x" * 700 + "y", "y" + "x" * 700, "x" * 256 + "y" + "x" * 255 + "z", "x" * 256 + "z" + "x" * 255 + "y"]
    names: dict[int, tuple] = {}
    for n in (1, 4):
        for i, j, data, cuts in steps(pa.array(texts)):
            hashes, _, at = hash_words(data, cuts)
            for k in range(i, j):
                own = words(texts[k])
                found = grams(hashes, at[k - i], at[k - i + 1], n)
                want = [tuple(own[x:x + n]) for x in range(len(own) - n + 1)] if len(own) >= n else ([tuple(own)] if own else [])
                assert len(found) == len(want)
                for h, g in zip(found.tolist(), want):
                    assert names.setdefault((n, h), g) == g
        assert len({g for (m, _), g in names.items() if m == n}) == len([1 for m, _ in names if m == n])
    assert np.uint64(0) not in names
