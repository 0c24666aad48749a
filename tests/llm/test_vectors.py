import math
from collections import defaultdict

import numpy as np
import pytest

from buslens.llm.ann import build_graph, embedding_search, lifted, nearest
from buslens.llm.topk import integer_search, top_k

SHAPE = "vec_id long, embedding array<float>, label int, id long, rank string"


def table(spark, data):
    return spark.createDataFrame([(i, v, 0, 7, "clash") for i, v in data], SHAPE)


def odd_rows(rng):
    data = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 8]) for i in range(120)]
    data += [(200 + i, [0.25, 0.5, -0.25, 0.125]) for i in range(60)]  # one very common vector
    data += [(300, None), (320, [1.0, None, 1.0, 1.0]), (340, [math.nan, 1.0, 1.0, 1.0]), (360, [math.inf, 1.0, 1.0, 1.0]), (400, [0.0] * 4), (None, [1.0] * 4), (500, [1.0, 2.0]), (520, [0.5, 0.5]), (1, data[1][1])]
    return data


def good(data):
    return [(i, v) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute(data, every, k, turn):
    found = {}
    rows = [(i, turn(v)) for i, v in data]
    for q, v in {i: v for i, v in rows if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        found[q] = [(i, -s) for s, i in scored[:k]]
    return {q: x for q, x in found.items() if x}


def ranked(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_integer_top_k_is_brute_force(spark):
    data = odd_rows(np.random.default_rng(1))
    want = brute(good(data), 50, 5, lambda v: [math.floor(256 * x) for x in v])
    assert ranked(integer_search(table(spark, data))) == want


def test_integer_top_k_of_large_numbers_and_few_rows(spark):
    big = [(0, [float(2**40), 1.0]), (1, [float(2**20), -3.0]), (50, [-5.0, float(2**40)])]
    df = spark.createDataFrame(big, "id long, vector array<double>")
    want = brute([(i, [int(x) for x in v]) for i, v in big], 50, 5, lambda v: v)
    assert ranked(top_k(df, df.where("id % 50 = 0"), 5)) == want
    assert top_k(df.limit(0), df.limit(0), 5).collect() == []
    assert integer_search(table(spark, [])).collect() == []


def test_integer_top_k_up_to_the_ends_of_a_long(spark):
    """Scores between 2**61 and 2**63, of both signs, one apart and at both ends of the range."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(2**31), float(rng.integers(0, 3)), 1.0]) for i in range(1, 40)]
    rows += [(101 + i, [x * 2.0**30, float(i), 0.0]) for i, x in enumerate((-3.5, 2.5, 3.25, 3.0, -2.0, 1.0))]
    rows += [(0, [2.0**31, 1.0, 2.0**20]), (50, [-(2.0**31), 0.0, -1.0]), (200, [2.0**31, 0.0, 0.0])]
    rows += [(250, [-(2.0**31), 5.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    want = brute([(i, [int(x) for x in v]) for i, v in rows], 50, 5, lambda v: v)
    assert max(abs(s) for v in want.values() for _, s in v) > 2**61
    assert ranked(top_k(df, df.where("id % 50 = 0"), 5)) == want
    edge = spark.createDataFrame([(0, [-(2.0**62), 1.0]), (1, [2.0, 0.0]), (2, [-1.0, 7.0]), (3, [2.0, 1.0])], "id long, vector array<double>")
    got = ranked(top_k(edge, edge.where("id = 0"), 5))
    assert got[0] == [(2, 2**62 + 7), (3, 1 - 2**63), (1, -(2**63))]
    with pytest.raises(Exception, match="beyond the range of a long"):
        beyond = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "id long, vector array<double>")
        top_k(beyond, beyond.where("id = 0"), 5).collect()


def test_nearest_finds_all_of_small_shards(spark):
    data = odd_rows(np.random.default_rng(2))
    valid = [(i, v) for i, v in good(data) if any(v)]
    want = brute(valid, 20, 20, lambda v: [float(np.float32(x)) for x in v])
    got = ranked(embedding_search(table(spark, data), beam=200))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert embedding_search(table(spark, [])).collect() == []


def test_nearest_recall_over_shards(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype("float32").astype("float64")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = ranked(nearest(df, df.where("id % 20 = 0"), 20, shard=800))
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    hits = [len({i for i, _ in got[q]} & set(np.argsort(-scores[q])[:20])) for q in range(0, 3000, 20)]
    assert sum(hits) / (20 * len(hits)) >= 0.9


def test_nearest_beside_a_very_long_vector(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 32))
    x[7] *= 30_000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = ranked(nearest(df, df.where("id % 20 = 0"), 20))
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    hits = [len({i for i, _ in got[q]} & set(np.argsort(-scores[q])[:20])) for q in range(0, 1500, 20)]
    assert sum(hits) / (20 * len(hits)) >= 0.85


def test_every_node_is_in_reach():
    x = np.concatenate([np.random.default_rng(4).normal(size=(50, 3)) + 100 * k for k in range(4)])
    links, entry = build_graph(lifted(x), degree=4, beam=4)
    seen, front = {entry}, [entry]
    while front:
        front = [j for i in front for j in links[i] if j < len(x) and j not in seen and not seen.add(j)]
    assert len(seen) == len(x)
