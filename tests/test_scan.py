import random

import pytest

from buslens.operators import edges as E
from buslens.operators.scan import in_slots

K = ["s"]


def kept(times, gap):
    out, last = [], float("-inf")
    for t in times:
        if t - last >= gap:
            out.append(t)
            last = t
    return out


def matched(commands, responses, window, same_time):
    out, start = [], 0
    for tc, dc in commands:
        while start < len(responses) and (responses[start][0] < tc or (responses[start][0] == tc and not same_time)):
            start += 1
        hit = next((j for j in range(start, len(responses)) if responses[j][0] - tc <= window and responses[j][1] == dc), None)
        if hit is not None:
            out.append((tc, responses[hit][0], dc))
            start = hit + 1
    return out


@pytest.mark.parametrize("slot_rows", [3, 40, 100_000])
@pytest.mark.parametrize("gap", [0.1, 0.3, 7.0])
def test_thinning_of_one_dense_chain(spark, slot_rows, gap):
    rnd = random.Random(gap)
    series = {"steady": [i * 0.1 for i in range(600)], "random": sorted(rnd.uniform(0, 40) for _ in range(500)), "ties": sorted(rnd.choice(range(30)) / 1 for _ in range(200)),
              "far": [0.0, 0.1, 1e6, 1e6 + 0.1], "one": [5.0], "same": [2.0] * 50}
    cand = spark.createDataFrame([(k, t, i, gap) for k, ts in series.items() for i, t in enumerate(ts)], "s string, t double, pos long, gap double").repartition(3)
    got = sorted((r.s, r.t) for r in E.thin_by_gap(cand, K, slot_rows=slot_rows).collect())
    assert got == sorted((k, t) for k, ts in series.items() for t in kept(ts, gap))


@pytest.mark.parametrize("slot_rows", [5, 60, 100_000])
@pytest.mark.parametrize("window,same_time", [(0.05, True), (1.0, False), (1.0, True), (30.0, True)])
def test_matching_of_one_dense_chain(spark, slot_rows, window, same_time):
    rnd = random.Random(int(window * 10))
    data = {}
    for name, n, m in (("even", 200, 200), ("few", 200, 40), ("many", 40, 300), ("none", 20, 0), ("other", 0, 20)):
        data[name] = [sorted((rnd.randrange(400) / 10, rnd.choice((1, -1))) for _ in range(x)) for x in (n, m)]
    # A backlog that is handed on from slot to slot to the end of the series.
    data["backlog"] = [[(i * 0.1, 1) for i in range(300)], [(i * 0.1 + 0.05, 1 if i % 3 else -1) for i in range(300)]]
    data["apart"] = [[(0.0, 1), (1e6, 1)], [(0.5, 1), (1e6 + 0.5, 1)]]
    frames = [spark.createDataFrame([(k, t, i, d) for k, v in data.items() for i, (t, d) in enumerate(v[side])], "s string, t double, pos long, direction int").repartition(3) for side in (0, 1)]
    got = sorted((r.s, r.command_t, r.response_t, r.direction) for r in E.match_edges(*frames, K, window=window, same_time=same_time, slot_rows=slot_rows).collect())
    assert got == sorted((k, *m) for k, v in data.items() for m in matched(*v, max(0.01, window), same_time))


def test_slots_of_a_dense_chain_are_even(spark):
    rows = spark.range(100_000).selectExpr("'x' as s", "id * 0.001 as t", "id as pos")
    cut, slots = in_slots(rows, K, least=0.5, slot_rows=5_000)
    sizes = [r["count"] for r in cut.groupBy("slot").count().collect()]
    assert slots >= 20 and len(sizes) == slots and max(sizes) <= 5_001


def test_no_rows(spark):
    cand = spark.createDataFrame([], "s string, t double, pos long, gap double")
    assert E.thin_by_gap(cand, K).collect() == []
    sides = spark.createDataFrame([], "s string, t double, pos long, direction int")
    assert E.match_edges(sides, sides, K, window=1.0).collect() == []
