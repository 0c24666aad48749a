import numpy as np
import pytest

from buslens.operators.delay import lag_curve
from buslens.operators.tiles import SUMS, _range_sums, lag_sums, products


def plain(a, b, s):
    begin = max(0, -s)
    m = min(len(a), len(b) - s) - begin
    x, y = a[begin:begin + m], b[begin + s:begin + s + m]
    return m, x.sum(), y.sum(), x @ y, x @ x, y @ y


@pytest.mark.parametrize("sizes", [(1, 1), (7, 7), (64, 64), (64, 5), (5, 64), (3, 100), (100, 33)])
def test_products_equal_plain_sums(sizes):
    rng = np.random.default_rng(4)
    a, b = (rng.normal(size=n) for n in sizes)
    # A spike beside small values: the transform alone loses them.
    a[0], b[-1] = 1e9, -1e9
    shift = np.arange(1 - len(a), len(b))
    got = products(a, b, shift)
    for i, s in enumerate(shift):
        want = plain(a, b, int(s))
        scale = np.sqrt(want[4] * want[5])
        assert got["n"][i] == want[0]
        for c, w in zip(SUMS[1:], want[1:]):
            assert abs(got[c][i] - w) <= 1e-9 * max(scale if c == "sab" else abs(w) + np.sqrt(want[4] + want[5]), 1e-300), (s, c)


def test_sums_of_inner_ranges():
    x = np.arange(1.0, 24.0)
    for m in (1, 4, 22):
        begin = np.arange(0, 24 - m)
        assert _range_sums(x, begin, np.full(len(begin), m), m).tolist() == [x[i:i + m].sum() for i in begin]


@pytest.mark.parametrize("tile", [16, 50, 4096])
def test_reach_beyond_the_tile(spark, tile):
    rng = np.random.default_rng(9)
    series = {"p": (0, 230, 228), "q": (37, 101, 40), "r": (1000, 3, 1), "s": (5, 1, 1)}
    rows, want = [], {}
    for name, (first, n, reach) in series.items():
        a, b = rng.normal(size=n), rng.normal(size=n)
        rows += [(name, first + i, float(a[i]), float(b[i])) for i in range(n)]
        for k in range(-min(reach, n - 1), min(reach, n - 1) + 1):
            want[name, k] = plain(a, b, k)
    reaches = spark.createDataFrame([(k, v[2]) for k, v in series.items()], "s string, reach long")
    df = spark.createDataFrame(rows, "s string, i long, a double, b double").repartition(5)
    got = {(r.s, r.k): tuple(r[c] for c in SUMS) for r in lag_sums(df, ["s"], reaches, tile).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert np.allclose(got[key], values, rtol=1e-9, atol=1e-11), key
    curve = {(r.s, r.k): (r.n, r.correlation) for r in lag_curve(df, ["s"], reaches, tile).collect()}
    for (name, k), (n, sa, sb, sab, saa, sbb) in want.items():
        den = np.sqrt(max(0, (saa / n - (sa / n)**2) * (sbb / n - (sb / n)**2)))
        assert curve[name, k][0] == n and abs(curve[name, k][1] - (0 if n <= 1 or den <= 1e-12 else (sab / n - sa * sb / n / n) / den)) < 1e-6


def test_no_group_is_larger_than_two_tiles(spark, monkeypatch):
    from buslens.operators import tiles

    whole = tiles._pair_sums

    def watched(keys):
        run = whole(keys)

        def check(pdf):
            if len(pdf) > 2 or any(len(x) > 8 * 32 for x in pdf["data"]):
                raise AssertionError("a group is larger than two tiles")
            return run(pdf)
        return check

    monkeypatch.setattr(tiles, "_pair_sums", watched)
    df = spark.range(1000).selectExpr("'x' as s", "id as i", "sin(id) as a", "cos(id) as b")
    reach = spark.createDataFrame([("x", 900)], "s string, reach long")
    assert lag_sums(df, ["s"], reach, 32).count() == 1801
