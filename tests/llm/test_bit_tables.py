import numpy as np
import pyarrow as pa
import pytest

from buslens.llm.bit_tables import Tables, room, set_tables
from buslens.llm.line_dedup import NEVER, _first_lines, _first_pairs, _lines, _may_link, _postings


def sets_of(rng, sizes):
    return [np.unique(rng.integers(0, 2**63, n, dtype="uint64")) for n in sizes]


def laid_out(sets):
    return np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])


def test_room_bounds_what_is_common_and_tells_strangers_apart():
    rng = np.random.default_rng(1)
    sets = sets_of(rng, [1, 2, 31, 32, 33, 64, 65, 90, 130, 300, 5000])
    sets += [np.unique(np.concatenate([s[:len(s) * 9 // 10], *sets_of(rng, [len(s) // 7 + 1])])) for s in sets]
    column = set_tables(*laid_out(sets))
    assert [len(x) * 8 for x in column.to_pylist()] == [max(64, 1 << int(np.ceil(np.log2(2 * len(s))))) for s in sets]
    tables, sizes = Tables(column), np.array([len(s) for s in sets])
    x, y = (a.ravel() for a in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    most = room(tables, x, sizes[x], tables, y, sizes[y])
    common = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)])
    assert (most >= common).all() and (most[x == y] == sizes).all()
    strangers = (common == 0) & (sizes[x] >= 64) & (sizes[y] >= 64) & (np.maximum(sizes[x], sizes[y]) <= 1.25 * np.minimum(sizes[x], sizes[y]))  # others the sizes rule out
    assert strangers.any() and (most[strangers] < 0.8 * np.minimum(sizes[x], sizes[y])[strangers]).all()
    part = Tables(pa.concat_arrays([column, column]).slice(5, len(sets)))
    assert (room(part, x[:9], sizes[x[:9]], part, x[:9], sizes[x[:9]]) <= sizes[x[:9]]).all() and len(part.count) == len(sets)
    assert len(Tables(column.slice(0, 0)).small(np.zeros(0, bool))) == 0


def test_small_tables_take_half_of_the_words_of_larger_sets():
    rng = np.random.default_rng(2)
    sets = sets_of(rng, [3, 60, 85, 86, 200, 1000])
    larger = np.array([len(s) > 85 for s in sets])
    want = [np.bitwise_or.reduce([np.uint64(1) << (w & np.uint64(63)) for w in s if not big or w >> np.uint64(6) & np.uint64(1)]) for s, big in zip(sets, larger)]
    assert Tables(set_tables(*laid_out(sets))).small(larger).tolist() == [int(w) for w in want]


def test_pairs_of_lists_are_all_pairs_once(monkeypatch):
    rng = np.random.default_rng(3)
    for step in (7, 1 << 18):
        monkeypatch.setattr("buslens.llm.line_dedup.PAIR_STEP", step)
        lists, size = np.sort(rng.integers(0, 9, 120)), rng.integers(1, 30, 120).astype("int32")
        order = np.lexsort([size, lists])
        lists, size = lists[order], size[order]
        rest, bits = (size - rng.integers(0, 4, 120)).astype("int32"), rng.integers(0, 8, 120).astype("uint64")
        got = [p for i, j in _may_link(lists, size, rest, bits, 80) for p in zip(i.tolist(), j.tolist())]
        want = []
        for i in range(120):
            for j in range(i + 1, 120):
                only = [int(bits[a] & ~bits[b]).bit_count() for a, b in ((i, j), (j, i))]
                most = min(rest[i], rest[j], size[i] - only[0], size[j] - only[1])
                if lists[i] == lists[j] and 100 * min(size[i], size[j]) >= 80 * max(size[i], size[j]) and 180 * most >= 80 * (size[i] + size[j]):
                    want.append((i, j))
        assert sorted(got) == want and len(set(got)) == len(got)
    assert NEVER > 2**62


@pytest.mark.parametrize("step", [7, 1 << 18])
def test_lists_keep_the_rows_of_other_pairs_only(monkeypatch, step):
    monkeypatch.setattr("buslens.llm.line_dedup.PAIR_STEP", step)
    rng = np.random.default_rng(4)
    core = rng.integers(1 << 58, 2**63, 30, dtype="uint64")
    # Sets of 30 words, all near to each other, under key 1; two near ones under key 2; a set with none under key 3.
    sets = [np.unique(np.concatenate([core[1:], rng.integers(1 << 58, 2**63, 1, dtype="uint64")])) for _ in range(9)]
    keys, cids = [1] * 6 + [2] * 2 + [3], [5, 3, 8, 1, 9, 7, 2, 4, 6]
    prefix = pa.array([np.array([k, *range(100 * c, 100 * c + 6)], dtype="int32").tobytes() for k, c in zip(keys, cids)], pa.binary())
    rows = pa.RecordBatch.from_pydict({"cid": pa.array(cids), "size": pa.array([30] * 9), "prefix": prefix, "sketch": set_tables(*laid_out(sets))})
    chunks = pa.Table.from_batches(list(_postings(80, 1)([rows]))).combine_chunks().to_batches()
    found = pa.Table.from_batches(list(_first_pairs(80)(chunks))).to_pylist()
    assert sorted((r["cid"], r["earlier"]) for r in found if r["kind"] == 1) == [(3, 1), (4, 2), (5, 1), (7, 1), (8, 1), (9, 1)]
    # Before, the two rows of key 2 were kept, and 1, whose pairs are all of kind 1.
    assert sorted((r["key"], r["cid"]) for r in found if r["kind"] == 0) == [(1, c) for c in (3, 5, 7, 8, 9)]


def test_a_line_of_many_texts_is_a_row_a_batch():
    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array([9, None, 4, 4, 9]), "mark": pa.array([1, 2, 3, 3, 1]), "text": ["own line here\nthe same line", "the same line\n\nThe  same LINE", *["the same line"] * 2, "own line here\nthe same line"]})

    class Classes:
        value = bytes(1 << 12)

    rows = pa.Table.from_batches(list(_lines(Classes, 80, 12)([texts]))).to_pylist()
    place = [(r["doc_id"], r["mark"], r["line"]) for r in rows]
    assert sorted(p for p, r in zip(place, rows) if r["size"]) == [(4, 3, 0), (9, 1, 0)]
    assert {p for p, r in zip(place, rows) if not r["size"]} == {(9, 1, 1), (None, 2, 0), (None, 2, 2)}
    assert len({r["d1"] for r in rows if not r["size"]}) == 3 and all(r["prefix"] is None for r in rows if not r["size"])
    first, later = _first_lines(pa.RecordBatch.from_pydict({"doc_id": pa.array([None, 3, 3, 2]), "mark": [0, 5, 5, 9], "line": [0, 2, 2, 1], "d1": [1, 1, 1, 1], "d2": [1, 1, 1, 2], "size": [4] * 4}))
    assert (first.tolist(), later.tolist()) in [([False, True, False, True], [True, False, False, False])]
