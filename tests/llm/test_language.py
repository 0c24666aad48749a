import zlib

import numpy as np
import pytest

from buslens.llm.language import UNKNOWN, chain_marginals, features, fit, identify, word_labels, _words

SHAPE = "doc_id long, text string, lang string, score string, HELD_OUT int"
EN = "the house and the tree that is there with this thing of his from what they have seen "
FR = "le maison et les arbres qui sont avec cette chose de son père que nous avons été là "


def docs():
    data = []
    for i in range(60):
        data.append((i, " ".join((EN if i % 2 else FR).split()[i % 7:] * 3), "en" if i % 2 else "fr", "x", 0))
    return data + [(100, None, "en", "", 0), (101, "", "fr", "", 0), (102, "123 --- 456", "en", "", 0), (None, EN, None, "", 0), (103, EN, None, "", 0), (103, EN, None, "", 0), (104, EN * 3000, "en", "", 0)]


def test_forward_backward_is_brute_force():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 5, 130, 64, 65, 7])
    scores, moves = rng.normal(size=(sizes.sum(), 3)) * 4, rng.normal(size=(3, 3))
    for block in (1, 8, 64):
        got, at = chain_marginals(scores, moves, sizes, block), 0
        for n in sizes:
            e, step = np.exp(scores[at:at + n]), np.exp(moves)
            ahead, behind = np.zeros((n, 3)), np.ones((n, 3))
            ahead[0] = e[0]
            for t in range(1, n):
                ahead[t] = (ahead[t - 1] @ step) * e[t]
                ahead[t] /= ahead[t].sum()
            for t in range(n - 2, -1, -1):
                behind[t] = step @ (e[t + 1] * behind[t + 1])
                behind[t] /= behind[t].sum()
            both = ahead * behind
            assert np.allclose(got[at:at + n], both / both.sum(axis=1, keepdims=True))
            at += n


def test_features_of_a_word():
    import pyarrow as pa

    for _, _, data, hashes, first, ends, own in _words(pa.array(["Ab, a", "é 12"])):
        assert own.tolist() == [0, 0, 1]
        found, begin = features(data, first, ends, hashes)
        # "ab,": itself, 3 + 2 + 1 n-grams, 3 prefixes, 3 suffixes; "a": itself and one of each; "é" has two bytes
        assert np.diff(np.append(begin, len(found))).tolist() == [13, 4, 8]


def test_words_of_switched_text():
    import pyarrow as pa

    model = fit([EN * 5, FR * 5], ["en", "fr"])
    assert (np.diag(model.moves) > model.moves[[0, 1], [1, 0]]).all()  # learned: a language lasts
    (_, _, _, found), = word_labels(model, pa.array([EN + FR]))
    best = found.argmax(axis=1)
    assert (best[:17] == 0).mean() > 0.9 and (best[17:] == 1).mean() > 0.9


def test_identify(spark):
    data = docs()
    got = identify(spark.createDataFrame(data, SHAPE)).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        want = {100: UNKNOWN, 101: UNKNOWN, 102: UNKNOWN}.get(r.doc_id, "en" if r.doc_id is None or r.doc_id >= 103 or r.doc_id % 2 else "fr")
        assert r.lang_pred == want and 0 <= r.score <= 1
    assert identify(spark.createDataFrame([], SHAPE)).collect() == []
    assert [r.lang_pred for r in identify(spark.createDataFrame([(1, EN, None, "", 0)], SHAPE)).collect()] == [UNKNOWN]


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(table, keep=("lang",)).where("held_out").selectExpr("avg(int(lang = lang_pred)) AS share").first().share
    assert got == pytest.approx(1, abs=0.05)


def test_many_distinct_words_are_scored_in_steps(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from buslens.llm import language

    rng = np.random.default_rng(3)
    texts = pa.array([" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(2_000)) for _ in range(20)])
    model = fit([EN * 5, FR * 5], ["en", "fr"])

    def run():
        tracemalloc.start()
        found = [x.tobytes() for *_, x in word_labels(model, texts)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, peak

    found, peak = run()
    monkeypatch.setattr(language, "WORD_STEP", 1 << 30)
    whole, before = run()
    assert found == whole and peak < 60e6 < before
