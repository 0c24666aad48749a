import random
import zlib
from collections import Counter

import numpy as np
import pytest

from buslens.llm.packing import combinations, greedy, pack, plan, repeat_counts, stream_cuts
from buslens.llm.tokens import WordTokens, segments, tokenizer_path

SHAPE = "doc_id long, text string, length string, Sequence_ID int"
ODD = ["a b c", "x́ ́y e ́", "<|endoftext|> a<|startoftext|>b", "it's 'll don't  we'Ve", "　a b\x85c\x1cd\x1e e", "ΑΣ ΟΔΟΣ.", "A\x00B c\x7f", "日本語 テスト が", "İstanbul I ǰ J̌ ŉ ß ẞ",
       "a' s 12 34\t5", "👍🏽 x👍", "﻿ab c", "' s", "ª º.,., ,.a .", "é É. ÉÉ,, ǅ ǆ DŽ", " ", "", "ﬁ ½ æÆ.", "Ÿ ſ ſT K Å", "Hello, World... ok,."]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    return lambda text: model.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_the_whole_text(spark, whole):
    words = WordTokens(tokenizer_path())
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        assert np.frombuffer(b"".join(words.ids(text.encode())), "<u4").tolist() == whole(text)
    assert b"".join(segments(b"ab cd " * 400_000)) == b"ab cd " * 400_000


def test_plan_places_every_piece_once():
    rng = random.Random(1)
    for window in (64, 256):
        for _ in range(20):
            counts = np.zeros(window, dtype="int64")
            for _ in range(rng.randint(0, 80)):
                counts[rng.randint(1, window - 1)] += rng.choice([1, 1, 2, 50])
            found = plan(counts, 7, triples=200)
            seen, used = Counter(), Counter()
            for length in range(1, window):
                for i in range(counts[length]):
                    if i < found.rest[length]:
                        (_, low, _, first, offset), = [s for s in found.slots if s[0] == length and s[1] <= i < s[2]]
                        parts = [(0, length, first + i - low, offset)]
                    else:
                        begin = int(found.place[length] + (i - found.rest[length]) * length)
                        parts = [(s, n, q + found.stream, o) for s, n, q, o in stream_cuts(begin, length, found.total, window)]
                    assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts]).tolist()[:-1] and sum(p[1] for p in parts) == length
                    for _, n, q, o in parts:
                        used[q] += n
                        seen.update((q, x) for x in range(o, o + n))
            assert all(n == 1 for n in seen.values())
            assert all(set(range(used[q])) == {x for s, x in seen if s == q} for q in used)
            assert all(n == window or n & (n - 1) == 0 for n in used.values())
            assert not used or sorted(used) == list(range(7, 7 + len(used)))


def test_least_squares_meets_a_solvable_histogram():
    counts = np.zeros(64, dtype="int64")
    counts[[20, 44, 10, 30, 24]] = [100, 100, 30, 30, 30]
    combos = combinations(counts)
    uses = repeat_counts(counts, combos)
    back = np.zeros(64)
    for combo, n in zip(combos, uses):
        for x in combo:
            back[x] += n
    assert min(uses) >= 0 and np.abs(back - counts).max() < 1
    left = [0] * 64
    left[16], left[60] = 8, 3
    assert greedy(left) == [([16] * 4, 2)] and left[60] == 3 and left[16] == 0


def test_pack_is_exact(spark, whole):
    rng = random.Random(2)
    data = [(i, rng.choice([None, ""] + [" ".join(rng.choice(["Thing", "of,", "é", "xyzzy", "12"]) for _ in range(rng.randint(1, 900)))] * 9), "clash", 1) for i in range(60)]
    data += data[:2] + [(None, "no id", "", 0), (7, "twice the same id", "", 0), (800, "long words " * 9000, "", 0)]
    got = pack(spark.createDataFrame(data, SHAPE), window=256).collect()
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert all(n == 256 or n & (n - 1) == 0 for n in used.values())
    assert sorted(used) == list(range(len(used)))
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    ids = {}
    for d, t, _, _ in data:
        ids.setdefault(d, []).append([*whole(t), 1])
    assert sum(used.values()) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    pieces = Counter((r.doc_id, r.doc_tokens) for r in got for _ in range(r.length))
    assert pieces == Counter((d, len(x)) for d, v in ids.items() for x in v for _ in x)
    assert pack(spark.createDataFrame([], SHAPE)).collect() == []


def test_letters_are_merged_once_whatever_is_around_them(whole, monkeypatch):
    import pyarrow as pa

    from buslens.llm import tokens

    words = WordTokens(tokenizer_path())
    asked = []
    merged = words._merged
    monkeypatch.setattr(words, "_merged", lambda letters: asked.append(letters) or merged(letters))
    text = "abode Abode, ABODE... abode!! (abode abode$$$\nabode\t"
    texts = [text, None, *ODD, "a's. b'.. c<|endoftext|>. d!'s", "  lead", "\x0b x\x0c", "z" * 50, text * 3]
    for size in (tokens.RUN_BYTES, 40, 1):
        monkeypatch.setattr(tokens, "RUN_BYTES", size)
        got = [np.frombuffer(b"".join(parts), "<u4").tolist() for parts in words.texts(pa.chunked_array([texts, texts]).combine_chunks().slice(1))]
        assert got == [whole(t) for t in (texts * 2)[1:]]
    assert asked.count("abode") == 1 and list(words.texts(pa.array([], pa.string()))) == []
