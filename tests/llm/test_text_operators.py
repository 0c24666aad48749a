"""Prefix encoding, the conversation trie and spelling variants against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from buslens.llm import prefix_trie as trie
from buslens.llm.prefix_bpe import PrefixBpe, TextCodec, encode_decode
from buslens.llm.prefix_trie import id_digests, prefix_trie, subtree_totals
from buslens.llm.spelling import near_pairs, roots, spelling_variants
from buslens.llm.tokens import tokenizer_path

DOCS = "doc_id long, text string, Text string, word int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    model.no_truncation()
    model.no_padding()

    def run(text):
        ids = model.encode(text or "", add_special_tokens=False).ids
        return ids, model.decode(ids, skip_special_tokens=False)
    return run


def expected_codes(library, doc_id, text):
    ids, decoded = library(text)
    return doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_encoding_and_decoding_equal_the_library(spark, library):
    rng = random.Random(3)
    letters = ["ab", "etaoins", "abcdefghijklmnopqrstuvwxyzABC", "!?.,-'", "üéßæŞİ日本한", "0123", "́〜 \x85　"]
    texts = [None, "", " ", "a", "it's 'll don't", "<|endoftext|> a<|startoftext|>b <|endoftext|><", "ΑΣ ΟΔΟΣ.", "é É. ÉÉ,, ǅ", "a\x00b", "aaaaaaa aaaaa aaaaaaaaaaaaa", "👍🏽 x👍", "hello,. .,", ",.", "ªº.,", "ÀB.,",
             "ababcab" * 3000, "word " * 3000, "word " * 3000]
    texts += ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [(None if i == 4 else i, t, "other", 0) for i, t in enumerate(texts)]
    got = encode_decode(spark.createDataFrame(rows + [rows[5]], DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected_codes(library, r[0], r[1]) for r in rows + [rows[5]]), key=str)
    assert encode_decode(spark.createDataFrame([], DOCS)).collect() == []


def test_a_text_longer_than_a_part(library):
    codec = TextCodec(tokenizer_path())
    text = "Some more words, as usual. " * 100_000
    parts = list(codec.parts(text.encode()))
    assert len(parts) > 1
    ids, decoded = library(text)
    assert b"".join(p[0] for p in parts) == b"".join(i.to_bytes(4, "little") for i in ids) and b" ".join(p[1] for p in parts).decode() == decoded


def merged(symbols, rank):
    """Merging by rank, leftmost first."""
    parts = list(symbols)
    while True:
        found = min(((rank[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in rank), default=None)
        if found is None:
            return parts
        i = found[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("suffix", ["", "$$"])
def test_prefixes_give_the_merges_of_any_vocabulary(suffix):
    rng = random.Random(7)
    for trial in range(40):
        letters = "abc"[:rng.randint(1, 3)]
        tokens, merges = list(letters) + ([c + suffix for c in letters] if suffix else []), []
        for _ in range(rng.randint(0, 25)):
            a, b = rng.choice([t for t in tokens if not suffix or not t.endswith(suffix)]), rng.choice(tokens)
            if a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        order = tokens[:]
        rng.shuffle(order)  # ids need not follow ranks
        ids = {t: i for i, t in enumerate(order)}
        model, rank = PrefixBpe(ids, merges, suffix), {m: i for i, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 25)))
            assert model.encode(word) == [ids[t] for t in merged([*word[:-1], word[-1] + suffix], rank)], (trial, word, merges)


def test_vocabularies_that_are_refused():
    with pytest.raises(ValueError):
        PrefixBpe({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])
    with pytest.raises(ValueError):
        PrefixBpe({"a": 0}, []).encode("ab")


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0))] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
                  for p, m in members.items())


def trie_rows(df):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, df.collect()))


def test_trie_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for c in [*range(-12, 40), 10**12, 2**62]:
        shared = rng.random() < 0.5
        for turn in range(rng.choice([0, 1, 2, 5, 9, 12])):
            text = f"t{turn}" if shared else rng.choice(["x", "y", "ü日", "", None])
            rows.append((c, turn if turn else None, rng.choice(["user", None]) if not shared else "user", text, 1, "n"))
    rows += [(3, 77, "user", "same", 1, "n")] * 3 + [(None, 1, "user", "nobody", 1, "n")]
    shape = "conv_id long, turn long, role string, text string, depth int, Conv_ID string"
    df = spark.createDataFrame(rows, shape).repartition(3)
    assert trie_rows(prefix_trie(df)) == brute_trie([r[:4] for r in rows])
    assert prefix_trie(spark.createDataFrame([], shape)).collect() == []


def test_one_conversation_and_one_turnless(spark):
    shape = "conv_id long, turn long, role string, text string"
    c = next(i for i in range(1, 1000) if i % 5 and zlib.crc32(str(i).encode()) % 9)
    for rows in ([(c, 0, "user", "gone")], [(c, i, "user", f"{i}") for i in range(300)]):
        assert trie_rows(prefix_trie(spark.createDataFrame(rows, shape))) == brute_trie(rows)


def test_subtree_totals_of_any_forest(spark):
    rng = random.Random(5)
    for n, reach in ((1, 1), (300, 3), (200, 1), (150, 150)):
        parent = {i: None if i == 0 or rng.random() < 0.01 else max(0, i - rng.randint(1, reach)) for i in range(n)}
        weight = {i: rng.randint(-5, 50) for i in range(n)}
        total = dict(weight)
        for i in range(n - 1, -1, -1):
            if parent[i] is not None:
                total[parent[i]] += total[i]
        nodes = spark.createDataFrame([(i, parent[i], weight[i]) for i in range(n)], "id long, parent long, w long")
        assert {r.id: r.w for r in subtree_totals(nodes, ["w"]).collect()} == total, (n, reach)


def test_lists_of_ids_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 64)
    rows = [(1, c) for c in range(500)] + [(k, c) for k in range(2, 40) for c in range(-1, k % 4)] + [(50, 7)]
    expected = defaultdict(list)
    for k, c in rows:
        expected[k].append(c)
    got = id_digests(spark.createDataFrame(rows, "k long, conv_id long").repartition(4), ["k"]).collect()
    assert {r.k: r.ends_sha256 for r in got} == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in expected.items()} and len(got) == len(expected)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(docs):
    import re

    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: next(iter(sorted(near[w], key=lambda v: (-words[v], v))), None) for w in words}
    form = {w: f if f is not None and words[f] >= 2 * words[w] else None for w, f in form.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w] or "", root, n, len(near[w]), words[form[w]] if form[w] else -1))
    return sorted(out)


def test_variants_equal_brute_force(spark):
    rng = random.Random(13)
    stems = ["".join(rng.choice("abÉé") for _ in range(rng.randint(4, 8))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa"]
    docs = [(None, "Lösung, losung; LÖSUNG × straße " * 3), (1, None), (2, ""), (3, "12 . ab"), (4, "aaaaaa " * 5), (4, "aaaaaa " * 5)]
    for i in range(5, 60):
        docs.append((i, " ".join(rng.choice(stems[:1 + rng.randint(0, len(stems) - 1)]) for _ in range(80))))
    docs.append((70, "kkkkk " * 3 + "kkkkkk " * 8 + "kkkkkkk " * 30))
    rows = [(d, t, "x", 1) for d, t in docs]
    got = spelling_variants(spark.createDataFrame(rows, DOCS)).collect()
    expected = brute_variants(docs)
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got) == expected
    assert any(r[1] and r[1] != r[2] for r in expected)  # a chain of forms
    assert spelling_variants(spark.createDataFrame([], DOCS)).collect() == []


def test_every_pair_one_edit_apart_comes_once(spark):
    rng = random.Random(17)
    words = {"".join(rng.choice("abß") for _ in range(rng.randint(1, 7))) for _ in range(400)}
    got = [(r.short, r.long) for r in near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
    assert len(got) == len(set(map(frozenset, got))) and {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("other", "w5")], "word string, form string")
    assert {r.root for r in roots(forms).collect()} == {"w37"}
