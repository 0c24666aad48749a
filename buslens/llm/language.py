"""Language of words in code-switched text by a linear-chain conditional random field, and of documents from it."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from buslens.llm.common import pick, staged
from buslens.llm.words import SPACE, hash_words, mix, steps

#: The classifier is fitted on so many labelled documents of each language at most, and so many characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 4_000
#: Bytes of text that a worker labels before it hands rows on.
SLICE_BYTES = 4 << 20
#: Feature weights are kept in 2**BITS rows.
BITS = 18
#: Lengths in bytes of the n-grams, of the prefixes and of the suffixes that are features.
NGRAMS, PREFIXES, SUFFIXES = (1, 2, 3, 4), (1, 2, 3), (1, 2, 3, 4)
#: Training: words of a sequence, sequences made of each language, of a batch, rounds, step size, weight decay.
LENGTH, SEQUENCES, BATCH, ROUNDS, RATE, DECAY = 32, 1_200, 128, 4, 0.3, 1e-5
#: Words of a block of the chain; blocks are worked on side by side.
BLOCK = 64
UNKNOWN = "und"
#: Text bytes whose distinct words are looked at together.
STEP = 1 << 21
#: Distinct words whose features and weights are held at a time.
WORD_STEP = 8_192

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text is 2 mod 4. A NULL id is not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of lower-cased texts: (from, to, bytes, hash, first byte, end byte, text number) of the words that hold a letter."""
    for i, j, data, cuts in steps(pc.utf8_lower(column), STEP):
        hashes, first, at = hash_words(data, cuts)
        own = np.repeat(np.arange(j - i), np.diff(at))
        if not len(first):
            yield i, j, data, hashes, first, first, own
            continue
        inside = ~SPACE[data]
        ends = first + np.add.reduceat(inside.astype("int64"), first)
        letters = np.add.reduceat((_LETTER[data] & inside).astype("int64"), first) > 0
        yield i, j, data, hashes[letters], first[letters], ends[letters], own[letters]


def features(data: np.ndarray, first: np.ndarray, ends: np.ndarray, hashes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, word after word, and where each word's begin: the word itself as lexicon entry, its prefixes and
    suffixes, and its n-grams, all of bytes."""
    size = ends - first
    count = len(first)
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begin, size)
    byte = data[np.repeat(first, size) + place].astype("uint64")
    left = np.repeat(size, size) - place
    own = np.repeat(np.arange(count), size)
    shift = np.uint64(64 - bits)
    found, owner = [mix(hashes) >> shift], [np.arange(count)]
    gram = np.zeros(len(byte), dtype="uint64")
    for n in range(1, max(*NGRAMS, *PREFIXES, *SUFFIXES) + 1):
        later = np.zeros(len(byte), dtype="uint64")
        later[:len(byte) - n + 1] = byte[n - 1:]
        gram = gram * np.uint64(257) + later + np.uint64(1)
        for kind, lengths, ok in ((1, NGRAMS, left >= n), (2, PREFIXES, (left >= n) & (place == 0)), (3, SUFFIXES, left == n)):
            if n in lengths:
                found.append(mix(gram[ok] * np.uint64(64) + np.uint64(8 * kind + n)) >> shift)
                owner.append(own[ok])
    found, owner = np.concatenate(found).astype("int64"), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(count))


def chain_marginals(scores: np.ndarray, moves: np.ndarray, sizes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Forward-backward: the probability of each label for each word. scores: (words, labels) of chains one after the other; moves:
    label to label; sizes: words of each chain, none of 0.

    A chain is cut into blocks. Products of the blocks' transition matrices carry messages from block to block, then all blocks
    are gone through side by side. That is exact, and the number of steps does not follow the longest chain.
    """
    k = scores.shape[1]
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max())
    per_chain = -(-sizes // block)
    n = int(per_chain.sum())
    chain = np.repeat(np.arange(len(sizes)), per_chain)
    number = np.arange(n) - np.repeat(np.cumsum(per_chain) - per_chain, per_chain)
    begin = (np.cumsum(sizes) - sizes)[chain] + number * block
    length = np.minimum(block, sizes[chain] - number * block)
    steps_ = np.arange(int(length.max(initial=0)))
    at = begin[:, None] + np.minimum(steps_[None, :], length[:, None] - 1)
    ok = steps_[None, :] < length[:, None]
    head = number == 0

    product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for s in steps_:
        moved = product if s == 0 else product @ step
        if s == 0:
            moved = np.where(head[:, None, None], np.eye(k), step)
        moved = moved * local[at[:, s]][:, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        product = np.where(ok[:, s, None, None], moved, product)
    into, out = np.ones((n, k)), np.ones((n, k))
    first = np.cumsum(per_chain) - per_chain
    for b in range(1, int(per_chain.max(initial=0))):
        here = first[per_chain > b] + b
        message = np.einsum("ni,nij->nj", into[here - 1], product[here - 1])
        into[here] = message / message.max(axis=1, keepdims=True)
    for b in range(1, int(per_chain.max(initial=0))):
        here = (first + per_chain - 1)[per_chain > b] - b
        message = np.einsum("nij,nj->ni", product[here + 1], out[here + 1])
        out[here] = message / message.max(axis=1, keepdims=True)

    ahead = np.empty((len(steps_), n, k))
    message = into
    for s in steps_:
        moved = np.where(head[:, None], 1.0, message @ step) if s == 0 else message @ step
        moved = moved * local[at[:, s]]
        moved /= moved.max(axis=1, keepdims=True)
        message = np.where(ok[:, s, None], moved, message)
        ahead[s] = message
    found = np.empty_like(scores)
    message = out
    for s in steps_[::-1]:
        both = ahead[s] * message
        both /= both.sum(axis=1, keepdims=True)
        found[at[ok[:, s], s]] = both[ok[:, s]]
        moved = (message * local[at[:, s]]) @ step.T
        moved /= moved.max(axis=1, keepdims=True)
        message = np.where(ok[:, s, None], moved, message)
    return found


def _sequences(texts: list[str], labels: np.ndarray, n_labels: int, rng: np.random.Generator):
    """Words of the sample and code-switched sequences of them: (bytes, first, ends, hashes) of distinct words, (sequences, LENGTH) word
    numbers and labels. A sequence starts in its language; after a span of 6 to 32 words it goes on with another document."""
    parts, owners = [], []
    data_all, first_all, ends_all, offset = [], [], [], 0
    for i, j, data, hashes, first, ends, own in _words(pa.array(texts, pa.string())):
        parts.append(hashes)
        owners.append(own + i)
        data_all.append(data)
        first_all.append(first + offset)
        ends_all.append(ends + offset)
        offset += len(data)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    data, first, ends = np.concatenate(data_all), np.concatenate(first_all), np.concatenate(ends_all)
    distinct, at, word = np.unique(hashes, return_index=True, return_inverse=True)
    begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    by_label = [[d for d in range(len(texts)) if labels[d] == k and begins[d + 1] > begins[d]] for k in range(n_labels)]
    by_label = [x for x in by_label]
    usable = [k for k in range(n_labels) if by_label[k]]
    rows, tags = [], []
    for k in usable:
        for _ in range(SEQUENCES):
            row, tag, own = [], [], k
            while len(row) < LENGTH:
                doc = by_label[own][rng.integers(len(by_label[own]))]
                span = int(rng.integers(6, LENGTH + 1))
                start = int(rng.integers(begins[doc], max(begins[doc] + 1, begins[doc + 1] - span + 1)))
                some = word[start:min(start + span, begins[doc + 1])]
                row.extend(some)
                tag.extend([own] * len(some))
                own = usable[rng.integers(len(usable))]
            rows.append(row[:LENGTH])
            tags.append(tag[:LENGTH])
    return (data, first[at], ends[at], distinct), np.array(rows), np.array(tags)


def fit(texts: list[str], langs: list[str], bits: int = BITS, seed: int = 7) -> Model:
    """Weights and transitions of largest conditional likelihood, by forward-backward and scaled gradient steps (Adagrad)."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    weights, moves = np.zeros((1 << bits, len(names))), np.zeros((len(names), len(names)))
    labels = np.array([names.index(x) for x in langs])
    if not names or not any(_LETTER[np.frombuffer(t.encode(), dtype="uint8")].any() for t in texts):
        return Model(names, weights, moves)
    (data, first, ends, hashes), rows, tags = _sequences(texts, labels, len(names), rng)
    feats, begin = features(data, first, ends, hashes, bits)
    counts = np.diff(np.append(begin, len(feats)))
    squares, move_squares = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(ROUNDS):
        for some in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            words, inverse = np.unique(rows[some], return_inverse=True)
            own = np.repeat(np.arange(len(words)), counts[words])
            at = feats[np.repeat(begin[words], counts[words]) + np.arange(len(own)) - np.repeat(np.cumsum(counts[words]) - counts[words], counts[words])]
            emitted = np.add.reduceat(weights[at], np.cumsum(counts[words]) - counts[words])
            scores = emitted[inverse.reshape(-1)]
            found = chain_marginals(scores, moves, np.full(len(some), LENGTH))
            target = np.zeros_like(found)
            target[np.arange(len(found)), tags[some].reshape(-1)] = 1
            per_word = np.stack([np.bincount(inverse.reshape(-1), (found - target)[:, k], minlength=len(words)) for k in range(len(names))], axis=1)
            rows_at, back = np.unique(at, return_inverse=True)
            slope = np.stack([np.bincount(back, per_word[own, k], minlength=len(rows_at)) for k in range(len(names))], axis=1) / len(some) + DECAY * weights[rows_at]
            squares[rows_at] += slope**2
            weights[rows_at] -= RATE * slope / np.sqrt(squares[rows_at])
            slope = _move_slope(scores, moves, found, target, len(some)) / len(some)
            move_squares += slope**2
            moves -= RATE * slope / np.sqrt(move_squares)
    return Model(names, weights.astype("float32"), moves)


def _move_slope(scores: np.ndarray, moves: np.ndarray, found: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """Expected minus observed transitions. The expectation takes the pair marginals that go with the words' own."""
    k = scores.shape[1]
    p, y = found.reshape(n, LENGTH, k), target.reshape(n, LENGTH, k)
    local = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(n, LENGTH, k)
    step = np.exp(moves - moves.max())
    total = np.zeros_like(moves)
    ahead = local[:, 0]
    for t in range(1, LENGTH):
        reach = ahead @ step
        # p(i, j) = ahead(i) step(i, j) / reach(j) * p(j), as p(j) holds all that follows.
        total += step * np.einsum("ni,nj->ij", ahead, p[:, t] / np.maximum(reach, 1e-300))
        ahead = reach * local[:, t]
        ahead = ahead / ahead.max(axis=1, keepdims=True)
    return total - np.einsum("nti,ntj->ij", y[:, :-1], y[:, 1:])


def fit_on(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, bits: int = BITS) -> Model:
    """A model from the labelled documents that are not held out: of each language the `sample_docs` with the smallest hash of id and
    text, and of each a stretch of `sample_chars` characters from a place that the hash gives."""
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    known = known.withColumn("mark", F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 31)))
    # Languages are counted first; then only about twice as many documents as wanted leave the scan.
    share = known.groupBy("lang").count().select("lang", F.ceil(F.lit(1 << 31) * F.least(F.lit(1.0), 2.0 * sample_docs / F.col("count"))).alias("below"))
    known = known.join(staged(share, "languages"), "lang").where(F.col("mark") < F.col("below"))
    ranked = known.select("mark", "lang", (F.pmod(F.col("mark"), F.greatest(F.lit(1), F.length("text") - sample_chars)) + 1).cast("int").alias("start"), "text")
    ranked = ranked.select("mark", "lang", F.substring("text", F.col("start"), F.lit(sample_chars)).alias("part"))
    ranked = ranked.withColumn("place", F.expr("row_number() over (partition by lang order by mark, part)")).where(F.col("place") <= sample_docs)
    rows = ranked.select("lang", "place", "part").orderBy("lang", "place").collect()  # bounded by sample_docs and sample_chars for each language
    return fit([r.part for r in rows], [r.lang for r in rows], bits)


def word_labels(model: Model, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: (from, to, text number of each word, label probabilities of each word)."""
    bits = len(model.weights).bit_length() - 1
    for i, j, data, hashes, first, ends, own in _words(column):
        if not len(hashes):
            yield i, j, own, np.zeros((0, len(model.labels)))
            continue
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        emitted = np.empty((len(distinct), len(model.labels)))
        for a in range(0, len(distinct), WORD_STEP):
            feats, begin = features(data, first[at[a:a + WORD_STEP]], ends[at[a:a + WORD_STEP]], distinct[a:a + WORD_STEP], bits)
            emitted[a:a + WORD_STEP] = np.add.reduceat(model.weights[feats].astype("float64"), begin)
        sizes = np.bincount(own)
        yield i, j, own, chain_marginals(emitted[back], model.moves, sizes[sizes > 0])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with SLICE_BYTES of text or a row more. What Arrow has freed goes back to the system, as workers outlive their tasks."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE_BYTES, side="right")) + 1
            yield batch.slice(begin, end - begin)
            begin = end
        pa.default_memory_pool().release_unused()


def identify(docs: DataFrame, model: Model | None = None, keep: tuple[str, ...] = (), sureness: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, from its whole text; `keep` names further columns to carry.

    Each word's label probabilities come from forward-backward over the whole text; lang_pred is the label with the largest mean
    probability (ties: first by name), and score that mean. With `sureness`, a column `sure` has the mean over words of a word's largest probability, which
    does not fall where a text changes its language. Only text is read for it. The model is fitted on the table itself
    (fit_on) unless one is given. NULL and empty texts, and texts without a letter, are `und` with score 0, and so is all if
    there is nothing to learn from. Repeated rows give equal rows; an empty table gives none.
    """
    docs = docs if model is not None else pick(docs, "doc_id", "text", "lang", *[k for k in keep if k not in ("doc_id", "text", "lang")])
    model = model or fit_on(docs)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rest = pick(docs, *dict.fromkeys(["doc_id", "text", *keep]))
    out = [c for c in rest.columns if c in ("doc_id", *keep)]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model: Model = pickle.loads(sent.value)
        for batch in _slices(batches):
            text = batch.column("text")
            n, k = len(text), max(1, len(own_model.labels))
            sums, words, most = np.zeros((n, k)), np.zeros(n), np.zeros(n)
            has_letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if own_model.labels:
                for i, j, own, found in word_labels(own_model, text):
                    sums[i:j] = np.stack([np.bincount(own, found[:, c], minlength=j - i) for c in range(k)], axis=1)
                    words[i:j] = np.bincount(own, minlength=j - i)
                    most[i:j] = np.bincount(own, found.max(axis=1), minlength=j - i)
            known = has_letter & (words > 0)
            share = sums / np.maximum(words, 1)[:, None]
            best = share.argmax(axis=1)
            names = [own_model.labels[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            score = np.where(known, np.clip(share[np.arange(n), best], 0, 1), 0.0)
            sure = [pa.array(np.where(known, np.clip(most / np.maximum(words, 1), 0, 1), 0.0))] if sureness else []
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), *sure],
                                             names=[*out, "held_out", "lang_pred", "score", *(["sure"] if sureness else [])])

    schema = rest.select(*out).schema.add("held_out", "boolean").add("lang_pred", "string").add("score", "double")
    schema = schema.add("sure", "double") if sureness else schema
    return rest.withColumn("held_out", held_out()).mapInArrow(label, schema)
