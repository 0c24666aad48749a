"""Byte-pair encoding by dynamic programming over prefixes.

The merges of a text's encoding never cross the bounds of the tokens that come out. So the encoding of a text is, up to its last token, the encoding of
the prefix in front of that token, and a row of tokens is an encoding if and only if each token encodes to itself and each pair of neighbours encodes to that pair. Hence every
prefix of a word has exactly one last token: of the tokens that the prefix ends in, the one that is compatible with the last token of what precedes it. An automaton over the
vocabulary reports the tokens that end at each place; one table holds each prefix's last token; going back from the end gives the ids. The work grows with the length of
the word, not with its merges.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from buslens.llm.common import pick
from buslens.llm.tokens import _BYTES, segments, tokenizer_path

#: Words in each half of a worker's cache, and the longest one that is kept.
CACHE_WORDS, CACHE_BYTES = 250_000, 64
#: Pairs whose test is remembered.
CACHE_PAIRS = 500_000
#: Letters that close a word, in the automaton: one for each initial symbol.
_CLOSED = 0xE000
_NEVER = 1 << 62


class PrefixBpe:
    """Encodes words, given as symbols of the vocabulary, to the ids that merging by rank would give.

    vocabulary: token to id; merges: pairs in order of rank; suffix: what the last symbol of a word carries.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        import ahocorasick

        self.vocabulary, self.suffix = vocabulary, suffix
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            a, b, made = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if made in self.parts:
                raise ValueError(f"merge {rank} makes a token again")
            self.rank[made], self.parts[made], self.merge[a, b] = rank, (a, b), rank
        if any(self.rank.get(part, -1) >= self.rank[made] for made, pair in self.parts.items() for part in pair):
            raise ValueError("a merge comes before its parts")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}
        usable: set[int] = set()
        singles = [t for t, i in vocabulary.items() if i not in self.parts and len(self._open(t)) == 1]
        for token in singles + [a + b for a, b in merges]:
            number = vocabulary[token]
            parts = self.parts.get(number)
            if parts is None or (parts[0] in usable and parts[1] in usable and self._apart(*parts, self.rank[number])):
                usable.add(number)
                self.whole[self._open(token)] = number
                self.automaton.add_word(self._open(token), (len(self._open(token)), number))
        self.automaton.make_automaton()

    def _open(self, token: str) -> str:
        """A token with its closing symbol as one letter."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            stem = token[:-len(self.suffix)]
            return stem[:-1] + chr(_CLOSED + ord(stem[-1]))
        return token

    def _apart(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether no merge crosses the bound between two tokens, which encode to themselves, before the merge of rank `before`.

        Undoes the merges on both sides of the bound, the latest first. Two tokens face each other there until one of them is merged into a longer one; a merge of
        the two comes first if its rank is smaller, or equal and the longer one is on the right, as equal merges go from left to right.
        """
        left_until = right_until = before
        while True:
            crossing = self.merge.get((a, b))
            if crossing is not None and crossing < left_until and crossing <= right_until and crossing < before:
                return False
            rank_a, rank_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_b >= rank_a:
                right_until, b = rank_b, self.parts[b][0]
            else:
                left_until, a = rank_a, self.parts[a][1]

    def _follows(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._apart(a, b)
        return known

    def encode(self, symbols: str) -> list[int]:
        """Ids of one word."""
        word = symbols[:-1] + chr(_CLOSED + ord(symbols[-1])) if self.suffix else symbols
        only = self.whole.get(word)
        if only is not None:
            return [only]
        # Per prefix, its last token and that token's length.
        last, size = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        for end, (length, token) in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                begin = end - length
                if not begin or (last[begin] >= 0 and self._follows(last[begin], token)):
                    last[end], size[end] = token, length
        ids, at = [], len(word)
        while at:
            if last[at] < 0:
                raise ValueError(f"{symbols!r} holds symbols that the vocabulary lacks")
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]


class _Cache(dict):
    """Word to (ids, decoded text), both as bytes; learns a word when it is asked for the first time."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> tuple[bytes, bytes]:
        found = self.learn(word)
        if len(word) <= CACHE_BYTES:
            self[word] = found
        return found


class TextCodec:
    """Encodes and decodes whole texts under a tokenizer file. One for each worker process (`of`).

    Normaliser and splitter are those of the file, run by its library on one word between white space at a time, as neither looks across white space; the merges are `PrefixBpe`'s.
    Special tokens that stand in a text count as such, as the library has it.
    """

    _made: dict[str, TextCodec] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or spec["decoder"] or spec["post_processor"]:
            raise ValueError("only plain byte-pair models without decoder and post-processor are known")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("only special tokens that are matched as they stand are known")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bpe = PrefixBpe(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in added}
        self.marks = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self.names = {i: t.encode() for t, i in model["vocab"].items()} | {i: t.encode() for t, i in self.special.items()}
        self.new, self.old = _Cache(self._learn), {}

    @classmethod
    def of(cls, path: str) -> TextCodec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _plain(self, text: str) -> list[int]:
        # Up to U+024F, composed letters are one piece and lower-cased one by one, but for U+0130.
        if text.isalpha() and (text.isascii() or max(text) < "\u0250" and "\u0130" not in text and unicodedata.is_normalized("NFC", text)):
            return self.bpe.encode("".join([_BYTES[b] for b in text.lower().encode()]) if not text.isascii() else text.lower())
        return [i for symbols, _ in self.split(self.normalize(text)) for i in self.bpe.encode(symbols)]

    def word_ids(self, word: str) -> list[int]:
        """Ids of what stands between white space."""
        if self.marks is None or "<" not in word and not self.marks.search(word):
            return self._plain(word)
        ids = []
        for part in self.marks.split(word):
            if part:
                ids += [self.special[part]] if part in self.special else self._plain(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """Tokens with blanks between them: a tokenizer without decoder has no other text."""
        return b" ".join([self.names[i] for i in ids])

    def _learn(self, word: bytes) -> tuple[bytes, bytes]:
        known = self.old.get(word)
        if known is not None:
            return known
        stem = word.rstrip(b".,")
        if len(stem) < len(word) and stem and stem.decode().isalpha():
            parts = self.new[stem.lower()], self.new[word[len(stem):]]
            return parts[0][0] + parts[1][0], parts[0][1] + b" " + parts[1][1]
        ids = self.word_ids(word.decode())
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def parts(self, text: bytes) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text) of consecutive parts of a text; parts without ids are left out."""
        for part in segments(text):
            if len(self.new) > CACHE_WORDS:
                self.old, self.new = self.new, _Cache(self._learn)
            found = [w for w in map(self.new.__getitem__, part.split()) if w[0]]
            if found:
                ids, decoded = zip(*found)
                yield b"".join(ids), b" ".join(decoded)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of `docs` (doc_id, text): ids of the whole text and the text they decode to, as hashes.

    path: a tokenizer file, by default that of the installed public tokenizer; every worker reads it where it lies. Special tokens are not added, those in a text are kept.
    Nothing is shuffled. A text is encoded in parts of a megabyte cut at white space, its hashes grow with them, so memory does not grow with the text beyond the text itself and its
    longest word. Words up to 64 bytes are remembered in a cache of bounded size.

    NULL and empty texts have no tokens; texts repeated in full give equal rows; NULL doc_id stays NULL; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    given = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TextCodec.of(tokenizer_path(given))
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                count, ids, decoded, any_yet = 0, hashlib.sha256(), hashlib.sha256(), False
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for some, words in codec.parts(raw):
                    count += len(some) // 4
                    ids.update(some)
                    if any_yet:
                        decoded.update(b" ")
                    decoded.update(words)
                    any_yet = True
                rows.append((count, ids.hexdigest(), decoded.hexdigest()))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = pick(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
