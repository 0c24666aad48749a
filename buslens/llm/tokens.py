"""Token ids of whole texts under a word-level byte-pair tokenizer, word by word with a bounded cache.

The tokenizer's normaliser and splitter never look across white space, so a text's ids are those of its words one after the
other. tests/llm compares both ways.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in each half of a worker's cache.
CACHE_WORDS = 50_000
#: What may stand behind a word's letters, as a piece of its own: ASCII marks, without those of contractions and added tokens.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Runs of marks that are kept.
CACHE_MARKS = 10_000
#: Bytes of texts whose distinct words are looked up together.
RUN_BYTES = 2 << 20
#: Bytes of a text that are split into words at once.
SEGMENT = 1 << 20


def tokenizer_path(path: str | None = None) -> str:
    """A given file, or that of the installed public tokenizer."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def segments(data: bytes) -> Iterator[bytes]:
    """Parts of a text, cut at white space."""
    at = 0
    while len(data) - at > SEGMENT:
        end = at + SEGMENT
        spaces = [data.find(s, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")]
        end = min([s for s in spaces if s >= 0], default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


#: Printable stand-ins of bytes in a byte-level vocabulary: bytes that print stand for themselves, the others for 256 and on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTS} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTS))}


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def _tails(words: pa.Array, begins: np.ndarray) -> pa.Array:
    """What each word holds from a byte on."""
    offsets = np.frombuffer(words.buffers()[1], dtype="int32")[words.offset:words.offset + len(words) + 1].astype("int64")
    size = np.diff(offsets) - begins
    ends = np.zeros(len(words) + 1, dtype="int32")
    np.cumsum(size, out=ends[1:])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] + begins - ends[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.frombuffer(words.buffers()[2], dtype="uint8")[at])])


class _Cache:
    """Keys to ids. Keys move from the older half to the newer one when they are used, and the older half is dropped when the newer is full."""

    def __init__(self, size: int):
        self.size = size
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def get(self, key: bytes) -> bytes | None:
        ids = self.new.get(key)
        if ids is None and (ids := self.old.get(key)) is not None:
            self.new[key] = ids
        return ids

    def put(self, key: bytes, ids: bytes) -> None:
        self.new[key] = ids
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}


class WordTokens:
    """Little-endian 32-bit ids of texts, as bytes. One for each worker process (see `of`): its caches last over tasks. A run of texts is split by Arrow;
    each of its distinct words is looked up once. Words that differ in A-Z and in the marks behind them have their letters in common."""

    _made: dict[str, WordTokens] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.pairs = self.model.model
        self.letters, self.others = _Cache(CACHE_WORDS), _Cache(CACHE_WORDS // 8)
        self.marks: dict[bytes, bytes] = {b"": b""}  # at most CACHE_MARKS

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _merged(self, letters: str) -> bytes:
        """Ids of one piece, straight from the pair merges."""
        ids = [t.id for t in self.pairs.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _simple(self, stem: bytes) -> bytes | None:
        """Ids of letters, A-Z lower-cased already; None for any other word."""
        if stem.isalpha():  # of bytes: A-Z and a-z only
            return self._merged(stem.decode())
        text = stem.decode()
        # Letters below U+0250 are lower-cased alike one by one, but for U+0130.
        if not text.isalpha() or max(text) >= "\u0250" or "\u0130" in text or not unicodedata.is_normalized("NFC", text):
            return None
        return self._merged("".join([_BYTES[b] for b in text.lower().encode()]))

    def _stem(self, stem: bytes) -> bytes | None:
        """Ids of a word's letters, or None if it holds anything else."""
        ids = self._simple(stem)
        if ids is not None:
            self.letters.put(stem, ids)
        return ids

    def _other(self, word: bytes) -> bytes:
        ids = self.others.get(word)
        if ids is None:
            found = self.model.encode(word.decode(), add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
            self.others.put(word, ids)
        return ids

    def _behind(self, marks: bytes) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._merged(marks.decode())
            if len(self.marks) < CACHE_MARKS:
                self.marks[marks] = ids
        return ids

    def _words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct words: a table of them, and each word's place in it."""
        cut = pc.ascii_rtrim(words, MARKS)
        stems = pc.ascii_lower(cut).dictionary_encode()
        get, learn = self.letters.get, self._stem
        table = pa.array([get(k) or learn(k) for k in _bytes(stems.dictionary)], pa.binary())
        at = stems.indices.to_numpy()
        plain = pc.is_valid(table).to_numpy(zero_copy_only=False)[at]
        marked = plain & (pc.binary_length(words).to_numpy() > pc.binary_length(cut).to_numpy())
        n, at = len(table), at.copy()
        if marked.any():
            rows = pa.array(np.flatnonzero(marked))
            behind = _tails(words.take(rows), pc.binary_length(cut).take(rows).to_numpy()).dictionary_encode()
            ids = pa.array([self._behind(m) for m in _bytes(behind.dictionary)], pa.binary()).take(behind.indices)
            table = pa.concat_arrays([table, pc.binary_join_element_wise(table.take(pa.array(at[marked])), ids, pa.scalar(b"", pa.binary()))])
            at[marked] = np.arange(n, len(table))
            n = len(table)
        if not plain.all():
            others = [self._other(w) if w else b"" for w in _bytes(words.filter(pa.array(~plain)))]
            table = pa.concat_arrays([table, pa.array(others, pa.binary())])
            at[~plain] = np.arange(n, len(table))
        return table, at

    def _run(self, texts: pa.Array) -> list[memoryview]:
        """Ids of each of some texts that are not NULL."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        table, at = self._words(words.dictionary)
        ids = table.take(pa.array(at[words.indices.to_numpy()]))
        ends = np.frombuffer(ids.buffers()[1], dtype="int32")[ids.offset:ids.offset + len(ids) + 1]
        counts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        data, cuts = memoryview(ids.buffers()[2] or b""), ends[counts].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def texts(self, column: pa.Array) -> Iterator[Iterator[bytes | memoryview]]:
        """The ids of each text, in one or more parts. NULL counts as empty. Only one text at a time should be worked on."""
        column = column.fill_null("")
        sizes = np.cumsum(pc.binary_length(column).to_numpy().astype("int64"))
        begin = 0
        while begin < len(column):
            end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + RUN_BYTES, side="right"))
            if end > begin:
                yield from ([ids] for ids in self._run(column.slice(begin, end - begin)))
            else:
                end = begin + 1
                yield self.ids(column[begin].as_buffer().to_pybytes())
            begin = end

    def ids(self, text: bytes) -> Iterator[memoryview]:
        for part in segments(text):
            yield from self._run(pa.array([part], pa.binary()).cast(pa.string()))
