"""Secrets in text: fixed patterns, and strings of high entropy."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from buslens.llm.common import pick

# Fixed patterns, and the least number of characters of a match (of its second group for assignments).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

#: Character classes of candidate strings: pattern, window, least bits a character in a window. One in 200 windows of random characters of the
#: class's own alphabet has fewer bits (hex, base32, lower or upper case with digits, both cases with digits, base64).
CLASSES = ((re.compile(r"[0-9A-Fa-f]{20,}"), 20, 2.82), (re.compile(r"[A-Z2-7]{20,}"), 20, 3.28), (re.compile(r"[a-z0-9]{20,}"), 20, 3.34), (re.compile(r"[A-Z0-9]{20,}"), 20, 3.34),
           (re.compile(r"[A-Za-z0-9]{20,}"), 20, 3.58), (re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}"), 20, 3.58))
#: Strings that are no secrets: words alone, words and numbers joined by - / _ + (also words with up to three digits behind), UUIDs.
ALLOWED = tuple(re.compile(x) for x in (
    r"[A-Za-z]+", r"\d+", r"([A-Za-z]+\d{0,3}|\d{1,4})([-/_+]+([A-Za-z]+\d{0,3}|\d{1,4}))+", r"\d+([-/_]\d+)*", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"))
#: What stands for a secret: no window goes over it, nor over what is joined to it without - / _ + and shorter than a window.
PLACEHOLDER = re.compile(r"abcdefghij|0123456789|example|placeholder|x{6,}", re.IGNORECASE)
JOINT = re.compile(r"[-/_+=]+")


def open_parts(text: str, window: int) -> list[tuple[int, int]]:
    """Parts of a candidate that hold no placeholder and are as long as a window."""
    marks = [m.span() for m in PLACEHOLDER.finditer(text)]
    if not marks:
        return [(0, len(text))]
    joints = [(0, 0), *[m.span() for m in JOINT.finditer(text)], (len(text), len(text))]
    parts, start, k = [], 0, 0
    for (_, s), (e, _) in zip(joints, joints[1:]):
        held = []
        while k < len(marks) and marks[k][0] < e:
            held.append(marks[k])
            k += 1
        if held:
            parts.append((start, s))
            parts += [(x, y) for x, y in zip([s, *[m[1] for m in held]], [*[m[0] for m in held], e])]
            start = e
    return [(s, e) for s, e in [*parts, (start, len(text))] if e - s >= window]


def hot_spans(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged windows of at least `bits` bits a character. Sliding by one changes two counts, and so the entropy by four terms."""
    n = len(text)
    if n < window:
        return []
    # The entropy of a window of w characters is log2(w) - sum(c * log2(c)) / w over the counts c.
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]  # a count goes one over before the old character leaves
    least = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(text):
        m = counts.get(c, 0)
        counts[c] = m + 1
        total += term[m + 1] - term[m]
        if i >= window:
            old = text[i - window]
            m = counts[old]
            counts[old] = m - 1
            total += term[m - 1] - term[m]
        if i >= window - 1 and total <= least:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN] if ("=" in text or ":" in text) else []
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS] if "AKIA" in text else []
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def entropy_spans(text: str, allowed: tuple[re.Pattern, ...] = ALLOWED) -> list[tuple[str, int, int]]:
    """Spans of high entropy in candidate strings, merged over the classes. A span goes if an allow-list pattern covers it, or the candidate."""
    found: list[tuple[int, int]] = []
    for pattern, window, bits in CLASSES:
        for m in pattern.finditer(text):
            if any(a.fullmatch(m[0]) for a in allowed):
                continue
            for s, e in open_parts(m[0], window):
                for x, y in hot_spans(m[0][s:e], window, bits):
                    span = m[0][s + x:s + y]
                    if not any(a.fullmatch(span) or a.fullmatch(span.strip("-/_+=")) for a in allowed):
                        found.append((m.start() + s + x, m.start() + s + y))
    merged: list[list[int]] = []
    for s, e in sorted(found):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return [("entropy", s, e) for s, e in merged]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find_secrets(docs: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Secrets of each whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans: kind:start:end of all, by start, in code points, end exclusive. Base kinds are fixed patterns; entropy spans are added
    where a window slid over a candidate string reaches its class's entropy and neither the allow-list nor `allowed` (more
    patterns) covers the span found or the whole string. base_sha256 digests the base spans alone. NULL and empty texts have no spans; a repeated
    row gives a repeated row; an empty table gives none. One pass without a shuffle; a text is held alone.
    """
    suppress = ALLOWED + tuple(re.compile(x) for x in allowed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                kinds = [k for k, _, _ in base]
                rows.append((*[kinds.count(k) for k in KINDS[:3]], hashlib.sha256(written(base).encode()).hexdigest(), written(base + entropy_spans(text, suppress))))
            found = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in found[:3]], *[pa.array(x, pa.string()) for x in found[3:]]],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    docs = pick(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
