"""Secret scans: fixed base patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are maximal runs of key-like characters. In each, every character class has a window
that slides by one character; the window's entropy follows from counts of which only two change
at a step. Dates and parts that name an example are cut out of a candidate; in the stretches that
are left, windows over the class's threshold unite into a span, unless the allow-list knows the
whole stretch. Offsets are code points, ends exclusive.

Defined results: null and empty texts have no spans; rows are independent, so repeated rows and
ids repeat their results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textarrays import LOWER, runs, slices, texts

# The base patterns and the least length of each match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy")

#: name, members, window in characters, least entropy in bits a character.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 24, 3.0),
    ("alnum", frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, 3.7),
    ("base64", frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"), 24, 4.0),
)
#: Parts that are no secrets, whatever stands beside them: documentation examples, dates.
CUTS = (
    r"(?<![^-_/=])[^-_/=]*EXAMPLE[^-_/=]*",
    r"(?<![^-_/=])[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}(?![^-_/=])",
)
#: Stretches that are no secrets as a whole: identifiers in UUID form, chains of words shorter than a window, repeats.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[-_/=]*([A-Za-z]{1,19}[-_/=]+)+([A-Za-z]{0,19})[0-9]{0,4}",
    r"(?P<one>.)(?P=one)*",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_HEX = _table("0123456789abcdef")
_CANDIDATE = _table("".join(sorted(CLASSES[2][1])))


def entropy_spans(candidate: str, classes=CLASSES) -> list[tuple[int, int]]:
    """United spans of all windows, of any class, whose entropy reaches the class's threshold."""
    found: list[tuple[int, int]] = []
    for _, members, window, least in classes:
        if len(candidate) < window:
            continue
        term = [0.0] + [n * log2(n) for n in range(1, window + 1)]
        limit = window * (log2(window) - least) + 1e-9  # entropy >= least, as a bound on the sum of n log n
        counts: dict[str, int] = {}
        held, total = 0, 0.0  # characters of the class in the window so far
        for i, c in enumerate(candidate):
            if c not in members:
                counts.clear()
                held, total = 0, 0.0
                continue
            n = counts.get(c, 0)
            total += term[n + 1] - term[n]
            counts[c] = n + 1
            if held == window:
                out = candidate[i - window]
                n = counts[out]
                total += term[n - 1] - term[n]
                counts[out] = n - 1
            else:
                held += 1
            if held == window and total <= limit:
                found.append((i - window + 1, i + 1))
    found.sort()
    united: list[tuple[int, int]] = []
    for a, b in found:
        if united and a <= united[-1][1]:
            united[-1] = (united[-1][0], max(b, united[-1][1]))
        else:
            united.append((a, b))
    return united


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the assign and access patterns; hex runs are found in bulk."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    return out + [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]


def _holding(data: np.ndarray, offsets: np.ndarray, needles: tuple[bytes, ...], rows: set[int]) -> None:
    raw = data.tobytes()
    for needle in needles:
        at = raw.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            rows.add(row)
            at = raw.find(needle, int(offsets[row + 1]))


def stretches(candidate: str, cuts: re.Pattern | None, least: int) -> list[tuple[int, str]]:
    """(start, stretch) of what the cuts leave of a candidate, as far as a window fits."""
    at, out = 0, []
    for a, b in [m.span() for m in cuts.finditer(candidate)] if cuts else []:
        out.append((at, candidate[at:a]))
        at = b
    out.append((at, candidate[at:]))
    return [(k, x) for k, x in out if len(x) >= least]


def scan_texts(data: np.ndarray, offsets: np.ndarray, classes=CLASSES, allow=ALLOW, cuts=CUTS) -> list[list[tuple[int, int, str]]]:
    """The spans of each text, by start, then kind in the order of KINDS."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in range(len(offsets) - 1)]
    wanted: set[int] = set()
    _holding(LOWER[data], offsets, (b"passw", b"secret", b"token", b"apikey", b"api_key"), wanted)
    _holding(data, offsets, (b"AKIA",), wanted)
    for row in wanted:
        text = data[offsets[row] : offsets[row + 1]].tobytes().decode()
        found[row] += base_spans(text)
    allowed, cut = (re.compile("|".join(f"(?:{p})" for p in x)) if x else None for x in (allow, cuts))
    hexes, candidates = runs(data, offsets, _HEX), runs(data, offsets, _CANDIDATE)
    long = hexes[1] - hexes[0] >= LEAST["hex"]
    least = min(window for _, _, window, _ in classes) if classes else 1 << 60
    wide = candidates[1] - candidates[0] >= least
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    for start, end, row in zip(*(x[long].tolist() for x in hexes)):
        shift = int(chars[offsets[row]])
        found[row].append((int(chars[start]) - shift, int(chars[end]) - shift, "hex"))
    base = [list(x) for x in found]
    for start, end, row in zip(*(x[wide].tolist() for x in candidates)):
        candidate = data[start:end].tobytes().decode()
        for skipped, stretch in stretches(candidate, cut, least):
            if allowed and allowed.fullmatch(stretch):
                continue
            at = int(chars[start] - chars[offsets[row]]) + skipped
            for a, b in entropy_spans(stretch, classes):
                if not any(x <= at + a and at + b <= y for x, y, _ in base[row]):
                    found[row].append((at + a, at + b, "entropy"))
    for spans in found:
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with every span, overlaps united, replaced by the mark."""
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a > end:
            out += [text[at:a] if end < 0 else text[end:a], mark]
            end = b
        end = max(end, b)
    return "".join(out) + text[end:] if end >= 0 else text


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end) in the order of start, then kind."""
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = scan_texts(*texts(batch))
            spans = pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in row] for row in found], spans_type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], ["doc_id", "spans"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of `scan` replaced in text, and n_chars, if there, recounted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = scan_texts(*texts(batch))
            if any(found):
                at, kind = batch.schema.get_field_index("text"), batch.schema.field("text").type
                new = [redacted(t, s, mark) if s else t for t, s in zip(batch.column(at).to_pylist(), found)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, kind))
                if (k := batch.schema.get_field_index("n_chars")) >= 0:
                    kind = batch.schema.field(k).type
                    counts = [len(t) if s else n for t, s, n in zip(new, found, batch.column(k).to_pylist())]
                    batch = batch.set_column(k, batch.schema.field(k), pa.array(counts, kind))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
