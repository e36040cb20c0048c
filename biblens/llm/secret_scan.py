"""Secrets in texts: three fixed patterns, and strings of high entropy.

Candidate strings are maximal runs of the characters that keys are written in. For each character
class a window slides over the candidate; Shannon entropy is kept by adding the entering and taking
away the leaving character's share, so a step costs the same for any window. Stretches of windows
over the class's threshold are spans, unless an allow-list pattern covers the candidate or a pattern
has found the same place already. Positions are code points; null counts as empty; empty texts and
texts without findings give zero counts and empty strings. Equal texts have equal results, repeated rows
included; an empty table gives no rows; texts of any length are scanned whole, in time that grows with
their length; spans that start together are listed in the order of kinds; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from biblens.llm.common import as_bytes, pick, row_chunks

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")

#: Character classes: name, members, window, threshold in bits.
CLASSES = (
    ("base64", re.compile(r"[A-Za-z0-9+/=]{20,}"), 20, 3.75),
    ("urlsafe", re.compile(r"[A-Za-z0-9_-]{20,}"), 20, 3.75),
    ("hex", re.compile(r"[0-9a-fA-F]{20,}"), 20, 3.0),
)
#: Candidates that a pattern here matches whole are not secrets.
ALLOW = (
    re.compile(r"[A-Za-z]+"),  # a long word
    re.compile(r"[0-9]+"),  # a long number
    re.compile(r"[A-Za-z]+(?:[-_/=+][A-Za-z]+)*"),  # words in a path or slug
    re.compile(r"[=_+/-]+"),  # a rule
    re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I),  # a UUID
    re.compile(r"\d{4}-\d{2}-\d{2}(?:[T_-][0-9:+Z-]*)?"),  # a date
)

_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[[*range(48, 58), *range(97, 103)]] = True
_CANDIDATE_BYTES = np.zeros(256, bool)
_CANDIDATE_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 45, 47, 61, 95]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three fixed patterns, sorted by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def window_entropy(text: str, window: int) -> Iterator[float]:
    """Entropy in bits of every window of ``text``, by incremental counts."""
    share = [0.0] + [-(c / window) * math.log2(c / window) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    h = 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        h += share[n + 1] - share[n]
        counts[c] = n + 1
        if i >= window:
            old = text[i - window]
            n = counts[old]
            h += share[n - 1] - share[n]
            counts[old] = n - 1
        if i >= window - 1:
            yield h


class Cover:
    """Spans, of which those that lie in another are left out: starts and ends both rise, so a search is a bisection."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, a: int, b: int) -> bool:
        """Whether one span holds all of a to b."""
        i = bisect_right(self.starts, a) - 1
        return i >= 0 and self.ends[i] >= b

    def add(self, a: int, b: int) -> None:
        if self.holds(a, b):
            return
        i = j = bisect_left(self.starts, a)
        while j < len(self.ends) and self.ends[j] <= b:
            j += 1
        self.starts[i:j], self.ends[i:j] = [a], [b]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Stretches of high entropy in candidate strings that the allow-list does not cover."""
    out = []
    for m in CANDIDATE.finditer(text):
        if any(a.fullmatch(m[0]) for a in ALLOW):
            continue
        taken = Cover()
        for name, members, window, least in CLASSES:
            for run in members.finditer(m[0]):
                s = run[0]
                if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
                    continue
                start = None
                for i, h in enumerate([*window_entropy(s, window), -1.0]):
                    if h >= least and start is None:
                        start = i
                    elif h < least and start is not None:
                        a, b = m.start() + run.start() + start, m.start() + run.start() + i - 1 + window
                        start = None
                        if not taken.holds(a, b):
                            taken.add(a, b)
                            out.append((a, b, f"entropy-{name}"))
    return out


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: base ones and entropy spans that no base span holds, by start."""
    base = base_spans(text)
    taken = Cover()
    for a, b, _ in base:
        taken.add(a, b)
    more = [s for s in entropy_spans(text) if not taken.holds(s[0], s[1])]
    order = {k: i for i, k in enumerate((*KINDS, *(f"entropy-{c[0]}" for c in CLASSES)))}
    return base, sorted(base + more, key=lambda s: (s[0], order[s[2]], s[1]))


def _long_runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    """Whether each row has a run of at least ``least`` of the table's bytes."""
    w = table[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], w, [False]]).astype(np.int8)))
    long = edges[0::2][edges[1::2] - edges[0::2] >= least]
    out = np.zeros(len(offsets) - 1, bool)
    # a run may cross rows: every row that it touches is looked at, which only costs time
    ends = edges[1::2][edges[1::2] - edges[0::2] >= least]
    for a, b in zip(np.searchsorted(offsets, long, "right") - 1, np.searchsorted(offsets, ends - 1, "right") - 1, strict=True):
        out[a : b + 1] = True
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row; both are arrays of struct(start, end, kind). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            col = b.column(1)
            data, offsets = as_bytes(col)
            look = np.zeros(len(col), bool)
            for i, j in row_chunks(offsets):
                own = data[offsets[i] : offsets[j]]
                look[i:j] = _long_runs(own, offsets[i : j + 1] - offsets[i], _CANDIDATE_BYTES, 20)
            base, spans = [], []
            as_row = lambda found: [{"start": s, "end": e, "kind": k} for s, e, k in found]
            for i in range(len(col)):
                text = col[i].as_py() or ""
                if look[i]:
                    x, y = scan_text(text)
                elif ":" in text or "=" in text:  # only an assignment can be as short
                    x = y = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
                else:
                    x = y = []
                base.append(as_row(x))
                spans.append(as_row(y))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(spans, span)], names=["doc_id", "base", "spans"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    array = "array<struct<start:long,end:long,kind:string>>"
    return rows.mapInArrow(run, f"doc_id {kind}, base {array}, spans {array}")


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def digest(text: str | None) -> tuple[int, int, int, str, str]:
    """What the query returns of one text; the brute-force form for tests."""
    base, spans = scan_text(text or "")
    n = [sum(k == kind for _, _, k in base) for kind in KINDS]
    return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
