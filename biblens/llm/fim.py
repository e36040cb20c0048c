"""Fill-in-middle: a text's units are cut at two places, and prefix, suffix and middle change places.

A table-driven automaton over bytes reads a text once. Its states are the start, inside a word, inside white
space, and how much of a sentinel has been read; its byte classes tell white space, UTF-8 continuation bytes, the
characters of sentinels and the rest. Which transitions were taken, and how often, is counted for each block of a
text: those into a byte that is no continuation are code points, those from a word into white space begin a unit, and those
into the last state complete a sentinel. As no state reaches back over more than three bytes, the states of a
block are looked up for all its bytes at a time. A second pass reads only the blocks that hold the two cuts.

Null counts as empty; an empty text, and one that contains a sentinel, stays plain. Repeated rows are each
transformed, rows with equal ids alike; a null id counts as an id without digits. Very long texts are read in blocks; invalid bytes count
as code points unless they look like continuations. An empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblens.llm.common import as_bytes, pick

SEED = 42
#: Of 100 texts so many change, and of 100 that do so many are suffix first.
RATE, SPM = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 1 << 18

OTHER, SPACE, CONTINUATION, OPENS, NAMES, CLOSES, BEFORE = range(7)
START, WORD, WHITE, OPENED, NAMED, SENTINEL = range(6)
CLASSES, BACK = 7, 3

CLASS_OF = np.full(256, OTHER, np.uint16)
CLASS_OF[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS_OF[0x80:0xC0] = CONTINUATION
CLASS_OF[[ord("<"), ord(">")]] = OPENS, CLOSES
CLASS_OF[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = NAMES


def _next(state: int, kind: int) -> int:
    if kind == BEFORE:
        return START
    if kind == SPACE:
        return WHITE
    if kind == OPENS:
        return OPENED
    if kind == NAMES and state == OPENED:
        return NAMED
    return SENTINEL if kind == CLOSES and state == NAMED else WORD


#: The state after three bytes of given classes, whatever came before, by 49 a + 7 b + c.
STATE_AFTER = np.array([_next(_next(_next(START, a), b), c) for a in range(CLASSES) for b in range(CLASSES) for c in range(CLASSES)], np.uint16)
TRANSITIONS = [(s, k) for s in range(6) for k in range(CLASSES)]
IS_POINT = np.array([k != CONTINUATION for _, k in TRANSITIONS])
IS_UNIT = np.array([k == SPACE and s not in (START, WHITE) for s, k in TRANSITIONS])
IS_SENTINEL = np.array([_next(s, k) == SENTINEL for s, k in TRANSITIONS])


def transitions(data: np.ndarray, at: int, end: int) -> np.ndarray:
    """The number, 7 * state + class, of the transition at each of the bytes from ``at`` to ``end``."""
    kinds = np.full(end - at + BACK, BEFORE, np.uint16)
    since = max(0, at - BACK)
    kinds[BACK - (at - since) :] = CLASS_OF[data[since:end]]
    a, b, c = (kinds[i : i + end - at] for i in range(BACK))
    return STATE_AFTER[a * (CLASSES * CLASSES) + b * CLASSES + c] * CLASSES + kinds[BACK:]


class Scan:
    """Counts of a text by blocks, and the places of cuts in it."""

    def __init__(self, data: np.ndarray, block: int = BLOCK) -> None:
        self.data, self.block = data, block
        counts = [np.bincount(transitions(data, i, min(i + block, len(data))), minlength=len(TRANSITIONS)) for i in range(0, len(data), block)]
        table = np.array(counts).reshape(-1, len(TRANSITIONS))
        self.points, self.starts = np.cumsum(table @ IS_POINT), np.cumsum(table @ IS_UNIT)
        self.sentinels = int((table @ IS_SENTINEL).sum())
        self.units = int(self.starts[-1]) + 1 if len(data) else 0

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units."""
        if units == 0:
            return 0, 0
        if units == self.units:
            return len(self.data), int(self.points[-1])
        k = int(np.searchsorted(self.starts, units))
        at = k * self.block
        moves = transitions(self.data, at, min(at + self.block, len(self.data)))
        earlier = int(self.starts[k - 1]) if k else 0
        byte = int(np.flatnonzero(IS_UNIT[moves])[units - earlier - 1])
        return at + byte, (int(self.points[k - 1]) if k else 0) + int(IS_POINT[moves[:byte]].sum())


def draws(doc_id: str, seed: int = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform_text(data: np.ndarray, doc_id: str, seed: int = SEED, rate: int = RATE, spm: int = SPM, block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    scan, h = Scan(data, block), draws(doc_id, seed)
    if not scan.units or scan.sentinels or h[2] % 100 >= rate:
        return scan.units, "plain", None, None, data.tobytes()
    low, high = sorted(x % (scan.units + 1) for x in h[:2])
    (i, before), (j, upto) = scan.cut(low), scan.cut(high)
    prefix, middle, suffix = data[:i].tobytes(), data[i:j].tobytes(), data[j:].tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h[3] % 100 < spm:
        return scan.units, "spm", before, upto - before, b"".join([s, suffix, p, prefix, m, middle])
    return scan.units, "psm", before, upto - before, b"".join([p, prefix, s, suffix, m, middle])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Per row doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output. One narrow pass."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.withColumn("digits", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            data, offsets = as_bytes(b.column(1))
            spans = zip(offsets[:-1].tolist(), offsets[1:].tolist(), b.column(2).to_pylist(), strict=True)
            made = [transform_text(data[i:j], digits, seed, rate, spm) for i, j, digits in spans]
            *told, output = zip(*made, strict=True) if made else ((),) * 5
            columns = [b.column(0), *map(pa.array, told, types), pa.array(output, pa.binary()).cast(pa.string(), safe=False)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text that holds a sentinel stays plain, so each stands once in the others."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
