"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from counts of its
bytes, words and word shapes by a tanh layer; gated attention, tanh(V h) times sigmoid(U h) against a
learned vector, weighs the passages; the weighted sum of the encodings gives the document's score.
Only document labels are used: the weights of passages are learned from them. Every passage of every
text counts, none is cut off.

Training takes at most ``MOST`` labelled documents, those with the smallest hash of their id, and at most
``MOST_BYTES`` of their texts, so that what the driver holds is bounded. Without documents of both labels the score is the share of label 1
(0.5 if there is no label at all). Null counts as empty; an empty text is one passage of zeros. Equal
texts have equal scores, so repeated rows and ties do; an empty table gives no rows. Texts of any length are scored
whole. Ids may be of any type; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblens.llm.common import as_bytes, pick, row_chunks, tidy, word_spans
from biblens.runtime import write_table

PASSAGE = 48
#: Documents, and bytes of their texts, that are learned from at most.
MOST, MOST_BYTES = 6000, 48 << 20
HIDDEN, GATE, EPOCHS, BATCH = 24, 12, 24, 128
THRESHOLD = 0.3

_SPACES = np.zeros(256, bool)
_SPACES[[*range(9, 14), 32]] = True
_TOKEN = ~_SPACES
#: Byte classes whose shares are features.
_CLASSES = [np.zeros(256, np.uint8) for _ in range(6)]
for _c, _members in zip(_CLASSES, ([*range(97, 123)], [*range(65, 91)], [*range(48, 58)], [*range(128, 256)], [46, 44, 59, 58], [33, 35, 36, 37, 38, 42, 124, 64, 126, 94, 95, 123, 125, 60, 62]), strict=True):
    _c[_members] = 1
_SHAPE = np.zeros(256, np.uint8)  # lower 1, upper 2, digit 3, beyond ASCII 4, sentence marks 5, symbols 6, other 7
_SHAPE[33:127] = 7
for _k, _c in enumerate(_CLASSES, 1):
    _SHAPE[_c.astype(bool)] = _k
SHAPES = 64
FEATURES = 2 * len(_CLASSES) + 8 + SHAPES


def _passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of some rows, and each row's first passage (every row has one at least)."""
    starts, ends, first = word_spans(data, offsets, _TOKEN)
    counts = np.diff(first)
    made = np.maximum(1, -(-counts // PASSAGE))
    row_first = np.concatenate([[0], np.cumsum(made)])
    total = int(row_first[-1])
    x = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return x, row_first
    row = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(starts)) - first[row]
    passage = row_first[row] + pos // PASSAGE
    length = (ends - starts).astype(np.float64)
    add = lambda w: np.bincount(passage, w, total)
    words, size = add(None), add(length)
    some, chars = np.maximum(words, 1), np.maximum(size, 1)
    k = 0
    for c in _CLASSES:
        p = np.concatenate([[0], np.cumsum(c[data], dtype=np.int64)])
        inside = (p[ends] - p[starts]).astype(np.float64)
        x[:, k] = add(inside) / chars
        x[:, k + 1] = add(inside >= 0.5 * length) / some
        k += 2
    head, tail = _SHAPE[data[starts]].astype(np.int64), _SHAPE[data[ends - 1]].astype(np.int64)
    # equal neighbours: same length, first, middle and last byte
    sig = (ends - starts) * 0x1000000 + data[starts].astype(np.int64) * 65536 + data[ends - 1].astype(np.int64) * 256 + data[(starts + ends) // 2]
    same = np.zeros(len(sig))
    same[1:] = (sig[1:] == sig[:-1]) & (row[1:] == row[:-1])
    # distinct words in the passage, by the same signature
    key = np.unique(passage.astype(np.int64) * (1 << 40) + (sig ^ (sig >> 17)) % (1 << 40))
    distinct = np.bincount(key >> 40, minlength=total)
    x[:, k] = size / some / 10
    x[:, k + 1] = np.sqrt(np.maximum(add(length**2) / some - (size / some) ** 2, 0)) / 10
    x[:, k + 2] = add(same) / some
    x[:, k + 3] = distinct / some
    x[:, k + 4] = add(length == 1) / some
    x[:, k + 5] = add(length > 20) / some
    x[:, k + 6] = np.log1p(words) / 4
    gap = np.concatenate([starts[1:] - ends[:-1], [1]])
    x[:, k + 7] = add(gap > 1) / some
    shape = passage * SHAPES + head * 8 + tail
    x[:, k + 8 :] = np.bincount(shape, minlength=total * SHAPES).reshape(total, SHAPES) / some[:, None]
    return x, row_first


def passage_features(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: (first row, end row, passage features, each row's first passage)."""
    data, offsets = as_bytes(col)
    for i, j in row_chunks(offsets, 1 << 19):
        x, first = _passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, x, first


class Model:
    """Encoder, gated attention and output layer. Features are standardised by the training rows."""

    def __init__(self, rate: float, mean: np.ndarray | None = None, scale: np.ndarray | None = None, params: dict[str, np.ndarray] | None = None):
        self.rate, self.mean, self.scale, self.params = rate, mean, scale, params

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of documents whose passages are consecutive rows of x."""
        p = self.params
        z = np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float32)
        h = np.tanh(z @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        at = first[:-1]
        owner = np.repeat(np.arange(len(at)), np.diff(first))
        a = np.exp(s - np.maximum.reduceat(s, at)[owner])
        a /= np.add.reduceat(a, at)[owner]
        bag = np.add.reduceat(h * a[:, None], at)
        return bag @ p["c"] + p["b"][0], (z, h, v, u, a, bag, owner, at)

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.params is None:
            return np.full(len(first) - 1, self.rate)
        return 1 / (1 + np.exp(-np.clip(self.forward(x, first)[0].astype(np.float64), -30, 30)))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Learn from bags of passages and one label each, by Adam on the log loss."""
    y = np.asarray(labels, np.float32)
    rate = float(y.mean()) if len(y) else 0.5
    if len(y) < 2 or y.min() == y.max():
        return Model(rate)
    rng = np.random.Generator(np.random.PCG64(seed))
    everything = np.concatenate(bags)
    mean, scale = everything.mean(0), np.maximum(everything.std(0), 0.02)
    init = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
    p = {"E": init(FEATURES, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE)}
    p |= {"w": init(GATE, 1)[:, 0], "c": init(HIDDEN, 1)[:, 0], "b": np.array([np.log(rate / (1 - rate))], np.float32)}
    model = Model(rate, mean, scale, p)
    m, v2 = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        lr = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            x = np.concatenate([bags[k] for k in some])
            first = np.concatenate([[0], np.cumsum([len(bags[k]) for k in some])])
            logit, (z, h, v, u, a, bag, owner, at) = model.forward(x, first)
            d = ((1 / (1 + np.exp(-logit))) - y[some]) / len(some)
            d_bag = d[:, None] * p["c"][None, :]
            d_h = a[:, None] * d_bag[owner]
            d_a = (h * d_bag[owner]).sum(1)
            d_s = a * (d_a - np.add.reduceat(a * d_a, at)[owner])
            d_vu = d_s[:, None] * p["w"][None, :]
            d_v, d_u = d_vu * u * (1 - v * v), d_vu * v * u * (1 - u)
            d_h = d_h + d_v @ p["V"].T + d_u @ p["U"].T
            d_z = d_h * (1 - h * h)
            grad = {"E": z.T @ d_z, "e": d_z.sum(0), "V": h.T @ d_v, "U": h.T @ d_u, "w": (v * u).T @ d_s, "c": bag.T @ d, "b": np.array([d.sum()])}
            step += 1
            for k, g in grad.items():
                g = g.astype(np.float32) + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(column: str = "doc_id"):
    """Rows that are never learned from: the CRC-32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST, most_bytes: int = MOST_BYTES) -> Model:
    """Fit on a bounded sample of labelled documents outside the held-out fold. Null labels are left out.

    The sample: the ``most`` documents with the smallest hash of their id, and of those, in that order, as
    many whole texts as ``most_bytes`` hold (a text that alone is longer than a quarter of that is passed over).
    An id with several labels has the highest, one with several texts the smallest text.
    """
    lab = labels.select(F.col("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id is not null and y is not null")
    lab = lab.filter(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    short, _ = write_table(texts.filter(size <= most_bytes // 4).groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "labelled")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # only ids and sizes, of ``most`` texts at most, go through one task
    places = short.select("doc_id", F.sum(size).over(order).alias("at")).filter(F.col("at") <= most_bytes)
    sample = short.join(F.broadcast(places), "doc_id").select("y", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x, first in passage_features(b.column(1)):
                got = [x[first[k] : first[k + 1]].astype(np.float16).tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(got, pa.binary()), b.column(2).slice(i, j - i)], names=["y", "x", "at"])

    bags = sample.mapInArrow(tidy(run), "y double, x binary, at long").collect()  # bounded: most_bytes of text
    bags.sort(key=lambda r: (r["at"], r["y"], bytes(r["x"])))
    if not bags:
        return Model(0.5)
    return fit([np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES).astype(np.float32) for r in bags], np.array([float(r["y"] >= 0.5) for r in bags]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = pick(docs, doc_id="doc_id", text="text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows)
            for i, j, x, first in passage_features(b.column(1)):
                s[i:j] = sent.value.score(x, first)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows, with all their columns, whose score reaches the threshold. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for i, j, x, first in passage_features(b.column(at)):
                good[i:j] = sent.value.score(x, first) >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(tidy(run), docs.schema)
