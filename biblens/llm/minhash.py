"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of its five-word shingles (words are runs of letters, digits and underscores,
lower-cased; a text with fewer words is one shingle of them all). A shingle weighs its count times
idf = 2 - log(df) / (2 log N), in 64ths: its own document frequency df among all N documents decides, whatever it
is, from 2 for a shingle of one document down to 1.5 for one of all. (The logarithm is smoothed so far because
a weight that fell on with the frequency would part large groups of copies: what they share is frequent, their
differences are not.)

Frequencies are exact, for every shingle. Chunks of texts send their shingles' hashes, packed, to shards of the
hashes' range; a shard counts its own and answers with the weight of each, a byte of 64ths; a chunk puts the
answers together to the weights of each text, in the order of its hashes. They are kept beside the texts and go with
them through signatures and verification; nothing of them passes through the driver or is broadcast.

``SAMPLES`` improved consistent weighted samples (Ioffe 2010) of each text are cut into bands. Texts
that share a band meet in a bucket. A bucket does not emit its pairs: from the samples' agreement it
keeps a maximum spanning forest, as far as the estimate comes within ``MARGIN`` of the threshold.
Buckets beyond ``CHUNK_ROWS`` texts are
parted ``TURNS`` times, each time by another sample from outside the band: texts as similar as the
threshold meet again in a part with a probability of 0.8 a turn, so of 0.96 in all. Buckets and parts
beyond ``CHUNK_ROWS`` are also cut into chunks by a hash that differs from band to band, and the chunks'
first texts meet again in the same way. The kept pairs are verified by the weighted Jaccard similarity of the whole texts.
Links make components, found by alternating stars.

What the forests left open is settled exactly. Components whose texts met, in a forest's edge that was
refuted or in a bucket that was cut, make a group; in each group every text outside its largest component is
compared with all texts of the group, in blocks of chunks that hold the texts themselves, and all its pairs from the
margin on are verified there, unless links have joined the two already. So the classes are those of all pairs that met
in a bucket of any size and come within the margin, and no pairs are shuffled. A group costs its size times the number of
its texts outside the largest component, in comparisons of samples; with the square of its size where nothing in it is
linked. The margin misses a pair at exactly 0.8 that met in one band with a probability of 0.0026 (its other
95 samples agree in fewer than 65).

Equal texts are always one class, empty ones too (null counts as empty): they are one text from the
start and never expanded into pairs. Rows with repeated or null ids are documents of their own. An empty table
gives no rows; texts of any length count whole; ties go to the smaller id, further columns are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblens.llm.common import as_bytes, cut_bytes, join_hot, pick, shelter, shingle_sets, tidy, with_uid
from biblens.runtime import drop_table, partitions, write_table

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
SAMPLES = BANDS * ROWS
#: Pairs whose estimate is this far below the threshold are verified (2.5 standard errors).
MARGIN = 0.1
#: Texts, and bytes of them, in a chunk of a bucket or group.
CHUNK_ROWS, CHUNK_BYTES = 1500, 8 << 20
#: Samples from outside the band that part a bucket beyond ``CHUNK_ROWS``, one after another.
TURNS = 2
#: Links that one task unites at most.
FEW_EDGES = 20_000
#: Ids of texts to verify that are broadcast at most.
SENT_IDS = 1_000_000
#: Shingles in more than this share of documents have a weight of their own: none is left out.
FREQUENT = 0.0
#: Texts and shingles in a chunk whose frequencies are asked for at once, and bytes of text for each shard that counts.
COUNT_TEXTS, COUNT_SIZE, SHARD_BYTES = 1024, 1 << 18, 8 << 20

_rng = np.random.Generator(np.random.PCG64(20100912))
_TABLE = 1 << 16
_r, _c, _beta = _rng.gamma(2, 1, _TABLE), _rng.gamma(2, 1, _TABLE), _rng.random(_TABLE)
_MULTIPLY = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def _log_a(index: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """ln a of the sampling scheme: c / (y e^r) with y = exp(r (t - beta)), t = floor(ln w / r + beta)."""
    r, b = _r[index], _beta[index]
    return np.log(_c[index]) - r * (np.floor(np.log(weight) / r + b) - b + 1)


#: The weight of a shingle that occurs once, in one document, and the order of its ln a.
PLAIN = 2.0
_plain = _log_a(np.arange(_TABLE), np.full(_TABLE, PLAIN))
_sorted = np.sort(_plain)
_order = np.empty(_TABLE, np.uint32)
_order[np.argsort(_plain, kind="stable")] = np.arange(_TABLE, dtype=np.uint32)
#: The weight of a shingle that occurs once, in all documents; weights between are whole numbers of 1 / STEPS.
LEAST = 1.5
STEPS = 64
_LOW, _HIGH = round(LEAST * STEPS), round(PLAIN * STEPS)


def idf(df: np.ndarray, n: int) -> np.ndarray:
    """Weights of shingles of ``df`` documents among ``n``."""
    return np.rint(STEPS * (PLAIN - (PLAIN - LEAST) * np.log(np.maximum(df, 1)) / np.log(max(n, 2)))) / STEPS


def _place(index: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(_sorted, _log_a(index, weight)), _TABLE - 1)


@cache
def _places() -> np.ndarray:
    """Places of ln a, one row of the table for each weight of ``idf``, as ``_order`` has them for ``PLAIN``."""
    out = np.empty((_HIGH - _LOW + 1, _TABLE), np.uint16)
    for k in range(_LOW, _HIGH):
        out[k - _LOW] = _place(np.arange(_TABLE), np.full(_TABLE, k / STEPS))
    out[-1] = _order
    return out.reshape(-1)


class Weights:
    """idf of given shingles; all others weigh ``PLAIN`` an occurrence."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order].astype(np.uint64)
        self.values = idf(np.minimum(df[order], n), max(n, 1))

    def of(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = np.full(len(h), PLAIN)
        if len(self.hashes) and len(h):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            w[hit] = self.values[at[hit]]
        return w * tf


def samples(row: np.ndarray, h: np.ndarray, w: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their samples as 32-bit keys, one column each.

    Each shingle and sample number picks its (r, c, beta) from a table by hash. A sample is the shingle
    with the least ln a, and its t: the key is the place of ln a among the table's values, then bits of
    the hash, which settle ties alike in all texts.
    """
    have, first = np.unique(row, return_index=True)
    out = np.empty((len(have), SAMPLES), np.uint32)
    if not len(have):
        return have, out
    h32 = ((h >> np.uint64(16)) ^ h).astype(np.uint32)
    step = w * STEPS
    even = (step >= _LOW) & (step <= _HIGH) & (step == np.rint(step))
    odd = np.flatnonzero(~even)
    odd_w = w[odd]
    places, base = _places(), (np.where(even, step, _HIGH).astype(np.uint32) - np.uint32(_LOW)) * np.uint32(_TABLE)
    for k in range(SAMPLES):
        v = h32 * _MULTIPLY[k] + _ADD[k]
        index = v >> np.uint32(16)
        place = places[base + index].astype(np.uint32)
        if len(odd):
            place[odd] = _place(index[odd], odd_w)
        out[:, k] = np.minimum.reduceat((place << np.uint32(16)) | (v & np.uint32(0xFFFF)), first)
    return have, out


class Frequencies(NamedTuple):
    """(uid, idf) of texts, the idf of each of a text's shingles in the order of their hashes, a byte of 1 / STEPS each; and the
    number of documents. Texts without shingles may have no row."""

    table: DataFrame
    n: int


class Own:
    """Weights of the shingles of some texts, from the bytes beside them."""

    def __init__(self, given: list[bytes | None]):
        self.steps = np.frombuffer(b"".join(x or b"" for x in given), np.uint8)

    def of(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        if len(self.steps) != len(h):
            raise ValueError(f"{len(self.steps)} weights for {len(h)} shingles")
        return self.steps / STEPS * tf


def document_frequencies(rows: DataFrame) -> Frequencies:
    """Weights of all shingles of rows (uid, text), uid unique, by their exact frequencies.

    A chunk of texts sends one row to each shard: the hashes, of 6 bytes, and from which text each is, as its distance
    from the text before. Shards are ranges of hashes, so a text's answers follow each other as its hashes do. Shards grow in number
    with the texts, not in size; a shingle of all documents is 6 bytes for each of them in its shard.
    """
    spark = rows.sparkSession
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    n_docs = total["n"]
    shards = min(max(partitions(spark), -(-(total["bytes"] or 0) // SHARD_BYTES)), 1 << 16)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = size = 0

        def told() -> pa.RecordBatch:
            uid, owner, h = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = ((h * np.uint64(shards)) >> np.uint64(48)).astype(np.uint16)
            order = np.argsort(shard, kind="stable")
            shard, owner, h = shard[order], owner[order], h[order]
            packed = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].reshape(-1)
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), shard[1:] != shard[:-1]]))
            ends = np.append(first, len(h))
            step = np.diff(owner, prepend=0)
            step[first] = owner[first]
            uids = [None if k else uid.astype(np.int64).tobytes() for k in range(len(first))]
            return pa.RecordBatch.from_arrays(
                [pa.array(shard[first].astype(np.int32)), pa.array(np.full(len(first), uid[0], np.int64)), pa.array(uids, pa.binary()), cut_bytes(step.astype(np.uint16), 2 * ends), cut_bytes(packed, 6 * ends)],
                names=["shard", "chunk", "uids", "steps", "hashes"],
            )

        for b in batches:
            uid = np.asarray(b.column(0), np.int64)
            for i, j, row, h, _ in shingle_sets(b.column(1), SHINGLE):
                held.append((uid[i:j], row + n, h))
                n, size = n + j - i, size + len(h)
                if n >= COUNT_TEXTS or size >= COUNT_SIZE:
                    yield told()
                    held.clear()
                    n = size = 0
        if held:
            yield told()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = [b for b in batches if b.num_rows]  # a shard: about SHARD_BYTES of text
        if not rows_:
            return
        size = [pc.binary_length(b.column(4)).to_numpy() // 6 for b in rows_]
        ends = np.cumsum([0, *map(np.sum, size)])
        wide = np.zeros((ends[-1], 8), np.uint8)
        for b, i, j in zip(rows_, ends, ends[1:]):
            wide[i:j, :6] = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, 6)
        h = wide.view("<u8").reshape(-1)
        order = np.argsort(h)
        h = h[order]
        df = np.diff(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])))
        steps = np.empty(len(h), np.uint8)
        steps[order] = np.repeat(np.rint(idf(df, n_docs) * STEPS).astype(np.uint8), df)
        del h, wide, order
        for b, n, i, j in zip(rows_, size, ends, ends[1:]):
            yield pa.RecordBatch.from_arrays([*b.columns[:4], cut_bytes(steps[i:j], np.cumsum([0, *n]))], names=["shard", "chunk", "uids", "steps", "idf"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, ["chunk"]):
            uid = np.frombuffer(next(x for x in t["uids"].to_pylist() if x is not None), np.int64)
            owner = np.concatenate([np.cumsum(np.frombuffer(x, np.uint16), dtype=np.int32) for x in t["steps"].to_pylist()])
            found = np.frombuffer(b"".join(t["idf"].to_pylist()), np.uint8)[np.argsort(owner, kind="stable")]
            ends = np.cumsum([0, *np.bincount(owner, minlength=len(uid))])
            yield pa.RecordBatch.from_arrays([pa.array(uid), cut_bytes(found, ends)], names=["uid", "idf"])

    head = "shard int, chunk long, uids binary, steps binary"
    asked = rows.select("uid", "text").mapInArrow(tidy(ask), f"{head}, hashes binary")
    told = asked.repartitionById(shards, F.col("shard")).mapInArrow(tidy(answer), f"{head}, idf binary")  # each partition one shard
    dealt = told.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "shard")
    return Frequencies(write_table(dealt.mapInArrow(tidy(together), "uid long, idf binary"), "frequencies")[0], n_docs)


def frequent_shingles(rows: DataFrame) -> Weights:
    """Shingles of more than ``FREQUENT`` of the documents, with their exact frequencies, in the driver: for comparisons on small tables."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, h, _ in shingle_sets(b.column(0), SHINGLE):
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64))], names=["h"])

    n = rows.count()
    got = rows.select("text").mapInArrow(tidy(each), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FREQUENT * n).collect()
    return Weights(np.array([r["h"] for r in got], np.int64), np.array([r["n"] for r in got], np.float64), n)


def _signatures(rows: DataFrame, weights: Frequencies) -> DataFrame:
    """(uid, text_key, bands, sig): a 128-bit key of the text, band hashes (null without words), short samples."""
    mult = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(ROWS)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            col = b.column(1)
            given = b.column(2).to_pylist()
            data, offsets = as_bytes(col)
            keys = [hashlib.blake2b(memoryview(data[offsets[i] : offsets[i + 1]]), digest_size=16).digest() for i in range(len(col))]
            for i, j, row, h, tf in shingle_sets(col, SHINGLE):
                have, got = samples(row, h, Own(given[i:j]).of(h, tf), j - i)
                band = (got.reshape(len(have), BANDS, ROWS).astype(np.uint64) * mult).sum(2, dtype=np.uint64)
                band ^= band >> np.uint64(29)
                band *= np.uint64(0xBF58476D1CE4E5B9)
                short = (got ^ (got >> np.uint32(16))).astype(np.uint16)
                bands: list = [None] * (j - i)
                sigs: list = [None] * (j - i)
                for k, r in enumerate(have):
                    bands[r], sigs[r] = band[k].astype(np.int64), short[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(keys[i:j], pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    names=["uid", "text_key", "bands", "sig"],
                )

    weighed = rows.select("uid", "text").join(weights.table.hint("shuffle_hash"), "uid", "left")
    return weighed.select("uid", "text", "idf").mapInArrow(tidy(run), "uid long, text_key binary, bands array<long>, sig binary")


def forest(sig: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of rows: a maximum spanning forest of the estimates from ``least``. It holds each row's best partner."""
    n = len(sig)
    best, source = np.full(n, -1.0), np.zeros(n, np.int64)
    done = np.zeros(n, bool)
    out = []
    u = 0
    for _ in range(n):
        done[u] = True
        like = (sig == sig[u]).mean(1)
        closer = ~done & (like > best)
        best[closer], source[closer] = like[closer], u
        masked = np.where(done, -2.0, best)
        v = int(masked.argmax())
        if masked[v] >= least:
            out.append((min(v, int(source[v])), max(v, int(source[v]))))
        u = v
    return out


def _bucket_pairs(members: DataFrame, least: float) -> DataFrame:
    """(a, b) pairs of uids to verify, from rows (band, key, chunk, uid, sig) dealt and sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(t: pa.Table, closed: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            key = np.stack([np.asarray(t[c], np.int64) for c in ("band", "key", "chunk")], 1)
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(1)])
            first = np.append(np.flatnonzero(new), len(key))
            end = len(first) - 1 if closed else len(first) - 2
            uid = np.asarray(t["uid"], np.int64)
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(len(uid), SAMPLES)
            sizes = np.diff(first)[:end]
            a, b = [], []
            two = first[:end][sizes == 2]
            if len(two):
                near = (sig[two] == sig[two + 1]).mean(1) >= least
                a.append(uid[two[near]])
                b.append(uid[two[near] + 1])
            for g in np.flatnonzero(sizes > 2):
                at = first[g]
                found = forest(sig[at : at + sizes[g]], least)
                if found:
                    x = np.array(found) + at
                    a.append(uid[x[:, 0]])
                    b.append(uid[x[:, 1]])
            a_, b_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            low, high = np.minimum(a_, b_), np.maximum(a_, b_)
            rest = None if closed else t.slice(int(first[end]))
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"]), rest

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if held.num_rows:
                out, held = pairs(held, False)
                yield out
        if held is not None and held.num_rows:
            yield pairs(held, True)[0]

    key = ["band", "key", "chunk"]
    dealt = members.repartition(partitions(members.sparkSession), *key).sortWithinPartitions(*key, "uid")
    return dealt.select(*key, "uid", "sig").mapInArrow(tidy(run), "a long, b long")


def _parted(large: DataFrame) -> DataFrame:
    """Rows of large buckets, ``TURNS`` times, in buckets that also agree in one sample from outside the band."""
    turned = large.withColumn("turn", F.explode(F.array(*[F.lit(t) for t in range(TURNS)])))
    at = F.pmod((F.col("band") + 1) * ROWS + F.col("turn"), F.lit(SAMPLES))
    rows = turned.select("band", F.xxhash64("key", "turn", F.substring("sig", 2 * at + 1, F.lit(2))).alias("key"), "uid", "sig")
    sizes, _ = write_table(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    return join_hot(rows, sizes, ["band", "key"], "n").select("band", "key", "uid", "sig", "n")


def candidate_pairs(texts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b) to verify, and the buckets' rows (band, key, uid, sig, n), from (uid, bands, sig) of different texts."""
    least = similarity - MARGIN
    spread = texts.filter("bands is not null").select("uid", F.posexplode("bands").alias("band", "key"))
    sizes, _ = write_table(spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    shared = join_hot(spread, sizes, ["band", "key"], "n")  # samples join those that are in a bucket only
    members, _ = write_table(shared.join(texts.select("uid", "sig"), "uid").select("band", "key", "uid", "sig", "n"), "buckets")
    buckets, found, whole = members, [], True
    while True:
        chunks = F.ceil(F.col("n") / CHUNK_ROWS)
        cut = members.withColumn("chunk", F.when(F.col("n") <= CHUNK_ROWS, F.lit(0)).otherwise(F.pmod(F.xxhash64("uid", "band"), chunks)).cast("int"))
        found.append(_bucket_pairs(cut, least))
        large = cut.filter(F.col("n") > CHUNK_ROWS)
        if not large.take(1):
            break
        heads = large.groupBy("band", "key", "chunk").agg(F.min_by("sig", "uid").alias("sig"), F.min("uid").alias("uid"))
        counts = heads.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        again = heads.join(counts, ["band", "key"]).select("band", "key", "uid", "sig", "n")
        members, _ = write_table(again.unionByName(_parted(large)) if whole else again, "buckets")
        whole = False
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    return write_table(pairs.distinct(), "pairs")[0], buckets


class Sets:
    """The weighted sets of some texts, and the exact similarity of one of them with all the others at once."""

    def __init__(self, texts: list[str], weights: Weights | list[Own]):
        each = weights if isinstance(weights, list) else [weights] * len(texts)
        self.sets = [weighted_set(t, w) for t, w in zip(texts, each, strict=True)]
        self.total = np.array([w.sum() for _, w in self.sets])
        self.first: np.ndarray | None = None

    def _index(self) -> None:
        h = np.concatenate([x for x, _ in self.sets])
        owner = np.repeat(np.arange(len(self.sets)), [len(x) for x, _ in self.sets])
        order = np.argsort(h, kind="stable")
        self.owner, self.weight = owner[order], np.concatenate([w for _, w in self.sets])[order]
        h = h[order]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
        self.keys, self.first = h[start], np.append(start, len(h))

    def like_all(self, u: int) -> np.ndarray:
        """Weighted Jaccard similarity of set u with every set, by way of the sets that hold each of its shingles."""
        if self.first is None:
            self._index()
        h, w = self.sets[u]
        at = np.searchsorted(self.keys, h)
        a, n = self.first[at], self.first[at + 1] - self.first[at]
        place = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        least = np.bincount(self.owner[place], np.minimum(np.repeat(w, n), self.weight[place]), len(self.sets))
        total = self.total + self.total[u] - least
        return np.where(total > 0, least / np.where(total > 0, total, 1), 0.0)

    def like(self, u: int, v: int) -> float:
        return weighted_jaccard(self.sets[u], self.sets[v])


#: Candidates of a text from which on it is compared with all texts of the block at once.
MANY = 24


def join_apart(sig: np.ndarray, own: np.ndarray, ask: np.ndarray, sets: Sets, least: float, similarity: float) -> list[tuple[int, int]]:
    """Links (rows) that join components ``own``: of each row of ``ask`` with the others, every pair from the
    estimate ``least`` on is verified unless links of this block have joined the two already."""
    out: list[tuple[int, int]] = []
    now = np.unique(own, return_inverse=True)[1]
    others = np.flatnonzero(~ask)
    sig_ = sig[others]
    for u in np.flatnonzero(ask):
        like = (sig_ == sig[u]).mean(1)
        near = np.flatnonzero((like >= least) & (now[others] != now[u]))
        if not len(near):
            continue
        near = others[near[np.argsort(-like[near], kind="stable")]]
        exact = sets.like_all(u) if len(near) >= MANY else None
        for v in near:
            if now[v] != now[u] and (exact[v] if exact is not None else sets.like(u, v)) >= similarity:
                out.append((int(u), int(v)))
                now[now == now[v]] = now[u]
    return out


def _open_links(members: DataFrame, met: DataFrame, texts: DataFrame, rows: DataFrame, roots: DataFrame, weights: Frequencies, similarity: float) -> DataFrame | None:
    """Links between components whose texts met without being linked, or None if there are none such.

    Components that met make groups. In each group the texts outside its largest component ask. They
    are dealt to chunks, as all texts of the group are, and each chunk of one kind meets each of the other
    in a block, with their texts: the pairs of a block stay in its task.
    """
    spark = rows.sparkSession
    big = members.filter(F.col("n") > CHUNK_ROWS)
    heads = big.groupBy("band", "key").agg(F.min("uid").alias("b"))
    met = met.select("a", "b").unionByName(big.join(heads, ["band", "key"]).select(F.col("uid").alias("a"), "b")).distinct()
    for side in ("a", "b"):
        met = met.join(roots.select(F.col("uid").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(side, F.coalesce(f"root_{side}", side)).drop(f"root_{side}")
    apart, _ = write_table(met.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "apart")
    if not apart.take(1):
        return None
    grouped = components(apart).select(F.col("uid").alias("own"), F.col("root").alias("grp"))
    groups = grouped.unionByName(grouped.select(F.col("grp").alias("own"), "grp").distinct())  # a root has no row of its own
    owned = texts.select("uid", "sig").join(roots, "uid", "left").withColumn("own", F.coalesce("root", "uid")).drop("root")
    counted = owned.groupBy("own").agg(F.count(F.lit(1)).alias("texts"))
    groups, _ = write_table(groups.join(counted, "own"), "groups")
    inside = join_hot(owned, groups, ["own"], "texts").select("uid", "sig", "own", "grp")
    inside, _ = write_table(with_texts(inside, rows, weights), "inside")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = inside.groupBy("grp", "own").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    each = sizes.groupBy("grp").agg(F.max(F.struct("n", "own", "bytes")).alias("large"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def chunks(n, size_):
        return F.ceil(F.greatest(n / CHUNK_ROWS, size_ / CHUNK_BYTES, F.lit(1.0))).cast("int")

    plan = each.select("grp", F.col("large.own").alias("large"), chunks(F.col("n"), F.col("bytes")).alias("all_chunks"), chunks(F.col("n") - F.col("large.n"), F.col("bytes") - F.col("large.bytes")).alias("ask_chunks"), "n")
    plan, _ = write_table(plan, "open")
    dealt = join_hot(inside, plan, ["grp"], "n")

    def of(count: str):
        return F.pmod(F.xxhash64("uid"), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    key = ["grp", "asked", "chunk"]
    columns = ["grp", "uid", "own", "sig", "text", "idf"]
    asking = dealt.filter("own <> large").select(*columns, F.lit(1).alias("ask"), of("ask_chunks").alias("asked"), every("all_chunks").alias("chunk"))
    others = dealt.select(*columns, F.lit(0).alias("ask"), of("all_chunks").alias("chunk"), every("ask_chunks").alias("asked"))
    blocks = asking.unionByName(others).repartition(partitions(spark), *key).sortWithinPartitions(*key, "uid")
    least = similarity - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, key):
            uid, own = (np.asarray(t[c], np.int64) for c in ("uid", "own"))
            ask = np.asarray(t["ask"], np.int64) == 1
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(len(uid), SAMPLES)
            sets = Sets([x or "" for x in t["text"].to_pylist()], [Own([x]) for x in t["idf"].to_pylist()])
            found = join_apart(sig, own, ask, sets, least, similarity)
            if found:
                x = uid[np.array(found)]
                yield pa.RecordBatch.from_arrays([pa.array(x.min(1)), pa.array(x.max(1))], names=["a", "b"])

    return blocks.select(*key, "uid", "own", "ask", "sig", "text", "idf").mapInArrow(tidy(run), "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as a table, from batches sorted by key."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        values = np.stack([np.asarray(t[c], np.int64) for c in key], 1)
        first = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist()]
        for i, j in zip(first, first[1:]):
            yield t.slice(i, j - i)
        held = t.slice(first[-1])
    if held is not None:
        yield held


def settled(pairs: DataFrame, members: DataFrame, texts: DataFrame, rows: DataFrame, weights: Frequencies, similarity: float) -> DataFrame:
    """(uid, root) of every linked uid, when no pair that met joins two components without having been refuted."""
    links, _ = write_table(verified(pairs, rows, weights, similarity), "links")
    roots = components(links)
    more = _open_links(members, pairs, texts, rows, roots, weights, similarity)
    if more is None:
        return roots
    more, _ = write_table(more, "links")
    if not more.take(1):
        return roots
    stars = roots.select(F.col("uid").alias("a"), F.col("root").alias("b"))
    return components(stars.unionByName(more))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of greatest weights; sets are sorted hashes with weights."""
    at = np.searchsorted(b[0], a[0])
    at_ = np.minimum(at, max(len(b[0]) - 1, 0))
    hit = (b[0][at_] == a[0]) if len(b[0]) else np.zeros(len(a[0]), bool)
    least = np.minimum(a[1][hit], b[1][at_[hit]]).sum()
    total = a[1].sum() + b[1].sum() - least
    return float(least / total) if total else 0.0


def weighted_set(text: str, weights: Weights | Own) -> tuple[np.ndarray, np.ndarray]:
    for _, _, _, h, tf in shingle_sets(pa.array([text], pa.string()), SHINGLE):
        return h, weights.of(h, tf)
    return np.zeros(0, np.uint64), np.zeros(0)


def with_texts(ids: DataFrame, rows: DataFrame, weights: Frequencies) -> DataFrame:
    """ids (uid, ...) with the text of each and its shingles' weights. Texts that are not asked for are not shuffled where the ids are few."""
    few = ids.select("uid")
    texts, counts = rows.select("uid", "text"), weights.table
    if ids.count() <= SENT_IDS:  # 8 bytes each: beyond that, a shuffle
        texts, counts = (x.join(F.broadcast(few), "uid", "left_semi") for x in (texts, counts))
    return ids.join(texts, "uid").join(counts.hint("shuffle_hash"), "uid", "left")


def verified(pairs: DataFrame, rows: DataFrame, weights: Frequencies, similarity: float) -> DataFrame:
    """Links (a, b, similarity) among pairs. A text in many pairs is dealt with salt on its side."""
    ids = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    texts = with_texts(ids, rows, weights)
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    salt = (F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / 500))).cast("int")
    salted = pairs.join(degree, "a").select("a", "b", salt.alias("salt"))
    other = salted.join(texts.withColumnsRenamed({"uid": "b", "text": "text_b", "idf": "idf_b"}), "b")
    heads = salted.select("a", "salt").distinct().join(texts.withColumnsRenamed({"uid": "a", "text": "text_a", "idf": "idf_a"}), "a")
    both = other.join(heads, ["a", "salt"]).select("a", "b", "text_a", "text_b", "idf_a", "idf_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            out: tuple = ([], [], [])
            for a, b, x, y, p, q in zip(*(batch.column(i) for i in range(6)), strict=True):
                if a.as_py() != last:
                    last, own = a.as_py(), weighted_set(x.as_py() or "", Own([p.as_py()]))
                s = weighted_jaccard(own, weighted_set(y.as_py() or "", Own([q.as_py()])))
                if s >= similarity:
                    for o, v in zip(out, (last, b.as_py(), s), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["a", "b", "similarity"])

    return both.mapInArrow(tidy(run), "a long, b long, similarity double")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, root) of links (u, v): each joins two trees, whose root is the least uid."""
    root: dict[int, int] = {}

    def of(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            low, high = sorted((of(u), of(v)))
            root[high] = low
    found = [(x, r) for x in list(root) if (r := of(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["uid", "root"])


def components(links: DataFrame) -> DataFrame:
    """(uid, root) of every linked uid but the roots themselves; root is the least uid connected to it.

    Alternating large and small stars: each round hangs neighbours on the least one, first the larger,
    then the smaller neighbours of each uid. Rounds are tables in the shared folder, so that no plan
    grows and lost executors cost one round. Up to ``FEW_EDGES`` links are united in one task instead of
    some ten jobs, with the same result.
    """
    spark = links.sparkSession
    edges, path = write_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    if edges.count() <= FEW_EDGES:
        return write_table(edges.coalesce(1).mapInArrow(tidy(_united), "uid long, root long"), "stars")[0]
    told = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = write_table(small, "stars")
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_table(spark, path)
        edges, path = new, new_path
        if now == told:
            return edges.select(F.col("u").alias("uid"), F.col("v").alias("root"))
        told = now


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(uid, class_uid, copies) for rows (uid, text): class_uid is the least uid of the class."""
    rows = docs.select("uid", "text")
    weights = document_frequencies(rows)
    signed, _ = write_table(_signatures(rows, weights), "signatures")
    reps = signed.groupBy("text_key").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps, _ = write_table(reps, "texts")
    texts = signed.join(reps.select(F.col("rep").alias("uid")), "uid", "left_semi")
    pairs, members = candidate_pairs(texts, similarity)
    roots = settled(pairs, members, texts, rows, weights, similarity).withColumnsRenamed({"uid": "rep", "root": "class_uid"})
    named, _ = write_table(reps.join(roots, "rep", "left").select("text_key", F.coalesce("class_uid", "rep").alias("class_uid"), "copies"), "named")
    return join_hot(signed.select("uid", "text_key"), named, ["text_key"], "copies").select("uid", "class_uid", "copies")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size, n_copies) of every row: the class's first id, its rows, rows with equal text."""
    rows = with_uid(pick(docs, doc_id="doc_id", text="text"))
    found, _ = write_table(classes(rows, similarity), "classes")
    ids = rows.select("uid", "doc_id")
    size = found.groupBy("class_uid").agg(F.count(F.lit(1)).alias("class_size"))
    named = found.join(ids, "uid")
    head, _ = write_table(ids.select(F.col("uid").alias("class_uid"), F.col("doc_id").alias("class_id")).join(size, "class_uid"), "heads")
    return join_hot(named, head, ["class_uid"], "class_size").select("doc_id", "class_id", "class_size", F.col("copies").alias("n_copies"))


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The first document of each class, with all its columns."""
    docs, back = shelter(docs, "uid")
    rows = with_uid(docs)
    kept = classes(rows, similarity).filter("uid = class_uid").select("uid")
    return rows.join(kept, "uid", "left_semi").drop("uid").withColumnsRenamed(back)
