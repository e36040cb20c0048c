"""What the operators on texts share: batches as bytes, words, shingles and unique row ids."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblens.runtime import partitions, write_table

#: Bytes of text that are worked on at a time; arrays of 8 bytes each stay near the caches.
CHUNK = 1 << 20
#: Documents in a chunk: their number within it takes 16 bits of a sort key.
CHUNK_DOCS = 60_000
#: Keys that are broadcast by ``join_hot`` are fewer.
HOT_KEYS = 1000

M64 = (1 << 64) - 1


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, so that extra ones with clashing names do no harm."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


def shelter(docs: DataFrame, *reserved: str) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns that clash with names used here; the dictionary renames them back."""
    low = {r.lower() for r in reserved}
    away = {c: f"__{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in low}
    return docs.withColumnsRenamed(away), {v: k for k, v in away.items()}


def with_uid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``uid``, a unique long in the order of ``id_col`` (null last), then text.

    Ids are normally unique and then serve themselves. Only where an id is null or repeats are all
    rows numbered in sorted order, into a table, so that each row stays a document of its own.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("k"))
    odd = ids.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or k is null").limit(1)
    if not odd.take(1):
        return docs.withColumn("uid", F.col(id_col).cast("long"))
    n = partitions(docs.sparkSession)
    order = [F.col(id_col).asc_nulls_last(), F.col(text_col).asc_nulls_first()]
    numbered = docs.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return write_table(numbered.withColumn("uid", F.monotonically_increasing_id()), "uid")[0]


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sums of ``value`` in each group, without one task for a large group.

    Rows are dealt by range of (group, order) into numbered slices; a slice needs only the totals of
    the slices before it, of which there are as many as partitions, plus one for each group.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in group + order]
    dealt = df.repartitionByRange(partitions(spark), *keys).withColumn("_slice", F.spark_partition_id())
    dealt, _ = write_table(dealt, "slices")
    totals = dealt.groupBy(*group, "_slice").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*group, "_slice", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ran = dealt.withColumn("_run", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_slice"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = ran.alias("a").join(base.alias("b"), cond)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._run") + F.col("b._base")).alias(out))


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows with a written table of one row for each key, in which ``count`` is its number of rows.

    Keys with more than 1 / HOT_KEYS of the counted rows are fewer than HOT_KEYS, whatever the data:
    they are broadcast, and their rows stay where they are. Only the rows of other keys are shuffled.
    """
    total = table.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot = F.col(count) * HOT_KEYS > total
    few, rest = F.broadcast(table.filter(hot)), table.filter(~hot)
    cold = rows.join(F.broadcast(table.filter(hot).select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(few, keys).unionByName(cold)


def settle() -> None:
    """Give memory that is no longer used back to the system: a worker lives on for other stages, beside its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library that has no such calls
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # blocks from here on are mapped on their own, and unmapped when freed
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after and before which a worker's unused memory goes back."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        try:
            yield from run(batches)
        finally:
            settle()

    return steps


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Batches cut, without copies, into slices: less than ``most`` bytes of a text column beside their first row."""
    for b in batches:
        total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64))
        cut = np.flatnonzero(np.diff(total // most)) + 1
        ends = [*cut.tolist(), b.num_rows]
        for i, j in zip([0, *ends], ends):
            if j > i:
                yield b.slice(i, j - i)


def as_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def cut_bytes(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose row i is data[ends[i]:ends[i + 1]], without copies. A list of memoryviews would do the same, but pyarrow
    (23.0) never releases those: their arrays stay for as long as the worker lives."""
    data, ends = np.ascontiguousarray(data).view(np.uint8), np.asarray(ends)
    if len(data) > np.iinfo(np.int32).max:
        raise ValueError(f"{len(data)} bytes in one binary column")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def row_chunks(offsets: np.ndarray, target: int = CHUNK, most: int = CHUNK_DOCS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``target`` bytes; a longer row is alone in its range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1
        j = min(max(j, i + 1), i + most, n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
_RANDOM = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Bytes of words: ASCII letters, digits, underscore and every byte beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def byte_sums(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] the hash of data[s:e] times base**s; multiply by the inverse power at s."""
    p = np.empty(len(data) + 1, np.uint64)
    p[0] = 0
    np.cumsum(_RANDOM[data] * powers(len(data))[0], out=p[1:])
    return p


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of the table's bytes in each row, and each row's first run.

    ``offsets`` are relative to ``data``; runs never cross rows.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = table[data]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    after[edge[edge > 0] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _word_hashes_once(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offsets)
    p = byte_sums(data)
    return mix64((p[ends] - p[starts]) * powers(len(data) + 1)[1][starts]), first


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and each row's first word. A very long row is cut between words."""
    if len(data) <= 4 * CHUNK or len(offsets) != 2:
        return _word_hashes_once(data, offsets)
    parts, at = [], 0
    while at < len(data):
        end = min(at + 2 * CHUNK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~WORD[data[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        parts.append(_word_hashes_once(data[at:end], np.array([0, end - at]))[0])
        at = end
    out = np.concatenate(parts)
    return out, np.array([0, len(out)])


_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(64)]


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, and each row's first. A row with fewer words is one run."""
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    starts = np.zeros(len(first), np.int64)
    np.cumsum(made, out=starts[1:])
    within = np.arange(starts[-1]) - np.repeat(starts[:-1], made)
    at = np.repeat(first[:-1], made) + within
    end = np.repeat(first[1:], made)
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for j in range(size):
        part = padded[at + j] * _STEP[j]
        if j:
            part[at + j >= end] = 0
        h += part
    return mix64(h), starts


def shingle_sets(col: pa.Array, size: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: (first row, end row, row of each distinct shingle, its 48-bit hash, its count).

    Words are runs of letters, digits and underscores of the lower-cased text.
    """
    data, offsets = as_bytes(pc.utf8_lower(col))
    for i, j in row_chunks(offsets):
        own = offsets[i : j + 1] - offsets[i]
        words, first = word_hashes(data[offsets[i] : offsets[j]], own)
        h, starts = shingle_hashes(words, first, size)
        row = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(starts))
        key = np.sort((row << np.uint64(48)) | (h >> np.uint64(16)))
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        tf = np.diff(np.concatenate([new, [len(key)]]))
        key = key[new]
        yield i, j, (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), tf
