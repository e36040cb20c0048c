"""Removal of repeated byte strings, by a sparse suffix array.

A byte goes if a ``length``-byte string that covers it starts earlier too (smaller document, or same
document and earlier start). Strings are judged on the input; matches never cross documents.

Which suffixes are sorted: every ``length``-byte window picks an anchor in it, the leftmost of the
``GRAM``-byte strings with the least hash. Equal windows pick the same one, so a window's copies are
found among copies of its anchor, and one suffix for each anchor (about every 25th byte) stands for all
windows that picked it. Anchors meet by gram first. Of those with equal surroundings (hashes of all
bytes of their windows) the first stands for all, the windows of the others being later copies; a gram
with one kind of surroundings is done. Only the suffixes of grams with several, with the bytes before
them, go to buckets to be sorted.

How they are sorted: deep-shallow. Multikey quicksort on eight bytes at a time orders the suffixes to a
shallow depth; groups that still agree have a long common prefix and are ordered by blind tries. The
bytes before the anchors are sorted in the same way from right to left. A window that begins o bytes
before its anchor is then an interval of each array, where common prefixes reach length - o to the
right and o to the left; the pair of intervals names the window's string, and its first place is kept.

Skew: equal surroundings within a task are settled at once, only their first goes on, so that a gram of
a passage in very many documents gets at most one entry of each kind from each task. Grams with more
than a HOTth of the suffixes (there can be no more than HOT of these, so they are broadcast) are dealt
by the whole window's string instead, each window once from a task.

Null counts as empty. Texts shorter than ``length`` lose nothing. Rows with repeated or null ids are
documents of their own, in the order of id (null last), then text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblens.llm.common import CHUNK, as_bytes, byte_sums, mix64, pick, powers, row_chunks, with_uid
from biblens.runtime import partitions, write_table

LENGTH, GRAM = 100, 50
HOT = 20_000
#: Eight-byte steps of the shallow sort; groups that agree so far are the tries' work.
SHALLOW = 8
#: Suffixes that a reducer sorts at once (more where one gram has more).
SLICE = 30_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    extra = width - have
    return np.minimum(out[: len(out) - extra], out[extra:]) if extra else out


def _stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends], from ``byte_sums`` of data."""
    return mix64((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, last window, gram hash, hash of all bytes of the windows and of where
    the anchor is among them); places are relative to ``data``."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if len(data) < length:
        return empty
    sums = byte_sums(data)
    n = len(data) - gram + 1
    h = mix64((sums[gram:] - sums[:n]) * powers(n)[1])
    low = np.uint64((1 << 24) - 1)
    picked = _sliding_min((h & ~low) | (np.arange(len(h), dtype=np.uint64) & low), length - gram + 1) & low
    n = len(picked)  # one for each window start
    valid = np.zeros(n + 1, np.int64)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= length:
            valid[a] += 1
            valid[b - length + 1] -= 1
    valid = np.cumsum(valid[:-1]) > 0
    at = np.flatnonzero(valid)
    if not len(at):
        return empty
    base = at.astype(np.int64)
    # only the low bits of the place are in the key; a window's anchor is less than ``length`` after its start
    place = base + ((picked[at].astype(np.int64) - base) & int(low))
    row = np.searchsorted(offsets, at, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(new[1:], len(at)) - 1
    row, place, begin, end = row[new], place[new], base[new], base[last]
    around = _stretch_hashes(sums, begin, end + length) + (place - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return row, place, begin, end, h[place], mix64(around)


def _pieces(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows' offsets in piece, bytes, start of the piece in its row). Very long rows are cut
    into pieces that overlap by all but one byte of a window, so that every window is in one piece."""
    data, offsets = as_bytes(col)
    for i, j in row_chunks(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if j == i + 1 and b - a > 4 * CHUNK:
            for s in range(a, b, 2 * CHUNK):
                e = min(b, s + 2 * CHUNK + LENGTH - 1)
                yield i, np.array([0, e - s]), data[s:e], s - a
        else:
            yield i, offsets[i : j + 1] - a, data[a:b], 0


def _anchor_rows(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob): each task's anchors by the bucket of their gram. Of anchors with the same
    surroundings the first goes there; the others are later copies for sure and travel at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            uid = np.asarray(b.column(0), np.int64)
            for i, own, data, shift in _pieces(b.column(1)):
                row, place, first, last, gram, around = anchors(data, own)
                held.append([uid[i + row], (place - own[row] + shift).astype(np.uint32), (place - last).astype(np.uint8), (place - first).astype(np.uint8), gram, around])
        if not held:
            return
        u, p, lo, hi, g, c = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        if not len(u):
            return
        by = np.lexsort((p, u, c))  # equal surroundings have equal grams
        head = np.concatenate([[True], c[by][1:] != c[by][:-1]])
        bucket = np.empty(len(u), np.int32)
        bucket[by] = np.where(head, g[by] % np.uint64(buckets), mix64(u[by].astype(np.uint64) * np.uint64(31) + p[by]) % np.uint64(buckets))
        flag = np.empty(len(u), bool)
        flag[by] = head
        order = np.lexsort((p, u, bucket))
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cut)):
            at = order[cut[k] : cut[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([_pack(u[at], p[at], lo[at], hi[at], g[at], c[at], flag[at])], pa.binary())], names=["bucket", "blob"])

    return rows.select("uid", "text").mapInArrow(run, "bucket int, blob binary")


def _pack(u, p, lo, hi, g, c, head) -> bytes:
    """Anchors in order of document and place: each id once with its number of anchors, and the upper 48
    bits of the hashes of first copies (the bucket adds some of a gram's other bits)."""
    uid, n = np.unique(u, return_counts=True)
    high = [np.ascontiguousarray(x[head]).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for x in (g, c)]
    sizes = np.array([len(u), len(uid), int(head.sum())], np.int64).tobytes()
    return b"".join([sizes, uid.tobytes(), n.astype(np.int32).tobytes(), p.tobytes(), lo.tobytes(), hi.tobytes(), head.tobytes(), *high])


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    n, m, k = np.frombuffer(raw, np.int64, 3).tolist()
    at = 24
    uid, each = np.frombuffer(raw, np.int64, m, at), np.frombuffer(raw, np.int32, m, at + 8 * m)
    at += 12 * m
    p = np.frombuffer(raw, np.uint32, n, at).astype(np.int64)
    lo, hi = np.frombuffer(raw, np.uint8, n, at + 4 * n).astype(np.int64), np.frombuffer(raw, np.uint8, n, at + 5 * n).astype(np.int64)
    head = np.frombuffer(raw, bool, n, at + 6 * n)
    at += 7 * n
    hashes = []
    for j in range(2):
        wide, out = np.zeros((k, 8), np.uint8), np.zeros(n, np.int64)
        wide[:, 2:] = np.frombuffer(raw, np.uint8, 6 * k, at + 6 * k * j).reshape(k, 6)
        out[head] = wide.view(np.int64)[:, 0]
        hashes.append(out)
    return np.repeat(uid, each), p, lo, hi, *hashes, head


def _compare(table: pa.Table) -> pa.Table:
    """One bucket's anchors: later copies of equal surroundings as stretches (place null), and the first
    ones whose gram has other surroundings too, with how many."""
    u, p, lo, hi, g, c, head = (np.concatenate(x) for x in zip(*(_unpack(x.as_py()) for x in table["blob"]), strict=True))
    at = np.flatnonzero(head)
    at = at[np.lexsort((p[at], u[at], c[at], g[at]))]
    gs, cs = g[at], c[at]
    new_g = np.concatenate([np.ones(min(1, len(at)), bool), gs[1:] != gs[:-1]])
    first = new_g | np.concatenate([np.ones(min(1, len(at)), bool), cs[1:] != cs[:-1]])
    group = np.cumsum(new_g) - 1
    kinds = np.bincount(group[first], minlength=int(new_g.sum()))[group] if len(at) else np.zeros(0, np.int64)
    ship = first & (kinds > 1)
    sure = np.concatenate([at[~first], np.flatnonzero(~head)])
    index = np.concatenate([at[ship], sure])
    some = np.arange(len(index)) >= int(ship.sum())  # the sure ones
    n = np.concatenate([kinds[ship], np.zeros(len(sure), np.int64)])
    return pa.table(
        {
            "uid": u[index],
            "start": pa.array((p - hi)[index].astype(np.int32)),
            "end": pa.array((p - lo)[index].astype(np.int32) + np.int32(LENGTH)),
            "place": pa.array(p[index].astype(np.int32), mask=some),
            "gram": pa.array(g[index], mask=some),
            "n": pa.array(n.astype(np.int32), mask=some),
        }
    )


def compared_anchors(rows: DataFrame) -> DataFrame:
    """(uid, start, end, place, gram, n): a table of what ``_compare`` finds in all buckets."""
    dealt = _anchor_rows(rows, 4 * partitions(rows.sparkSession)).groupBy("bucket")
    return write_table(dealt.applyInArrow(_compare, "uid long, start int, end int, place int, gram long, n int"), "anchors")[0]


def multikey_quicksort(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of eight-byte characters by their first ``depth``, and where groups that agree start.

    Three-way partitions around a pivot: less and greater go on with the same character, equal with the
    next. Small parts that are left are ordered by one sort of the remaining characters.
    """
    order = np.arange(len(keys))
    todo = [(0, len(keys), 0)]
    new = np.zeros(len(keys), bool)
    new[:1] = True
    while todo:
        a, b, d = todo.pop()
        if b - a <= 1 or d >= depth:
            continue
        part = order[a:b]
        if b - a <= 4096:
            rest = keys[part, d:depth]
            by = np.lexsort(rest.T[::-1])
            order[a:b] = part[by]
            rest = rest[by]
            new[a + 1 : b] |= (rest[1:] != rest[:-1]).any(1)
            continue
        c = keys[part, d]
        pivot = np.partition(c[:: max(1, len(c) // 64)], len(c[:: max(1, len(c) // 64)]) // 2)[len(c[:: max(1, len(c) // 64)]) // 2]
        less, more = c < pivot, c > pivot
        same = ~(less | more)
        order[a:b] = np.concatenate([part[less], part[same], part[more]])
        x, y = a + int(less.sum()), b - int(more.sum())
        for edge in (x, y):
            if a < edge < b:
                new[edge] = True
        todo += [(a, x, d), (x, y, d + 1), (y, b, d)]
    return order, new


def _lcp(a: int, b: int, size: int) -> int:
    """Common prefix of two strings of ``size`` bytes, given as big-endian numbers."""
    x = a ^ b
    return size if x == 0 else size - (x.bit_length() + 7) // 8


def blind_trie(rows: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of equally long strings, and the common prefix of each with the one before (0 for the first).

    A node holds only a depth and its children by the byte there. A string goes down by single bytes
    without comparing, is compared with one leaf it arrives at, and branches off where they differ.
    """
    size = len(rows[0])
    number = [int.from_bytes(r, "big") for r in rows]
    root: list = [size, None, [0]]  # depth, children or None, leaves
    for i in range(1, len(rows)):
        s = rows[i]
        node = root
        while node[1] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[2][0]
        depth = _lcp(number[i], number[other], size)
        if depth == size:
            node[2].append(i)
            continue
        node = root
        while node[1] is not None and node[0] < depth:
            node = node[1][s[node[0]]]
        leaf: list = [size, None, [i]]
        if node[0] == depth and node[1] is not None:
            node[1][s[depth]] = leaf
        else:
            lower = [node[0], node[1], node[2]]
            node[0], node[1], node[2] = depth, {rows[other][depth]: lower, s[depth]: leaf}, None
    order: list[int] = []
    common: list[int] = []
    stack: list[tuple[list, int]] = [(root, 0)]
    while stack:
        node, before = stack.pop()
        if node[1] is None:
            for k, i in enumerate(node[2]):
                order.append(i)
                common.append(before if k == 0 else size)
            continue
        children = [node[1][c] for c in sorted(node[1])]
        for k in range(len(children) - 1, -1, -1):
            stack.append((children[k], before if k == 0 else node[0]))
    return order, common


def suffix_order(strings: np.ndarray, sizes: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Place of each string in sorted order, and common prefix lengths of neighbours in that order.

    ``strings`` are rows of bytes padded with zeros to a multiple of eight; a string sorts before longer
    ones that it is a prefix of, and common prefixes end with the shorter string.
    """
    n, width = strings.shape
    keys = strings.view(">u8").astype(np.uint64)
    depth = min(shallow, keys.shape[1])
    order, new = multikey_quicksort(keys, depth)
    first = np.append(np.flatnonzero(new), n)
    sizes_of = np.diff(first)
    # deep: groups of two are compared at once, larger ones by blind tries
    two = first[:-1][sizes_of == 2]
    if len(two):
        a, b = strings[order[two]], strings[order[two + 1]]
        differ = a != b
        at = differ.argmax(1)
        line = np.arange(len(two))
        swap = differ.any(1) & (a[line, at] > b[line, at])
        swap |= ~differ.any(1) & (sizes[order[two]] > sizes[order[two + 1]])
        x, y = two[swap], two[swap] + 1
        order[x], order[y] = order[y].copy(), order[x].copy()
    for g in np.flatnonzero(sizes_of > 2):
        a, b = int(first[g]), int(first[g + 1])
        part = order[a:b]
        part = part[np.argsort(sizes[part], kind="stable")]  # ties of padded strings keep this order
        raw = strings[part].tobytes()
        got, _ = blind_trie([raw[k * width : (k + 1) * width] for k in range(b - a)])
        order[a:b] = part[got]
    lcp = np.zeros(n, np.int64)
    for a in range(1, n, 1 << 16):
        b = min(n, a + (1 << 16))
        x, y = order[a:b], order[a - 1 : b - 1]
        differ = strings[x] != strings[y]
        common = np.where(differ.any(1), differ.argmax(1), width)
        lcp[a:b] = np.minimum(common, np.minimum(sizes[x], sizes[y]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return place, lcp


def later_windows(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For entries in order of place, a matrix (entry, o): whether the window that begins o bytes before
    the entry's anchor is in an earlier entry too. Only o from low to high count."""
    n = len(low)
    place_r, lcp_r = suffix_order(right, right_size)
    place_l, lcp_l = suffix_order(left, left_size)
    top = int(high.max()) + 1 if n else 0
    out = np.zeros((n, top), bool)
    for o in range(int(low.min()) if n else 0, top):
        at = np.flatnonzero((low <= o) & (o <= high))
        if len(at) < 2:
            continue
        r = np.cumsum(lcp_r < length - o)[place_r[at]]
        s = np.cumsum(lcp_l < o)[place_l[at]]
        name = r * np.int64(n + 1) + s
        _, first = np.unique(name, return_index=True)
        later = np.ones(len(at), bool)
        later[first] = False
        out[at[later], o] = True
    return out


def _padded(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Rows of bytes: sizes[i] from starts[i] on, in direction ``step``, padded with zeros."""
    out = np.zeros((len(starts), width), np.uint8)
    for j in range(int(sizes.max()) if len(sizes) else 0):
        at = np.flatnonzero(sizes > j)
        out[at, j] = data[starts[at] + step * j]
    return out


_WIDE = -(-LENGTH // 8) * 8
_LEFT = -(-(LENGTH - GRAM) // 8) * 8


def _entry_rows(marked: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, blob, uid, start, end): surroundings of the anchors in ``places`` for the buckets; of hot
    grams one for each window, or a stretch where the same task holds the window earlier."""
    sent = marked.sparkSession.sparkContext.broadcast(np.sort(hot))

    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("uid", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # digests of hot windows; rows come by uid
        for b in batches:
            for i, own, data, shift in _pieces(b.column(1)):
                yield from piece(np.asarray(b.column(0), np.int64), b.column(2), i, own, data, shift, seen)

    def piece(ids, places, i, own, data, shift, seen) -> Iterator[pa.RecordBatch]:
        row, at, first, last, gram, _ = anchors(data, own)
        local = at - own[row] + shift
        wanted = np.zeros(len(row), bool)
        cut = np.searchsorted(row, np.arange(len(own)))
        for k in range(len(own) - 1):
            if cut[k + 1] > cut[k]:
                wanted[cut[k] : cut[k + 1]] = np.isin(local[cut[k] : cut[k + 1]], places[i + k].values.to_numpy())
        if not wanted.any():
            return
        row, at, first, last, gram, local = (x[wanted] for x in (row, at, first, last, gram, local))
        is_hot = np.isin((gram & ~np.uint64(0xFFFF)).astype(np.int64), sent.value)
        raw = data.tobytes()
        entry: list[tuple[int, int, int, int, int, bytes]] = []  # key, uid, place, low, high, bytes from place - high on
        sure: list[tuple[int, int, int]] = []
        columns = (ids[i + row], local, at - last, at - first, gram, first, last - first + LENGTH, is_hot)
        for u, p, lo, hi, g, begin, size, heavy in zip(*(c.tolist() for c in columns), strict=True):
            t = raw[begin : begin + size]
            if not heavy:
                entry.append((g, u, p, lo, hi, t))
                continue
            for o in range(hi, lo - 1, -1):  # a window each
                w = t[hi - o : hi - o + LENGTH]
                name = hashlib.blake2b(w, digest_size=16).digest()
                if name in seen:
                    if sure and sure[-1][0] == u and sure[-1][2] >= p - o:
                        sure[-1] = (u, sure[-1][1], p - o + LENGTH)
                    else:
                        sure.append((u, p - o, p - o + LENGTH))
                else:
                    seen.add(name)
                    entry.append((int.from_bytes(name[:8], "little"), u, p, o, o, w))
        if sure:
            u, s, e = (np.array(x, np.int64) for x in zip(*sure, strict=True))
            keep, ends = [0], []
            reach = e[0]
            for k in range(1, len(u)):  # in order of place: stretches that touch are one
                if u[k] == u[k - 1] and s[k] <= reach:
                    reach = max(reach, e[k])
                else:
                    ends.append(reach)
                    keep.append(k)
                    reach = e[k]
            ends.append(reach)
            n = len(keep)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(u[keep]), pa.array(s[keep]), pa.array(np.array(ends, np.int64))], schema=schema)
        if entry:
            key = np.array([x[0] for x in entry], np.uint64)
            bucket = (mix64(key) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            numbers = np.array([(x[1], x[2], x[3], x[4], len(x[5])) for x in entry], np.int64)
            blobs, full = [], np.flatnonzero(np.diff(cut))
            for k in full:
                some = order[cut[k] : cut[k + 1]]
                blobs.append(len(some).to_bytes(8, "little") + key[some].tobytes() + numbers[some, :2].tobytes() + numbers[some, 2:].astype(np.int16).tobytes() + b"".join([entry[x][5] for x in some]))
            n = len(full)
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)

    return marked.select("uid", "text", "places").mapInArrow(run, "bucket int, blob binary, uid long, start long, end long")


def _settle(table: pa.Table) -> pa.Table:
    """(uid, start, end) of stretches of later windows among one bucket's entries."""
    keys, ids, small, texts = [], [], [], []
    for cell in table["blob"]:
        raw = cell.as_py()
        n = int.from_bytes(raw[:8], "little")
        keys.append(np.frombuffer(raw, np.uint64, n, 8))
        ids.append(np.frombuffer(raw, np.int64, 2 * n, 8 + 8 * n).reshape(n, 2))
        small.append(np.frombuffer(raw, np.int16, 3 * n, 8 + 24 * n).reshape(n, 3).astype(np.int64))
        texts.append(np.frombuffer(raw, np.uint8, offset=8 + 30 * n))
    key, id_, sm, data = np.concatenate(keys), np.concatenate(ids), np.concatenate(small), np.concatenate(texts)
    begin = np.concatenate([[0], np.cumsum(sm[:, 2])])[:-1]
    out: tuple = ([], [], [])
    # only entries whose key another entry has; in slices of whole keys, to bound memory
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    first = np.append(np.flatnonzero(new), len(k))
    size = np.repeat(np.diff(first), np.diff(first))
    order = order[size > 1]
    k = key[order]
    at = 0
    while at < len(order):
        end = min(len(order), at + SLICE)
        if end < len(order):
            end = int(np.searchsorted(k, k[end - 1], "right"))
        part = order[at:end]
        at = end
        part = part[np.lexsort((id_[part, 1], id_[part, 0]))]
        low, high, total = sm[part, 0], sm[part, 1], sm[part, 2]
        middle = begin[part] + high  # the anchor
        left = _padded(data, middle - 1, high, _LEFT, -1)
        right = _padded(data, middle, total - high, _WIDE)
        later = later_windows(left, high, right, total - high, low, high)
        if not later.any():
            continue
        edge = np.diff(np.concatenate([np.zeros((len(part), 1), np.int8), later.astype(np.int8), np.zeros((len(part), 1), np.int8)], 1), axis=1)
        (a_row, a_o), (_, b_o) = np.nonzero(edge == 1), np.nonzero(edge == -1)  # o from a_o to b_o - 1
        place = id_[part[a_row], 1]
        out[0].append(id_[part[a_row], 0])
        out[1].append(place - (b_o - 1))
        out[2].append(place - a_o + LENGTH)
    cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    return pa.table({"uid": cat[0], "start": cat[1], "end": cat[2]})


def later_copies(rows: DataFrame) -> DataFrame:
    """(uid, start, end): stretches of bytes of (uid, text) that strings which start earlier cover."""
    spark = rows.sparkSession
    compared = compared_anchors(rows)
    ship, sure = compared.filter("place is not null"), compared.filter("place is null").select("uid", "start", "end")
    total = ship.count()
    # grams with more than a HOTth of the entries: there can be no more than HOT of these
    heavy = ship.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT > total + 100 * HOT)
    hot = np.array([r["gram"] for r in heavy.select("gram").collect()], np.int64)
    places = ship.groupBy("uid").agg(F.collect_list(F.col("place").cast("long")).alias("places"))
    # in order of uid, so that a task's first windows are the earliest
    marked = rows.join(places, "uid").sortWithinPartitions("uid")
    entries, _ = write_table(_entry_rows(marked, hot, 4 * partitions(spark)), "suffixes")
    settled = entries.filter("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_settle, "uid long, start long, end long")
    more = entries.filter("bucket is null").select("uid", "start", "end")
    found, _ = write_table(settled.unionByName(more).unionByName(sure), "stretches")
    return found


def dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Every row without its repeated bytes.

    With ``digest`` (doc_id, n_bytes, n_removed, n_spans, kept_sha256); else (doc_id, kept binary,
    removed array of struct(start, end)), as what is left need not be valid UTF-8.
    """
    rows = with_uid(pick(docs, doc_id="doc_id", text="text"))
    cut = later_copies(rows.select("uid", "text")).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("cut"))
    joined = rows.join(cut, "uid", "left").select("doc_id", "text", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, removed, spans, kept = [], [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                merged: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in found or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                n_bytes.append(len(raw))
                removed.append(sum(y - x for x, y in merged))
                spans.append(merged)
                at, parts = 0, []
                for x, y in merged:
                    parts.append(raw[at:x])
                    at = y
                kept.append(b"".join([*parts, raw[at:]]) if merged else raw)
            if digest:
                columns = [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                as_rows = [[{"start": x, "end": y} for x, y in s] for s in spans]
                columns = [b.column(0), pa.array(kept, pa.binary()), pa.array(as_rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "kept", "removed"])

    kind = dict(joined.dtypes)["doc_id"]
    if digest:
        return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return joined.mapInArrow(run, f"doc_id {kind}, kept binary, removed array<struct<start:long,end:long>>")


def brute_force(texts: list[str], length: int = LENGTH) -> list[list[bool]]:
    """Which bytes of each text go, by comparing all windows; for tests."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        raw = t.encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        out.append(gone)
    return out
