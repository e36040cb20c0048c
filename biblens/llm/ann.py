"""Nearest neighbours by inner product, with vantage-point trees.

Trees work on directions, whose angle is a metric, and on lengths: a subtree whose directions are at
least the angle ``low`` away from the query's, by the triangle inequality, and whose vectors are at
most ``high`` long, holds no inner product above |q| * high * cos(low). It is left out when that is
below the query's k-th best inner product so far. ``factor`` relaxes the bound: angles count as low /
factor, so factor one, the default, is exact, and smaller factors leave out more, whatever the lengths.

Rows are dealt to the nearest of at most ``PIVOTS`` pivots (the vectors with the smallest id hash, one
for about ``SHARD`` rows), and a pivot's rows by hash to shards of about ``SHARD`` rows, so a hot vector
fills many shards. Each shard builds its tree once and the queries stream through it. A query first
searches its own shard; its k-th best there goes along to those other shards whose pivot's bound
reaches it, and the same triangle inequality leaves out the rest. Where there are more shards than tasks, one task
holds a team of them (``TEAM`` at most, and ``HELD`` numbers): a query travels once to a team, with the set of its shards, and
returns with its k best there, so that copies of queries and of answers fall by the size of teams. Only a team that more than
``ASKED`` queries reach is copied, once for so many. Random directions in many dimensions are about
equally far from each other: there an exact search leaves out little, by its nature.

Scores are inner products of the given vectors in double precision; ties go to the smaller vec_id, and
all ties with the k-th count. Lengths are taken after scaling, so they do not overflow; where an inner
product is no number, the pair takes no part.
Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
id. Vectors of another length than a query's are no candidates of it. Rows that share an id are
candidates each, and one query (the smallest vector); none of them is its own neighbour. An empty
table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblens.llm.common import pick
from biblens.runtime import partitions, write_table

K = 20
LEAF = 32
FACTOR = 1.0
#: Rounding that bounds allow for: of angles, and of inner products as a share of both lengths.
ANGLE, SHARE = 1e-7, 1e-12
#: Rows in a shard, pivots that are sent to all tasks at most, and queries that go through one copy of a shard.
SHARD, PIVOTS, ASKED = 4096, 4096, 65_536
#: Shards in a team, and numbers in the vectors of a team, at most.
TEAM, HELD = 32, 1 << 23
#: Queries that a tree answers at a time, and pairs of a query and a shard that are weighed at a time.
BLOCK, PAIRS = 2048, 1 << 20
NO_ID = np.iinfo(np.int64).max


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; lengths beyond the range of doubles are infinite, directions still right."""
    most = np.abs(x).max(1, initial=0)
    most[most == 0] = 1
    scaled = x / most[:, None]
    size = np.sqrt((scaled**2).sum(1))
    unit = scaled / np.where(size > 0, size, 1)[:, None]
    with np.errstate(over="ignore"):
        return unit, size * most


def highest(low: np.ndarray, q_len: np.ndarray, least: float | np.ndarray, most: float | np.ndarray, factor: float) -> np.ndarray:
    """Bound of the inner product with vectors of lengths least to most at an angle of ``low`` or more."""
    cos = np.cos(np.clip(low / factor - ANGLE, 0, np.pi))
    with np.errstate(over="ignore", invalid="ignore"):
        bound = q_len * (np.where(cos > 0, most, least) * cos + SHARE * most)
    return np.where(np.isnan(bound), np.inf, bound)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b, -1, 1))


class Tree:
    """A vantage-point tree over the rows of ``points``."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, seed: int = 11):
        self.ids, self.points, self.leaf = ids, points, leaf
        self.unit, self.length = directions(points)
        self.rng = np.random.Generator(np.random.PCG64(seed))
        #: Pairs of a query and a point that were compared, for tests of the pruning.
        self.compared = 0
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = int(rows[self.rng.integers(len(rows))])
        d = angles(self.unit[rows], self.unit[vantage])
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        sides = []
        for part in (order[:half], order[half:]):
            own = rows[part]
            sides.append((d[part[0]], d[part[-1]], float(self.length[own].min()), float(self.length[own].max()), self._build(own)))
        return vantage, sides

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int = K, factor: float = FACTOR, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), a row of k for each query, best first; NO_ID fills up.

        ``floor`` holds scores that k vectors elsewhere reach: what is below them is not looked for.
        """
        n = len(queries)
        ids, scores = np.full((n, k), NO_ID), np.full((n, k), -np.inf)
        unit, length = directions(queries)
        floor = np.full(n, -np.inf) if floor is None else floor

        def reached(at: np.ndarray) -> np.ndarray:
            return np.maximum(scores[at, -1], floor[at])

        def leaf(rows: np.ndarray, at: np.ndarray) -> None:
            self.compared += len(at) * len(rows)
            points = self.points[rows]
            with np.errstate(over="ignore", invalid="ignore"):
                about = queries[at] @ points.T
                slack = SHARE * length[at] * self.length[rows].max()
                far = about < (reached(at) - np.where(np.isfinite(slack), slack, np.inf))[:, None]
            near = ~far & (q_ids[at][:, None] != self.ids[rows][None, :])
            some = near.any(1)
            if not some.any():
                return
            at, near = at[some], near[some]
            i, j = np.nonzero(near)
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (points[j] * queries[at[i]]).sum(1)
            good = ~np.isnan(exact)
            new_s, new_i = np.full(near.shape, -np.inf), np.full(near.shape, NO_ID)
            new_s[i[good], j[good]], new_i[i[good], j[good]] = exact[good], self.ids[rows][j[good]]
            s, v = np.concatenate([scores[at], new_s], 1), np.concatenate([ids[at], new_i], 1)
            order = np.lexsort((v, -s), axis=-1)[:, :k]
            scores[at], ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)

        def visit(node, at: np.ndarray) -> None:
            if isinstance(node, np.ndarray):
                leaf(node, at)
                return
            vantage, sides = node
            d = angles(unit[at], self.unit[vantage])
            # the side that is nearer to most queries first: whole blocks go down, not a part for each order of sides
            nearer = np.count_nonzero(d <= (sides[0][1] + sides[1][0]) / 2) * 2 >= len(at)
            for i in (0, 1) if nearer else (1, 0):
                lo, hi, least, most, below = sides[i]
                low = np.maximum(np.maximum(lo - d, d - hi), 0)
                kept = at[highest(low, length[at], least, most, factor) >= reached(at)]
                if len(kept):
                    visit(below, kept)

        if n and len(self.points):
            visit(self.root, np.arange(n))
        return ids, scores


def _vectors(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


TEAM_KEY = ["dim", "team", "copy"]


def _best_of_team(trees: dict[int, Tree], shards: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best of each query in those trees whose bit its ``shards`` have; what one tree finds bounds the next."""
    ids, scores = np.full((len(q_ids), k), NO_ID), np.full((len(q_ids), k), -np.inf)
    for slot, tree in trees.items():
        at = np.flatnonzero(shards >> slot & 1)
        if not len(at):
            continue
        new_ids, new_scores = tree.search(q_ids[at], queries[at], k, factor, np.maximum(floor[at], scores[at, -1]))
        s, v = np.concatenate([scores[at], new_scores], 1), np.concatenate([ids[at], new_ids], 1)
        order = np.lexsort((v, -s), axis=-1)[:, :k]
        scores[at], ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)
    return ids, scores


def _answers(rows: DataFrame, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest in each team, from rows (dim, team, copy, asks, slot, vec_id, v, floor).

    Rows of a team come first, by the shard that ``slot`` tells; its queries, whose ``slot`` is a set of shards, come after
    them: trees are built once and queries go through them a block at a time, so a task holds one team and one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        trees: dict[int, Tree] = {}
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([np.asarray(b.column(i), np.int64) for i in range(5)], 1)
            key[:, 4] = np.where(key[:, 3] == 0, key[:, 4], 0)  # a run of queries may ask different shards
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])).tolist()
            for i, j in zip(first, [*first[1:], len(key)], strict=True):
                team, asks, slot = tuple(key[i, :3]), bool(key[i, 3]), int(key[i, 4])
                if team != now:
                    now, held, trees = team, {}, {}
                ids, x = np.asarray(b.column(5).slice(i, j - i), np.int64), _vectors(b.column(6).slice(i, j - i))
                if not asks:
                    held.setdefault(slot, []).append((ids, x))
                    continue
                for of, parts in held.items():
                    trees[of] = Tree(np.concatenate([h[0] for h in parts]), np.concatenate([h[1] for h in parts]))
                held = {}
                shards, floor = np.asarray(b.column(4).slice(i, j - i), np.int64), np.asarray(b.column(7).slice(i, j - i), np.float64)
                for a in range(0, j - i, BLOCK):
                    z = slice(a, a + BLOCK)
                    got, scores = _best_of_team(trees, shards[z], ids[z], x[z], k, factor, floor[z])
                    at, col = np.nonzero(got != NO_ID)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[z][at]), pa.array(got[at, col]), pa.array(scores[at, col])], names=["query_id", "vec_id", "score"])

    dealt = rows.repartition(partitions(rows.sparkSession), *TEAM_KEY).sortWithinPartitions(*TEAM_KEY, "asks", "slot", "vec_id")
    return dealt.select(*TEAM_KEY, F.col("asks").cast("int"), "slot", "vec_id", "v", "floor").mapInArrow(run, "query_id long, vec_id long, score double")


def _near_pivots(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows (vec_id, v, dim) with their pivot (-1 if there is none of their length), the angle to it, and their length."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column(2), np.int64)
            pivot, angle, size = np.full(len(dims), -1, np.int32), np.zeros(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                unit, size[at] = directions(_vectors(b.column(1).take(pa.array(at))))
                if int(dim) in sent.value:
                    for a in range(0, len(at), 1024):
                        cos = unit[a : a + 1024] @ sent.value[int(dim)].T
                        pivot[at[a : a + 1024]] = cos.argmax(1)
                        angle[at[a : a + 1024]] = np.arccos(np.clip(cos.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(angle), pa.array(size)], names=["vec_id", "v", "dim", "pivot", "angle", "size"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, dim int, pivot int, angle double, size double")


def _elsewhere(asks: DataFrame, pivots: dict[int, np.ndarray], cells: list, factor: float, team: int) -> DataFrame:
    """asks (vec_id, v, dim, shard, floor) dealt to every team that may hold something at their floor or above, with the set of its
    shards of which that is true, but for their own."""
    by_dim: dict[int, list] = {}
    for c in cells:
        by_dim.setdefault(c["dim"], []).append((c["pivot"], c["lo"], c["hi"], c["least"], c["most"], c["pieces"], c["base"]))
    table = {d: np.array(rows, np.float64).reshape(-1, 7) for d, rows in by_dim.items()}
    sent = asks.sparkSession.sparkContext.broadcast((pivots, table))

    def reached(x: np.ndarray, c: np.ndarray, near: np.ndarray | None, own: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, team, set of shards), for queries ``x``."""
        unit, length = directions(x)
        low = np.zeros((len(x), len(c)))
        if near is not None:
            real = c[:, 0] >= 0
            d = angles(unit, near[c[real, 0].astype(int)].T)
            low[:, real] = np.maximum(np.maximum(c[real, 1] - d, d - c[real, 2]), 0)
        i, j = np.nonzero(highest(low, length[:, None], c[:, 3], c[:, 4], factor) >= floor[:, None])
        pieces = c[j, 5].astype(int)
        i, shard = np.repeat(i, pieces), np.repeat(c[j, 6].astype(np.int64), pieces) + np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        other = shard != own[i]
        i, shard = i[other], shard[other]
        if not len(i):
            return i, shard, shard
        # cells are in the order of their first shards, so teams of a query come one after another
        first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (shard[1:] // team != shard[:-1] // team)]))
        return i[first], shard[first] // team, np.bitwise_or.reduceat(np.left_shift(np.int64(1), shard % team), first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots_, cells_ = sent.value
        for b in batches:
            dims, own = (np.asarray(b.column(i), np.int64) for i in (2, 3))
            floor = np.asarray(b.column(4), np.float64)
            for dim in np.unique(dims):
                c = cells_[int(dim)]
                c = c[np.argsort(c[:, 6])]
                some = np.flatnonzero(dims == dim)
                step = max(1, PAIRS // max(1, int(c[:, 5].sum())))
                for z in range(0, len(some), step):
                    at = some[z : z + step]
                    query, teams, shards = reached(_vectors(b.column(1).take(pa.array(at))), c, pivots_.get(int(dim)), own[at], floor[at])
                    take = at[query]
                    for a in range(0, len(take), 8192):
                        t, y = pa.array(take[a : a + 8192]), slice(a, a + 8192)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(t), b.column(1).take(t), b.column(2).take(t), pa.array(teams[y]), pa.array(shards[y]), b.column(4).take(t)],
                            names=["vec_id", "v", "dim", "team", "slot", "floor"],
                        )

    return asks.mapInArrow(run, "vec_id long, v array<double>, dim int, team long, slot long, floor double")


def search(vectors: DataFrame, every: int = 20, k: int = K, factor: float = FACTOR, shard: int = SHARD, team: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row whose id is divisible by ``every``.

    ``team`` is the number of shards in a team; without it, as many as give every task of a shuffle one.
    """
    rows = pick(vectors, vec_id="vec_id", embedding="embedding").withColumn("v", F.col("embedding").cast("array<double>"))
    good = "v is not null and vec_id is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    rows = rows.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dim"))
    n = rows.count()
    # at most PIVOTS vectors: what is sent to all tasks has a fixed bound
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id", "v").limit(min(PIVOTS, math.ceil(n / shard))).collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in some}:
        pivots[dim] = directions(np.unique(np.array([r["v"] for r in some if r["dim"] == dim], np.float64), axis=0))[0]
    placed, _ = write_table(_near_pivots(rows, pivots), "vectors")
    cells = placed.groupBy("dim", "pivot").agg(
        F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.min("size").alias("least"), F.max("size").alias("most")
    )
    before = Window.partitionBy("dim").orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)  # a row a pivot
    cells = cells.withColumn("pieces", F.ceil(F.col("n") / shard).cast("int")).withColumn("base", F.coalesce(F.sum("pieces").over(before), F.lit(0)))
    cells, _ = write_table(cells, "cells")
    known = cells.collect()  # a row for each pivot, and for each vector length without one
    if not known:
        return placed.selectExpr("vec_id as query_id", "0 as rank", "vec_id", "size as score")
    spread = math.ceil(sum(c["pieces"] for c in known) / partitions(rows.sparkSession))
    team = max(1, min(team or spread, TEAM, HELD // (shard * max(c["dim"] for c in known))))
    named = placed.join(cells.select("dim", "pivot", "pieces", "base"), ["dim", "pivot"])
    named = named.withColumn("shard", F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("pieces")))
    its_team, its_slot = F.expr(f"shard div {team}").alias("team"), F.expr(f"shard % {team}")
    index = named.select("dim", its_team, its_slot.alias("slot"), "vec_id", "v")
    chosen = named.filter(F.expr(f"vec_id % {every} = 0"))
    asks = chosen.groupBy("vec_id").agg(F.min(F.struct("v", "dim", "shard")).alias("a")).select("vec_id", "a.*")

    def met(asked: DataFrame) -> DataFrame:
        """The teams' rows, once for ``ASKED`` queries, and the queries dealt to the copies."""
        copies = asked.groupBy("dim", "team").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("copies"))
        of = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("copies")).cast("int")
        own = index.join(copies, ["dim", "team"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        theirs = asked.join(copies, ["dim", "team"]).withColumn("copy", of)
        columns = ["dim", "team", "copy", "slot", "vec_id", "v"]
        return own.select(*columns, F.lit(False).alias("asks"), F.lit(None).cast("double").alias("floor")).unionByName(theirs.select(*columns, F.lit(True).alias("asks"), "floor"))

    asks, _ = write_table(asks, "asks")
    at_home = asks.select("vec_id", "v", "dim", its_team, F.expr(f"shiftleft(1L, cast(shard % {team} as int))").alias("slot"), F.lit(float("-inf")).alias("floor"))
    home, _ = write_table(_answers(met(at_home), k, factor), "home")
    floors = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("f"))
    floored = asks.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("f", F.lit(float("-inf"))))
    sent, _ = write_table(_elsewhere(floored.select("vec_id", "v", "dim", "shard", "floor"), pivots, known, factor, team), "sent")
    found = home.unionByName(_answers(met(sent), k, factor))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
