"""Row pattern matching: ``A (D|U)* P D*`` over each client's rows in order of time.

A row can only follow another in a match if it is at most ``gap`` later, both have a value, and it could
be D, U or P. Where it can not, no match crosses, so a client falls into segments that are searched on
their own. The method, for a segment: its rows become a bytearray of symbols (direction, and whether the row is
a goal, that is a view); the starts are taken in ascending order of cents, and goals that are now too low
are switched off in the bytearray; an anchored match of the ``regex`` module at each start gives its end, or
none. A walk over these ends then picks the matches.

Rows are dealt by range of (client, time, id), so that a client of any size spreads over many tasks. A
task searches the segments that lie inside its slice. Those that touch an end of the slice, and those of more than
``long_rows`` rows, are pieces: pieces that follow one another are chained (the pieces, not the
rows, are compared), chains of up to ``long_rows`` rows are searched as above, and longer ones by
``_long``, whose joins and running values find the same matches without a task that holds a whole segment.

Rows without client or time take no part; equal rows (in all columns) are one; rows that differ, but have
equal client, time and id, are ordered by kind and value, null first. A null, NaN or infinite value fits no letter. A null
kind is neither D, U nor P. Other columns are only looked at to tell equal rows. An empty table gives no
rows. The labels of one match are one string, built by one task from blocks of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblens.llm.common import pick
from biblens.runtime import partitions, write_table

GAP_MINUTES = 15
#: Rows of a segment that one task may hold.
LONG_ROWS = 4096
#: Letters of a long match that are joined at a time.
LETTERS = 1 << 16

MOVES, VIEW = 1, 2
#: Symbols of a row by direction (down, up, neither): capital where it is a goal that is not switched off.
DOWN, UP, LEVEL = b"dun"
OFF = 0x20
PATTERN = rb"(?s).[dDuU]*([DUN])[dD]*"


def search(cents: np.ndarray, view: np.ndarray) -> list[tuple[int, int, int]]:
    """(first row, row of P, last row) of the matches in a segment, whose rows all have a value."""
    import regex

    n = len(cents)
    symbols = np.full(n, LEVEL, np.uint8)
    symbols[1:][cents[1:] < cents[:-1]] = DOWN
    symbols[1:][cents[1:] > cents[:-1]] = UP
    symbols[1:][view[1:]] &= ~np.uint8(OFF)
    buf = bytearray(symbols.tobytes())
    match = regex.compile(PATTERN).match
    order = np.argsort(cents, kind="stable")
    value = cents.tolist()
    goals = [i for i in order.tolist() if i and view[i]]
    low, ends = 0, [None] * n
    for start in order.tolist():
        while low < len(goals) and value[goals[low]] < value[start]:
            buf[goals[low]] |= OFF
            low += 1
        if low == len(goals):
            break
        if m := match(buf, start):
            ends[start] = m.start(1), m.end() - 1
    found, at = [], 0
    while at < n:
        if ends[at] is None:
            at += 1
        else:
            found.append((at, *ends[at]))
            at = ends[at][1]
    return found


def letters(cents: np.ndarray, first: int, goal: int, last: int) -> str:
    moves = np.where(cents[first + 1 : goal] < cents[first : goal - 1], ord("D"), ord("U")).astype(np.uint8)
    return f"A{moves.tobytes().decode()}P{'D' * (last - goal)}"


_ROW = ("at", "client_id", "click_id", "ts", "cents", "flags")


def _links(t: pa.Table, before: pa.Table | None, gap: int) -> np.ndarray:
    """Whether each row may follow the one before it in a match."""
    both = t if before is None else pa.concat_tables([before, t])
    ts = both["ts"].to_numpy()
    has = both["cents"].is_valid().to_numpy()
    cents = pc.fill_null(both["cents"], 0).to_numpy()
    flags = both["flags"].to_numpy()
    client = both["client_id"].combine_chunks() if isinstance(both["client_id"], pa.ChunkedArray) else both["client_id"]
    same = pc.equal(client[1:], client[:-1]).to_numpy(zero_copy_only=False).astype(bool)
    may = ((flags[1:] & MOVES > 0) & (cents[1:] != cents[:-1])) | (flags[1:] & VIEW > 0)
    link = same & has[1:] & has[:-1] & (ts[1:] - ts[:-1] <= gap) & may
    return link if before is not None else np.concatenate([[False], link])


def _searcher(gap: int, most: int, ends: bool, out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over sorted rows: the matches of their segments, and the rows of those segments that are left open.

    Open are the first and the last segment, if the rows are a slice of more (``ends``), and longer ones than ``most``.
    """

    def shaped(cols: dict, n: int) -> Iterator[pa.RecordBatch]:
        arrays = [cols[f.name].cast(f.type) if f.name in cols else pa.nulls(n, f.type) for f in out]
        yield from pa.Table.from_arrays(arrays, schema=out).to_batches()

    def as_piece(t: pa.Table, piece: int) -> Iterator[pa.RecordBatch]:
        own = {c: t[c] for c in ("at", "client_id", "ts", "flags", "cents")}
        yield from shaped(own | {"first_id": t["click_id"], "piece": pa.array([piece] * t.num_rows, pa.int64())}, t.num_rows)

    def searched(t: pa.Table, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Matches of the segments from rows ``a`` to ``b``."""
        flags = t["flags"].to_numpy()
        views = np.concatenate([[0], np.cumsum(flags & VIEW > 0)])
        some = views[b] > views[np.minimum(a + 1, b)]  # a view beside the first row
        at, cents, rows = t["at"].to_numpy(), pc.fill_null(t["cents"], 0).to_numpy(), []
        for i, j in zip(a[some].tolist(), b[some].tolist(), strict=True):
            own = cents[i:j]
            for first, goal, last in search(own, flags[i:j] & VIEW > 0):
                rows.append((at[i + first], i + first, i + last, last - first + 1, sum(own[first : last + 1].tolist()), letters(own, first, goal, last)))
        if rows:
            at, first, last, n, total, labels = zip(*rows, strict=True)
            cols = {"at": at, "n_rows": n, "sum_cents": total, "labels": labels}
            yield from shaped({k: pa.array(v) for k, v in cols.items()} | {"client_id": t["client_id"].take(list(first)), "first_id": t["click_id"].take(list(first)), "last_id": t["click_id"].take(list(last))}, len(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, parts, n, piece, outer = None, [], 0, None, ends

        def grow(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Rows of the segment that is not closed yet; beyond ``most`` they are handed on as they come."""
            nonlocal parts, n, piece
            if t.num_rows:
                piece = t["at"][0].as_py() if piece is None else piece
                parts, n = [*parts, t], n + t.num_rows
                if n > most:
                    for x in parts:
                        yield from as_piece(x, piece)
                    parts = []

        def close(left_open: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, n, piece
            if parts:
                t = pa.concat_tables(parts)
                yield from as_piece(t, piece) if left_open else searched(t, np.array([0]), np.array([n]))
            parts, n, piece = [], 0, None

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).select(list(_ROW))
            t = t.set_column(_ROW.index("ts"), "ts", t["ts"].cast(pa.int64()))
            cuts = np.flatnonzero(~_links(t, before, gap))
            before = t.slice(t.num_rows - 1)
            if not len(cuts):
                yield from grow(t)
                continue
            yield from grow(t.slice(0, int(cuts[0])))
            if piece is not None:
                yield from close(outer)
                outer = False
            a, b = cuts[:-1], cuts[1:]
            kept = b - a > most
            if len(a):
                kept[0] |= outer
                outer = False
            yield from searched(t, a[~kept], b[~kept])
            for i, j in zip(a[kept].tolist(), b[kept].tolist(), strict=True):
                yield from as_piece(t.slice(i, j - i), t["at"][i].as_py())
            yield from grow(t.slice(int(cuts[-1])))
        yield from close(ends)

    return run


def _running(df: DataFrame, group: list[str], order: list[str], columns: dict[str, tuple[Callable, Column | str, int]]) -> DataFrame:
    """df with running values: name -> (sum or max, of what, 0 to count the own row or -1 not to).

    As in ``prefix_sums``, rows are dealt by range into slices, and only totals of slices are carried on.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), *group, *order).withColumn("_slice", F.spark_partition_id())
    dealt, _ = write_table(dealt, "slices")
    within = Window.partitionBy(*group, "_slice").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*group, "_slice").agg(*[f(F.expr(v) if isinstance(v, str) else v).alias(f"_t_{k}") for k, (f, v, _) in columns.items()])
    base = totals.select(*group, "_slice", *[f(f"_t_{k}").over(before).alias(f"_b_{k}") for k, (f, _, _) in columns.items()])
    ran = dealt.withColumns({k: f(F.expr(v) if isinstance(v, str) else v).over(within.rowsBetween(Window.unboundedPreceding, upto)) for k, (f, v, upto) in columns.items()})
    zero = F.lit(0).cast("long")
    both = {k: F.coalesce(F.col(k), zero) + F.coalesce(F.col(f"_b_{k}"), zero) if f is F.sum else F.greatest(k, f"_b_{k}") for k, (f, _, _) in columns.items()}
    return ran.join(base, [*group, "_slice"]).withColumns(both).select(*df.columns, *columns)


def _long(rows: DataFrame) -> DataFrame:
    """The matches of long segments, by joins and running values: no task holds a segment.

    ``rows`` are (chain, at, client_id, click_id, cents, flags). P is the last goal of at least the start's cents in
    the start's run: the rows up to the next that is neither D nor U, which is a goal itself. Runs sorted
    by cents give it as a running maximum of positions. Every match points to the first one that starts
    at its last row or later; those reached from a segment's first are found by doubling the pointers.
    """
    prior = Window.partitionBy("chain", "_slice").orderBy("at")
    sliced = rows.repartitionByRange(partitions(rows.sparkSession), "chain", "at").withColumn("_slice", F.spark_partition_id())
    sliced, _ = write_table(sliced, "long-rows")
    # the cents of the row before: across slices, of the last row of the slice before
    tails = sliced.groupBy("chain", "_slice").agg(F.max_by("cents", "at").alias("_tail"))
    tails = tails.select("chain", "_slice", F.lag("_tail").over(Window.partitionBy("chain").orderBy("_slice")).alias("_tail"))
    rows = sliced.join(tails, ["chain", "_slice"]).withColumn("_prior", F.coalesce(F.lag("cents").over(prior), "_tail")).drop("_slice", "_tail")
    move = F.when(F.col("_prior").isNull(), "A").when(F.col("cents") < F.col("_prior"), "D").when(F.col("cents") > F.col("_prior"), "U").otherwise("E")
    rows = rows.withColumn("move", move).drop("_prior")
    rows = _running(rows, ["chain"], ["at"], {"pos": (F.sum, "1L", -1), "run": (F.sum, "if(move = 'E', 1L, 0L)", 0)})
    rows = _running(rows.withColumn("back", -F.col("pos")), ["chain"], ["back"], {"_stop": (F.max, "if(move <> 'D', back, null)", -1), "_end": (F.max, "pos", 0)})
    rows, _ = write_table(rows.withColumn("d_end", F.coalesce(-F.col("_stop") - 1, "_end")).drop("_stop", "_end", "back"), "long-moves")
    goals = rows.filter((F.col("flags").bitwiseAND(VIEW) > 0) & (F.col("move") != "A"))
    goals = goals.select("chain", F.when(F.col("move") == "E", F.col("run") - 1).otherwise(F.col("run")).alias("run"), "cents", F.struct("pos", "d_end").alias("goal"), F.lit(0).alias("start"), "pos")
    starts = rows.select("chain", "run", "cents", F.lit(None).cast(goals.schema["goal"].dataType).alias("goal"), F.lit(1).alias("start"), "pos")
    swept = _running(goals.unionByName(starts).withColumn("falling", -F.col("cents")), ["chain", "run"], ["falling", "start", "pos"], {"best": (F.max, "goal", 0)})
    able = swept.filter("start = 1 and best.pos > pos").select("chain", "pos", F.col("best.pos").alias("goal"), F.col("best.d_end").alias("last"))
    able, _ = write_table(able, "long-starts")
    none = F.lit(None).cast("long")
    ask = able.select("chain", F.col("last").alias("place"), F.lit(1).alias("asks"), F.col("pos").alias("own"))
    seen = able.select("chain", F.col("pos").alias("place"), F.lit(0).alias("asks"), none.alias("own")).unionByName(ask).withColumn("back", -F.col("place"))
    seen = _running(seen, ["chain"], ["back", "asks", "own"], {"_next": (F.max, "if(asks = 0, back, null)", 0)})
    step = seen.filter("asks = 1 and _next is not null").select("chain", F.col("own").alias("pos"), (-F.col("_next")).alias("to"))
    step, _ = write_table(step, "long-steps")
    reached = able.groupBy("chain").agg(F.min("pos").alias("pos"))
    while step.take(1):
        more = reached.join(step, ["chain", "pos"]).select("chain", F.col("to").alias("pos"))
        reached, _ = write_table(reached.unionByName(more), "long-reached")
        onward = step.select("chain", F.col("pos").alias("to"), F.col("to").alias("then"))
        step, _ = write_table(step.join(onward, ["chain", "to"]).select("chain", "pos", F.col("then").alias("to")), "long-steps")
    chosen = able.join(reached, ["chain", "pos"]).select("chain", "pos", F.struct("pos", "goal", "last").alias("match"))
    marked = _running(rows.join(chosen, ["chain", "pos"], "left"), ["chain"], ["pos"], {"over": (F.max, "match", -1)})
    letter = F.when(F.col("pos") < F.col("m.goal"), F.col("move")).when(F.col("pos") == F.col("m.goal"), "P").otherwise("D")
    heads = marked.filter("match is not null").withColumn("m", F.col("match")).withColumn("letter", F.lit("A"))
    rest = marked.filter("pos <= over.last").withColumn("m", F.col("over")).withColumn("letter", letter)
    members = heads.unionByName(rest)
    block = ((F.col("pos") - F.col("m.pos")) / LETTERS).cast("long").alias("block")
    ids = [F.max(F.when(F.col("pos") == F.col(f"m.{p}"), F.col(c))).alias(n) for p, c, n in (("pos", "at", "at"), ("pos", "client_id", "client_id"), ("pos", "click_id", "first_id"), ("last", "click_id", "last_id"))]
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), "")
    blocks = members.groupBy("chain", "m", block).agg(*ids, F.count(F.lit(1)).alias("n_rows"), F.sum("cents").alias("sum_cents"), joined("letter", "pos").alias("part"))
    names = ("at", "client_id", "first_id", "last_id")
    whole = blocks.groupBy("chain", "m").agg(*[F.max(c).alias(c) for c in names], F.sum("n_rows").alias("n_rows"), F.sum("sum_cents").alias("sum_cents"), joined("part", "block").alias("labels"))
    return whole.select(*names, "n_rows", "sum_cents", "labels")


def find(clicks: DataFrame, gap_minutes: int = GAP_MINUTES, long_rows: int = LONG_ROWS) -> DataFrame:
    """(client_id, match_no, first_id, last_id, n_rows, sum_cents, labels) of every match, numbered from 1 for each client.

    ``clicks`` has click_id, ts, client_id, kind and value. After a match the search goes on at its last row.
    """
    spark, gap = clicks.sparkSession, gap_minutes * 60_000_000
    own = {c: c for c in ("client_id", "ts", "click_id", "kind", "value")}
    rows = pick(clicks.distinct(), **own).filter("client_id is not null and ts is not null")
    keys = ["client_id", "ts", "click_id", "kind", "value"]
    rows = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    cents = F.when(finite, F.floor(100 * F.col("value") + 0.5)).cast("long")
    kind = F.coalesce("kind", F.lit("error"))
    flags = F.when(kind != "error", MOVES).otherwise(0) + F.when(kind == "view", VIEW).otherwise(0)
    rows = rows.select(F.monotonically_increasing_id().alias("at"), "client_id", "click_id", "ts", cents.alias("cents"), flags.alias("flags"))
    kinds = dict(rows.dtypes)
    client, click = kinds["client_id"], kinds["click_id"]
    found = f"at long, client_id {client}, first_id {click}, last_id {click}, n_rows long, sum_cents long, labels string, piece long, ts long, cents long, flags int"
    out = _arrow_schema(spark, found)
    first, _ = write_table(rows.mapInArrow(_searcher(gap, long_rows, True, out), found), "row-matches")
    matches = first.filter("piece is null").select("at", "client_id", "first_id", "last_id", "n_rows", "sum_cents", "labels")
    left = first.filter("piece is not null").select("piece", "at", "client_id", F.col("first_id").alias("click_id"), "ts", "cents", "flags")
    # pieces, of which a slice has two beside the long ones, in the order of each client: which go on where the one before ends
    ends = left.groupBy("client_id", "piece").agg(F.count(F.lit(1)).alias("n"), *[f(F.struct("ts", "cents", "flags"), "at").alias(n) for f, n in ((F.min_by, "a"), (F.max_by, "b"))])
    order = Window.partitionBy("client_id").orderBy("piece")
    follows = (F.col("a.cents") != F.col("_b.cents")) & (F.col("a.flags").bitwiseAND(MOVES) > 0) | (F.col("a.flags").bitwiseAND(VIEW) > 0)
    linked = F.coalesce((F.col("a.ts") - F.col("_b.ts") <= gap) & F.col("a.cents").isNotNull() & F.col("_b.cents").isNotNull() & follows, F.lit(False))
    linked = linked & (F.shiftright("piece", 33) > F.shiftright(F.lag("piece").over(order), 33))  # within a slice rows in between are closed
    chains = ends.withColumn("_b", F.lag("b").over(order)).withColumn("_linked", linked).withColumn("chain", F.last(F.when(~F.coalesce("_linked", F.lit(False)), F.col("piece")), True).over(order))
    sizes = chains.groupBy("chain").agg(F.sum("n").alias("size"))
    named = chains.select("piece", "chain").join(sizes, "chain")
    rows, _ = write_table(left.join(named, "piece").drop("piece"), "open-rows")
    small = rows.filter(F.col("size") <= long_rows).repartition(partitions(spark), "chain").sortWithinPartitions("chain", "at")
    parts = [matches, small.select(*_ROW).mapInArrow(_searcher(gap, long_rows, False, out), found).select(matches.columns)]
    big = rows.filter(F.col("size") > long_rows)
    if big.take(1):
        parts.append(_long(big.drop("size", "ts")).select(matches.columns))
    every, _ = write_table(reduce(DataFrame.unionByName, parts), "all-matches")
    # numbered in slices of the order; few slices have matches of one client before them
    every = every.withColumn("slice", F.shiftright("at", 33))
    so_far = Window.partitionBy("client_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = every.groupBy("client_id", "slice").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.sum("n").over(so_far))
    within = F.row_number().over(Window.partitionBy("client_id", "slice").orderBy("at"))
    numbered = every.join(base.filter("base > 0").drop("n"), ["client_id", "slice"], "left").withColumn("match_no", F.coalesce("base", F.lit(0)) + within)
    return numbered.select("client_id", F.col("match_no").cast("long"), "first_id", "last_id", "n_rows", "sum_cents", "labels")


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)
