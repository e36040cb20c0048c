"""Mixing sources to target weights.

Each source's documents, in the order of their ids, are one stream of words that is packed into
blocks of ``BLOCK`` words (the last may be shorter). A source's target of words gives its number of
draws. The mix is dealt to output shards of about ``SHARD`` slots: each source's draws are spread over
the shards by a multinomial, so a shard's source counts are multinomial too and all shards' counts add
up to each source's draws. Counts are drawn on executors in two steps, first for groups of ``GROUP``
shards, then within each group, from counter-based seeds, so no task or driver holds all shards. The
draws of a source are numbered; draw g is block perm(g mod n) of its n blocks, perm being a pseudorandom
permutation (a Feistel network with cycle walking) that depends on the seed, the source and the epoch.
Slots and blocks meet in a join by (source, block). A block is so taken floor or ceiling of draws / n
times, no more than ``MOST`` times as targets are at most MOST times a source's size.

Sources, however many, stay in tables: their order, targets and draws are aggregates and running sums.
Documents find their source's row by a join that broadcasts only the few sources with many documents.

Null texts have no words, null sources are a source of their own, the last. Rows with repeated or
null ids are documents of their own, ties in the order of ids fall to the smaller text. A source without words,
or an empty table, has no draws. Texts of any length count whole; further columns are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblens.llm.common import join_hot, pick, prefix_sums, shelter, tidy, with_uid
from biblens.runtime import partitions, write_table

BLOCK = 64
SHARD = 1 << 14
#: Shards whose counts one task draws at a time.
GROUP = 4096
MOST = 3
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Words to take of each source: all words shared by weight, none above ``most`` times its size.

    What a source can not take is shared again by weight among the others, until none is above. The
    form for few sources, against which the tables are tested.
    """
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = float(sum(sizes))
    while free and left > 0:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def source_table(sized: DataFrame, weights: tuple[float, ...], block: int, most: int = MOST) -> DataFrame:
    """A row for each source of (source, size): source_no by code point, null last, source_size, documents, target, blocks, draws.

    Each round of sharing is one aggregate over the sources: those above their limit are taken out of
    the rest, whose share only grows, so a source that is once above stays so.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    ranked = prefix_sums(per.withColumns({"one": F.lit(1), "last": F.col("source").isNull()}), [], ["last", "source"], "one", "source_no")
    pick_weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    table, _ = write_table(ranked.select(F.col("source_no").cast("long").alias("source_no"), "source", "source_size", "documents", pick_weight.alias("weight")), "sources")
    limit = F.col("source_size") * most
    total = float(table.agg(F.sum("source_size").alias("t")).first()["t"] or 0)
    some = table.filter("source_size > 0")
    left, open_weight = total, float(some.agg(F.sum("weight").alias("w")).first()["w"] or 0)
    while open_weight:
        above = left * F.col("weight") / open_weight > limit
        got = some.agg(F.sum(F.when(above, limit).otherwise(0)).alias("full"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if float(got["w"]) == open_weight:
            break
        left, open_weight = total - float(got["full"]), float(got["w"])
    share = left * F.col("weight") / open_weight if open_weight else F.lit(0.0)
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(share, limit.cast("double")))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    draws = F.when(F.col("source_size") > 0, F.least(blocks * most, F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"))).otherwise(0)
    return write_table(table.withColumn("target", target).withColumn("blocks", blocks).withColumn("draws", draws), "sources")[0]


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Images of indices under pseudorandom permutations of range(size), one for each (size, key)."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    limit = size.astype(np.uint64)
    while len(todo):
        h, mk, k = half[todo], mask[todo], key[todo]
        a, b = out[todo] >> h, out[todo] & mk
        for r in range(6):
            f = (b + k + np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(32)
            a, b = b, a ^ (f & mk)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def source_key(seed: int, source: int, epoch: np.ndarray) -> np.ndarray:
    x = epoch.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64((seed * 1_000_003 + source + 1) & ((1 << 63) - 1))
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def spread(draws: int, parts: np.ndarray, seed: int, *place: int) -> np.ndarray:
    """Draws spread over parts of the given sizes by a multinomial, from a seed that names the place."""
    rng = np.random.Generator(np.random.PCG64([seed, *place]))
    return rng.multinomial(draws, parts / parts.sum())


def deal_slots(sources: DataFrame, shard: int, seed: int) -> DataFrame:
    """(shard, source_no, block), one row for each slot of the mix, from (source_no, blocks, draws)."""
    spark = sources.sparkSession
    total = int(sources.agg(F.sum("draws").alias("t")).first()["t"] or 0)
    shards = max(1, -(-total // shard))
    groups = np.full(-(-shards // GROUP), GROUP, np.int64)
    groups[-1] = shards - GROUP * (len(groups) - 1)

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, draws in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = spread(draws, groups, seed, i)
                at = np.flatnonzero(got)
                first = np.cumsum(got) - got
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(np.full(len(at), n)), pa.array(first[at]), pa.array(got[at])], names=["source_no", "group", "blocks", "first", "n"])

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, g, n, start, draws in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = spread(draws, np.ones(groups[g]), seed, i, g)
                at = np.flatnonzero(got)
                first = start + np.cumsum(got) - got
                yield pa.RecordBatch.from_arrays([pa.array(at + g * GROUP), pa.array(np.full(len(at), i)), pa.array(np.full(len(at), n)), pa.array(first[at]), pa.array(got[at])], names=["shard", "source_no", "blocks", "first", "n"])

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, i, n, start, draws in zip(*(c.to_pylist() for c in b.columns), strict=True):
                g = np.arange(start, start + draws, dtype=np.int64)
                at = permute(g % n, np.full(draws, n, np.int64), source_key(seed, i, g // n))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(draws, k)), pa.array(np.full(draws, i)), pa.array(at)], names=["shard", "source_no", "block"])

    p = partitions(spark)
    # one row for each source, then for each source and group, then for each source and shard: each dealt out before it grows
    grouped = sources.filter("draws > 0").select("source_no", "blocks", "draws").mapInArrow(tidy(to_groups), "source_no long, group long, blocks long, first long, n long")
    dealt = grouped.repartition(p, "source_no", "group").mapInArrow(tidy(to_shards), "shard long, source_no long, blocks long, first long, n long")
    return dealt.repartition(p, "shard", "source_no").mapInArrow(tidy(to_slots), "shard long, source_no long, block long")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, seed: int = 20240607):
    """(documents, slots, pieces) of documents that may have a uid already.

    documents: uid, doc_id, size, source_no, source_size, target. slots: shard, source_no, block, one row
    for each slot. pieces: uid, source_no, block, start (word in the document), words.
    """
    named = docs if "uid" in docs.columns else with_uid(pick(docs, doc_id="doc_id", source="source", text="text"))
    rows = pick(named, uid="uid", doc_id="doc_id", source="source", text="text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # a null source is told from the others by a second column, so that joins can compare plainly
    known = F.col("source").cast("string")
    sized, _ = write_table(rows.select("uid", "doc_id", known.alias("source"), size.alias("size")), "sizes")
    sources = source_table(sized, weights, block)
    marked = {"unnamed": F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))}
    documents = join_hot(sized.withColumns(marked), sources.withColumns(marked), ["source", "unnamed"], "documents")
    documents, _ = write_table(documents.select("uid", "doc_id", "size", "source_no", "source_size", "target"), "placed")
    slots = deal_slots(sources, shard, seed)

    placed = prefix_sums(documents.filter("size > 0").select("source_no", "uid", "size"), ["source_no"], ["uid"], "size", "begin")
    first, last = F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}")
    pieces = placed.select("uid", "source_no", "begin", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("begin"), F.col("block") * block)
    high = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("uid", "source_no", "block", (low - F.col("begin")).alias("start"), (high - low).alias("words"))
    return documents, slots, pieces


def taken_pieces(slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """pieces with ``times``, how often the mix takes their block; blocks that are not drawn are absent."""
    times = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    # the planner takes the slots for as small as the table they are dealt from: keep it from broadcasting them
    return pieces.join(times.hint("merge"), ["source_no", "block"])


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    documents, slots, pieces = plan(with_uid(pick(docs, doc_id="doc_id", source="source", text="text")), **options)
    taken = taken_pieces(slots, pieces).groupBy("uid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    joined = documents.join(taken.hint("merge"), "uid", "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: the c-th copy of a document holds the words whose blocks are taken c times or more.

    Copies without words are left out. A copy of all words is the text as it stands; others keep the
    text from each stretch's first word to its last and join stretches by one space. n_chars is counted
    again; further columns are those of the document.
    """
    docs, back = shelter(docs, "uid", "_taken")
    rows = with_uid(docs)
    _, slots, pieces = plan(rows, **options)
    taken = taken_pieces(slots, pieces).groupBy("uid").agg(F.collect_list(F.struct("start", "words", "times")).alias("_taken"))
    joined = rows.join(taken.hint("merge"), "uid").drop("uid")
    names = joined.columns
    text_at, taken_at = names.index("text"), names.index("_taken")
    kept = [c for c in names if c != "_taken"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORD)
        for b in batches:
            take, texts = [], []
            for r in range(b.num_rows):
                text = b.column(text_at)[r].as_py() or ""
                got = sorted((x["start"], x["words"], x["times"]) for x in b.column(taken_at)[r].as_py())
                at = None
                for copy in range(1, max(t for _, _, t in got) + 1):
                    runs: list[list[int]] = []
                    for start, words, times in got:
                        if times >= copy:
                            if runs and runs[-1][1] == start:
                                runs[-1][1] = start + words
                            else:
                                runs.append([start, start + words])
                    if at is None:
                        at = [m.span() for m in word.finditer(text)]
                    whole = len(runs) == 1 and runs[0] == [0, len(at)]
                    texts.append(text if whole else " ".join(text[at[x][0] : at[y - 1][1]] for x, y in runs))
                    take.append(r)
            index = pa.array(take, pa.int64())
            columns = []
            for c in kept:
                if c == "text":
                    columns.append(pa.array(texts, pa.string()))
                elif c == "n_chars":
                    columns.append(pa.array([len(t) for t in texts], pa.int64()).cast(b.schema.field(c).type))
                else:
                    columns.append(b.column(names.index(c)).take(index))
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    schema = joined.drop("_taken").schema
    return joined.mapInArrow(tidy(run), schema).withColumnsRenamed(back)
