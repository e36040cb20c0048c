"""Repeated runs of lines, by a suffix array over line ids.

Lines are cut at newlines and named by content. Suffixes of the documents' line sequences are ranked
by distributed prefix doubling: ranks of length 2h come from sorting the distinct pairs (rank of
length h at i, rank of length h at i + h) by range, so that no task holds all of a frequent pair.
Lines and pairs that occur once end there, as no repeated run holds them. Suffixes that share a prefix
of n lines are an interval of the suffix array with longest common prefix n or more; it is named by
the two ranks of lengths 2^k <= n that cover the n lines. For every position n is the least number of
lines with ``min_words`` words: the windows of an interval are copies of each other, all but the first
(smaller document, then earlier line) are later copies, and the union of these windows is exactly the
maximal repeated runs of at least that many words. Doubling stops at the longest window.

Later copies are deleted with their lines; the rest stays in order, joined by newlines. Null counts as
empty, an empty text is one empty line. Rows with repeated or null ids are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblens.llm.common import by_bytes, join_hot, shelter, text_or_empty, tidy, with_uid
from biblens.llm.mixing import WORD
from biblens.runtime import partitions, write_table

MIN_WORDS = 10


def _ranked(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """rows that share their keys with others, with the keys' number in sorted order: dealt by range, numbered within each range."""
    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    dealt = often.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    numbers, _ = write_table(dealt.withColumn(out, F.monotonically_increasing_id()), "ranks")
    return join_hot(rows, numbers, keys, "_copies").drop("_copies")


def line_table(rows: DataFrame) -> DataFrame:
    """(uid, pos, h1, h2, words) of every line."""
    lines = rows.select("uid", F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"))
    words = F.regexp_count("line", F.lit(WORD)).cast("long")
    return lines.select("uid", F.col("pos").cast("long").alias("pos"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("2"), "line").alias("h2"), words.alias("words"))


def later_copies(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, start, end): windows of lines that a smaller document or an earlier place has too."""
    lines, _ = write_table(line_table(rows), "lines")
    named = _ranked(lines, ["h1", "h2"], "rank").select("uid", "pos", "words", "rank")

    doc = Window.partitionBy("uid").orderBy("pos")
    run = Window.partitionBy("uid", "run")
    stretches = named.withColumn("run", F.col("pos") - F.row_number().over(doc))
    stretches = stretches.withColumn("before", F.sum("words").over(run.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    stretches = stretches.withColumns(
        {
            "total": F.sum("words").over(run),
            "end": F.max("pos").over(run) + 1,
            "reach": F.min("pos").over(run.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing)),
        }
    )
    n = F.coalesce(F.col("reach") - F.col("pos"), F.when(F.col("total") - F.col("before") >= min_words, F.col("end") - F.col("pos")))
    level, _ = write_table(stretches.select("uid", "run", "pos", "rank", n.alias("n")), "level")

    longest = level.agg(F.max("n").alias("n")).first()["n"] or 0
    found, h = [], 1
    while h <= longest:
        here = level.filter(f"n >= {h} and n < {2 * h}")
        exact = here.filter(f"n = {h}").select("uid", "pos", "n", "rank", F.col("rank").alias("rank2"))
        found.append(exact.withColumn("h", F.lit(h)))
        if h > 1:
            second = level.select("uid", F.col("pos").alias("at"), F.col("rank").alias("rank2"))
            wide = here.filter(f"n > {h}").withColumn("at", F.col("pos") + F.col("n") - h)
            found.append(wide.join(second, ["uid", "at"]).select("uid", "pos", "n", "rank", "rank2").withColumn("h", F.lit(h)))
        if 2 * h > longest:
            break
        ahead = Window.partitionBy("uid", "run").orderBy("pos").rangeBetween(h, h)
        pairs, _ = write_table(level.withColumn("ahead", F.first("rank").over(ahead)).filter("ahead is not null"), "pairs")
        level, _ = write_table(_ranked(pairs, ["rank", "ahead"], "next").select("uid", "run", "pos", F.col("next").alias("rank"), "n"), "level")
        h *= 2
    if not found:
        return level.select("uid", F.col("pos").alias("start"), F.col("pos").alias("end")).limit(0)
    windows = found[0]
    for f in found[1:]:
        windows = windows.unionByName(f)
    windows, _ = write_table(windows.select("uid", "pos", "n", "h", "rank", "rank2"), "windows")
    interval = ["h", "n", "rank", "rank2"]
    first, _ = write_table(windows.groupBy(*interval).agg(F.min(F.struct("uid", "pos")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "first")
    later = join_hot(windows, first, interval, "c").filter((F.col("uid") != F.col("first.uid")) | (F.col("pos") != F.col("first.pos")))
    return later.select("uid", F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, digest: bool = False) -> DataFrame:
    """Every row without its later copies of runs of lines.

    With ``digest`` (doc_id, n_lines, n_removed, n_spans, kept_sha256); else the columns of ``docs`` with
    the text, and n_chars if there is one, as they are after the deletion.
    """
    docs, back = shelter(docs.select("doc_id", "text") if digest else docs, "uid", "_cut")
    rows = with_uid(docs)
    cut = later_copies(rows.select("uid", "text"), min_words).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("_cut"))
    joined = rows.join(cut, "uid", "left").drop("uid")
    names = joined.columns
    text_at, cut_at = names.index("text"), names.index("_cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text_at):
            texts = b.column(text_at).to_pylist()
            n_lines, n_removed, n_spans = [], [], []
            for r, spans in enumerate(b.column(cut_at).to_pylist()):
                if spans is None and not digest:
                    continue
                lines = (texts[r] or "").split("\n")
                gone = np.zeros(len(lines) + 1, np.int64)
                for s in spans or ():
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                n_lines.append(len(lines))
                n_removed.append(int(gone.sum()))
                n_spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                if spans:
                    texts[r] = "\n".join([x for x, g in zip(lines, gone, strict=True) if not g])
            if digest:
                sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
                counts = [pa.array(x, pa.int64()) for x in (n_lines, n_removed, n_spans)]
                yield pa.RecordBatch.from_arrays([b.column(names.index("doc_id")), *counts, pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_removed", "n_spans", "kept_sha256"])
                continue
            columns = []
            for c in names[:-1]:
                if c == "text":
                    columns.append(pa.array(texts, pa.string()))
                elif c == "n_chars":
                    columns.append(pa.array([len(t or "") for t in texts], pa.int64()).cast(b.schema.field(c).type))
                else:
                    columns.append(b.column(names.index(c)))
            yield pa.RecordBatch.from_arrays(columns, names=names[:-1])

    if digest:
        return joined.mapInArrow(tidy(run), f"doc_id {dict(joined.dtypes)['doc_id']}, n_lines long, n_removed long, n_spans long, kept_sha256 string")
    return joined.mapInArrow(tidy(run), joined.drop("_cut").schema).withColumnsRenamed(back)
