"""SimHash fingerprints, by DataFrame operations only.

Terms are pairs of neighbouring words of the lower-cased text (the last word stands alone); a term's
weight is its length in characters, and each occurrence votes. The 64 bits of a term's hash vote with
plus or minus the weight; a fingerprint bit is 1 where the sum is above zero. Sums are gathered two
bits to a long: bit j and bit j + 32 of the hash, masked out together, add up in separate halves, so
32 sums count all 64 bits and no row needs an array. Null counts as empty; a text without words has
fingerprint 0. Rows with repeated or null ids are documents of their own. An empty table gives no rows.
A text of any length counts whole: its words are one array, its sums are gathered as it is read. Ties in
a vote give 0; rows tie in the order of ids only where ids repeat, and then follow their texts.

Near fingerprints are found by permuted block tables: the 64 bits are cut into ``RADIUS`` + ``SAME``
blocks, and each table is keyed by another choice of ``SAME`` blocks. Fingerprints within the radius
differ in at most ``RADIUS`` blocks, so they agree in a key of one table at least. A pair counts in the
first table in which it meets. Equal fingerprints are one entry with a count.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblens.llm.common import join_hot, pick, text_or_empty, with_uid
from biblens.runtime import partitions, write_table

#: Hamming radius of the search, and blocks in the key of a table: keys have 64 * SAME / (RADIUS + SAME) bits.
RADIUS, SAME = 3, 3
#: Documents whose id is divisible by this ask for their neighbours.
EVERY = 50
HALVES = 0x0000000100000001
LOW = 0xFFFFFFFF


def terms(text: str) -> Column:
    """Pairs of neighbouring words as an array of structs."""
    words = F.array_remove(F.split(F.translate(F.lower(F.col(text)), "\t\n\x0b\x0c\r", "     "), " "), "")
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("b"))


def fingerprints(rows: DataFrame, text: str, keys: list[str], out: str) -> DataFrame:
    """keys and the fingerprint (a long) of each row's text; ``keys`` must tell the rows apart."""
    exploded = rows.select(*keys, F.explode_outer(terms(text)).alias("t"))
    weight = F.coalesce(F.length("t.a"), F.lit(0)) + F.coalesce(F.length("t.b"), F.lit(0))
    voted = exploded.select(*keys, F.xxhash64("t.a", "t.b").alias("h"), weight.cast("long").alias("w"))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(HALVES)) * F.col("w")).alias(f"s{j}") for j in range(32)]
    summed = voted.groupBy(*keys).agg(F.sum("w").alias("w"), *sums)
    bits = F.lit(0).cast("long")
    for j in range(32):
        s = F.col(f"s{j}")
        low = s.bitwiseAND(F.lit(LOW)) * 2 > F.col("w")
        high = F.shiftrightunsigned(s, 32) * 2 > F.col("w")
        one = (1 << (j + 32)) if j < 31 else -(1 << 63)
        bits = bits.bitwiseOR(F.when(low, F.lit(1 << j)).otherwise(F.lit(0)).cast("long")).bitwiseOR(F.when(high, F.lit(one)).otherwise(F.lit(0)).cast("long"))
    return summed.select(*keys, bits.alias(out))


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def with_next(table: DataFrame) -> DataFrame:
    """Add next_uid, next_n, next_fp: the row with the next smaller uid; after the smallest, the largest.

    Rows are dealt by range of uid. Only a slice's first row looks outside, at the last rows of other
    slices, of which there are as many as partitions.
    """
    dealt, _ = write_table(table.repartitionByRange(partitions(table.sparkSession), "uid").withColumn("slice", F.spark_partition_id()), "order")
    last = dealt.groupBy("slice").agg(F.max(F.struct("uid", "n", "fp")).alias("last"))
    before = F.coalesce(F.lag("last").over(Window.orderBy("slice")), F.max("last").over(Window.partitionBy()))
    edges = last.select("slice", before.alias("edge"))
    own = Window.partitionBy("slice").orderBy("uid")
    near = F.coalesce(F.lag(F.struct("uid", "n", "fp")).over(own), F.col("edge"))
    joined = dealt.join(F.broadcast(edges), "slice").withColumn("near", near)
    return joined.select(*table.columns, F.col("near.uid").alias("next_uid"), F.col("near.n").alias("next_n"), F.col("near.fp").alias("next_fp"))


def tables(radius: int = RADIUS, same: int = SAME) -> list[int]:
    """The mask of each table: the bits of its choice of blocks."""
    parts = radius + same
    cuts = [64 * i // parts for i in range(parts + 1)]
    masks = [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen) for chosen in combinations(range(parts), same)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_keys(fp: Column, masks: list[int]) -> Column:
    """The keys of a fingerprint in every permuted block table, as an array of struct(table, key)."""
    return F.array(*[F.struct(F.lit(t).alias("table"), fp.bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])


def meetings(values: DataFrame, asks: DataFrame, radius: int = RADIUS, same: int = SAME) -> DataFrame:
    """(v, w, distance, and further columns of values as they are): each v of ``asks`` with each w of ``values`` within the radius, once."""
    masks = tables(radius, same)
    more = [c for c in values.columns if c != "w"]
    left = asks.select("v", F.explode(block_keys(F.col("v"), masks)).alias("k")).select("v", "k.table", "k.key")
    right = values.select("w", *more, F.explode(block_keys(F.col("w"), masks)).alias("k")).select("w", *more, "k.table", "k.key")
    differ = F.col("v").bitwiseXOR(F.col("w"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    met = left.join(right, ["table", "key"]).filter((F.bit_count(differ) <= radius) & (first == F.col("table")))
    return met.select("v", "w", F.bit_count(differ).alias("distance"), *more)


def near_fingerprints(table: DataFrame, radius: int = RADIUS, same: int = SAME, fp: str = "fp") -> DataFrame:
    """(a, b, distance): all pairs a < b of different fingerprints within the Hamming radius.

    Equal fingerprints are one, so copies are not expanded; they are joined to it by value.
    """
    distinct = table.select(F.col(fp).alias("v")).filter("v is not null").distinct()
    met = meetings(distinct.withColumnRenamed("v", "w"), distinct, radius, same)
    return met.filter("v < w").select(F.col("v").alias("a"), F.col("w").alias("b"), "distance")


def count_neighbours(table: DataFrame, radius: int = RADIUS, same: int = SAME) -> DataFrame:
    """(uid, n_near) of the rows (uid, fp, asks) that ask: how many other rows' fingerprints are within the radius."""
    values = table.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("asking"))
    values, _ = write_table(values, "values")
    asked = values.filter("asking > 0")
    near = meetings(values.select(F.col("fp").alias("w"), "rows"), asked.select(F.col("fp").alias("v")), radius, same)
    near = near.groupBy("v").agg(F.sum("rows").alias("near")).withColumnRenamed("v", "fp")
    near, _ = write_table(near.join(asked.select("fp", "asking"), "fp"), "near")
    rows = table.filter("asks").select("uid", "fp")
    return join_hot(rows, near, ["fp"], "asking").select("uid", (F.col("near") - 1).alias("n_near"))


def compare_edited(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) of every row.

    The edited text has its last n div 2 code points replaced by the first as many (or all) of the next
    document's, in descending order of ids; after the last comes the first. n_near is the number of other
    documents whose fingerprint is within the radius, for ids divisible by ``every``, else null.
    """
    rows = with_uid(pick(docs, doc_id="doc_id", text="text")).select("uid", "doc_id", text_or_empty().alias("text"))
    sized = rows.select("uid", "doc_id", F.length("text").cast("long").alias("n"), "text")
    table, _ = write_table(with_next(fingerprints(sized, "text", ["uid", "doc_id", "n"], "fp")), "fingerprints")
    asks = F.coalesce(F.col("doc_id").cast("long") % every == 0, F.lit(False)).alias("asks")
    near = count_neighbours(table.select("uid", "fp", asks))
    texts = rows.select("uid", "text")  # the same columns in both joins below, which so share one exchange
    # each text goes once, cut to what is asked of it, to the document before it
    ask = table.select(F.col("next_uid").alias("uid"), F.col("uid").alias("to"), F.expr("cast(n div 2 as int)").alias("m"))
    sent = texts.join(ask, "uid").select(F.col("to").alias("uid"), F.substring("text", F.lit(1), F.col("m")).alias("tail"))
    known = table.select("uid", "doc_id", "n", "fp", "next_fp").join(near, "uid", "left")
    edited = F.concat(F.substring("text", F.lit(1), F.expr("cast(n - n div 2 as int)")), "tail")
    both = texts.join(known, "uid").join(sent, "uid").withColumn("edited", edited)
    keys = ["uid", "doc_id", "n", "fp", "next_fp", "n_near", "sha"]
    out = fingerprints(both.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256)), "edited", keys, "efp")
    return out.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )
