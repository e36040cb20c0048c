"""Kept search indexes: words of works, and positional postings for phrases, written once and read by every search.

A search for words finds the same works, with the same weights, as a join of every word of the query with every
work that has it. It does less, and it shuffles no postings:

* Works with equal words are one set, with their ``KEEP`` smallest ids; queries with equal known words are one query.
* Sets are dealt into blocks and queries into chunks; a block meets a chunk in a task, which holds the block's postings
  and answers one query after another (``Block``). What is shuffled are sets and queries, not what they have in common.
* Sets that share their anchor (the heaviest word that is not too rare) are in one block. A query is answered in the block of its own anchor
  first, and goes on to the others only if words that they have too weigh as much as its last place there.
* Works may be told apart by realms (an author's works, say). A query meets the sets of its own realm only, and so does each set: both go
  to the one task of their realm, or to some of their own where a realm is large.
* In a block words are read heaviest first. Some works read early are weighed in full, so that the last place weighs so much at
  least; words are read on only while all that is unread weighs so much, and of the works read those are let go that can not
  come up to the last place any more. Works that share none of the words read can not be among the first, exactly.
* Hot words are those that one work in ``HOT`` has. Works that share only hot words with a query weigh what their hot words weigh, so
  of all works with the same hot words (a profile) only those with the smallest ids can be among the first. Queries of nothing but
  hot words are looked up in the profiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblens.functions.text import normalize_text, tokens
from biblens.runtime import numbered, partitions, write_table

#: Ids kept of works with equal words or titles: a search can give so many places at most.
KEEP = 10
#: One work in so many has a hot word.
HOT = 8
#: Works that a search reads before it weighs as many of them in full.
FIRST = 100
#: Sets in a block and queries in a chunk at most; queries from which on another task is worth while.
BLOCK, CHUNK, LEAST = 1 << 19, 250_000, 2000
#: An anchor is a word of so many works at least, and of one block in so many at most.
ANCHOR, SHARE = 100, 8
#: Queries with a common anchor that are weighed together: so many at least, with so many weights at most.
TOGETHER, CELLS = 4, 1 << 22
#: Words that one set of a block in so many has are looked up by flags.
DENSE = 32


def _keep(df: DataFrame, name: str, path: str | None) -> DataFrame:
    if path is None:
        return write_table(df, name)[0]
    at = f"{path.rstrip('/')}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _smallest(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, ids): the ``KEEP`` smallest values, cut in each task before the shuffle, so a group of any size is no load."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(value))
    return rows.withColumn("_place", place).filter(F.col("_place") <= KEEP).groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("ids"))


def title_words(title: Column) -> Column:
    """The distinct words of a title, sorted."""
    return F.array_sort(tokens(normalize_text(title)))


#: The fields of a work in which a whole citation is looked for.
CITED = ("title", "venue", "volume", "issue", "page", "article_number")


def citation_words(works: DataFrame) -> Column:
    """The distinct words of all that a citation may say of a work, sorted."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CITED if c in works.columns]
    return title_words(F.concat_ws(" ", *said, F.array_join(F.coalesce("authors", F.array().cast("array<string>")), " "), F.col("year").cast("string")))


#: A word's code: its weight above so many bits, its number below.
BITS = 43


def _weight(code: Column | str) -> Column:
    return F.shiftright(code, BITS)


def _digest(*columns: str) -> Column:
    """A short key of some columns."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


class Block:
    """Some sets of works in a task: for each word's code the places of those that have it, places in order of their smallest ids."""

    def __init__(self, held: list[tuple[pa.ListArray, np.ndarray, np.ndarray]], kind: pa.DataType):
        """``held`` has the sets' ids, how many words each set has, and the codes of all."""
        ids = pa.concat_arrays([h[0] for h in held]) if held else pa.array([], kind)
        by_id = pc.sort_indices(pc.list_element(ids, 0)).to_numpy() if len(ids) else np.empty(0, np.int64)
        place = np.empty(len(by_id), np.int32)
        place[by_id] = np.arange(len(by_id), dtype=np.int32)
        self.ids = ids.take(pa.array(by_id))
        codes = np.concatenate([h[2] for h in held]) if held else np.empty(0, np.int64)
        owner = np.repeat(place, np.concatenate([h[1] for h in held])) if held else np.empty(0, np.int32)
        order = np.lexsort((owner, codes))
        codes, self.owner = codes[order], owner[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        self.codes, self.ends = codes[first], np.append(first, len(codes))
        self.seen, self.flags = np.zeros(len(by_id), bool), {}

    def _has(self, word: int, places: np.ndarray) -> np.ndarray:
        """Which of the places have a word of the block."""
        mine = self.owner[self.ends[word] : self.ends[word + 1]]
        if len(mine) * DENSE < len(self.seen):
            at = np.searchsorted(mine, places)
            at[at == len(mine)] = 0
            return mine[at] == places
        if word not in self.flags:
            self.flags[word] = np.zeros(len(self.seen), bool)
            self.flags[word][mine] = True
        return self.flags[word][places]

    def firsts(self, codes: np.ndarray, top: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, hits and weights of the ``top`` sets of a query, the heaviest first, ties to the smaller id. ``codes`` fall."""
        if not len(self.codes):
            codes = codes[:0]
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        words = at[self.codes[at] == codes] if len(at) else at
        weights = self.codes[words] >> BITS
        rest = np.append(np.cumsum(weights[::-1])[::-1], 0)
        none = np.empty(0, np.int32), np.empty(0, np.int64)
        (places, part), done, least, touched = none, none, -1, []
        for i, word in enumerate(words):
            if least < 0 and len(places) >= first:
                # the most hopeful are weighed in full: the last place weighs so much at least
                every = len(part) <= 4 * first
                some = np.arange(len(part)) if every else np.argpartition(part, -first)[-first:]
                whole = part[some] + sum(weights[j] * self._has(words[j], places[some]) for j in range(i, len(words)))
                least = np.partition(whole, -top)[-top]
                if every:
                    done, (places, part) = (places, whole), none
            if not len(places) and rest[i] < least:
                break
            if len(places):
                part = part + weights[i] * self._has(word, places)
            if rest[i] >= least:
                mine = self.owner[self.ends[word] : self.ends[word + 1]]
                new = mine[~self.seen[mine]]
                self.seen[new] = True
                touched.append(new)
                places, part = np.concatenate([places, new]), np.concatenate([part, np.full(len(new), weights[i])])
            if least > 0:
                near = part + rest[i + 1] >= least
                places, part = places[near], part[near]
        for new in touched:
            self.seen[new] = False
        places, part = np.concatenate([places, done[0]]), np.concatenate([part, done[1]])
        if len(part) > top:
            near = part >= np.partition(part, -top)[-top]
            places, part = places[near], part[near]
        best = np.lexsort((places, -part))[:top]
        places, part = places[best], part[best]
        hits = sum((self._has(word, places).astype(np.int64) for word in words), np.zeros(len(places), np.int64))
        return places, hits, part


    def many(self, codes: np.ndarray, sizes: np.ndarray, top: int, first: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``firsts`` of each of many queries, which are ``sizes`` codes long. Those that have the same word as their heaviest of ``ANCHOR`` sets
        or more are weighed together, by one product, in all sets that have this word or a heavier one of theirs. That answers a query whose
        lighter words alone weigh less than its last place; others are answered one by one."""
        ends = np.cumsum(sizes)
        one = lambda i: self.firsts(codes[ends[i] - sizes[i] : ends[i]], top, first)
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        often = known & (self.ends[at + 1] - self.ends[at] >= ANCHOR) if len(self.codes) else known
        found, groups = [None] * len(sizes), {}
        for i, (lo, hi) in enumerate(zip(ends - sizes, ends)):
            words, k = at[lo:hi][known[lo:hi]], np.flatnonzero(often[lo:hi][known[lo:hi]])
            if len(k):
                groups.setdefault(words[k[0]], []).append((i, words, k[0]))
        open_ = list(groups.items())
        while open_:
            anchor, group = open_.pop()
            if len(group) < TOGETHER:
                continue
            light = np.unique(np.concatenate([words[k:] for _, words, k in group]))
            heavy = np.unique(np.concatenate([words[:k] for _, words, k in group]))
            places = np.unique(np.concatenate([self.owner[self.ends[w] : self.ends[w + 1]] for w in (anchor, *heavy)]))
            if max(len(light), len(group)) * len(places) > CELLS:
                open_ += [(anchor, group[: len(group) // 2]), (anchor, group[len(group) // 2 :])]
            elif len(places) > top:
                self._together(found, group, light, places, top)
        return [one(i) if f is None else f for i, f in enumerate(found)]

    def _together(self, found: list, group: list[tuple[int, np.ndarray, int]], light: np.ndarray, places: np.ndarray, top: int) -> None:
        """Fill in what ``many`` finds of a group of (query, words, place of the anchor). Weights are whole and small enough to be exact in doubles."""
        has, asks = np.array([self._has(w, places) for w in light], float), np.zeros((len(group), len(light)))
        for row, (_, words, k) in zip(asks, group):
            row[np.searchsorted(light, words[k:])] = self.codes[words[k:]] >> BITS
        weights = asks @ has
        for row, (_, words, k) in zip(weights, group):
            for w in words[:k]:
                row[np.searchsorted(places, self.owner[self.ends[w] : self.ends[w + 1]])] += self.codes[w] >> BITS
        order = weights * len(places) - np.arange(len(places))  # ties to the smaller place
        best = np.argpartition(-order, top - 1, axis=1)[:, :top]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(order, best, 1), axis=1), 1)
        for row, (i, words, k) in enumerate(group):
            mine, weight = places[best[row]], weights[row, best[row]].astype(np.int64)
            if weight[-1] > 0 and (self.codes[words[k + 1 :]] >> BITS).sum() < weight[-1]:
                hits = ((asks[row] > 0) @ has[:, best[row]]).astype(np.int64) + sum((self._has(w, mine).astype(np.int64) for w in words[:k]), np.zeros(top, np.int64))
                found[i] = mine, hits, weight


def _listed(block: Block, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], top: int) -> list[pa.ListArray]:
    """The ids, hits and weights of the first works of each query, from the places that ``firsts`` gives."""
    places, hits, weights = (np.concatenate([f[k] for f in found]) for k in range(3))
    query = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    lists = block.ids.take(pa.array(places))
    each = np.repeat(np.arange(len(places)), pc.list_value_length(lists).to_numpy())
    t = pa.table({"query": query[each], "weight": weights[each], "id": lists.flatten(), "hits": hits[each]})
    t = t.take(pc.sort_indices(t, [("query", "ascending"), ("weight", "descending"), ("id", "ascending")]))
    query = t["query"].to_numpy()
    t = t.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < top))
    ends = pa.array(np.searchsorted(t["query"].to_numpy(), np.arange(len(found) + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, t[c].combine_chunks()) for c in ("id", "hits", "weight")]


def _parts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """How long each list is, and what they hold."""
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()


def _open(found: list[pa.ListArray], codes: np.ndarray, sizes: np.ndarray, own: np.ndarray, top: int) -> np.ndarray:
    """Which queries other blocks may have works for: ``found`` are answers of one block, ``own`` the sorted codes that are in no other."""
    at = np.searchsorted(own, codes)
    at[at == len(own)] = 0
    outside = np.where(own[at] == codes, 0, codes >> BITS) if len(own) else codes >> BITS
    most = np.add.reduceat(outside, np.cumsum(sizes) - sizes)
    places, weights = _parts(found[2])
    ends = np.cumsum(places)
    least = np.where(places == top, weights[np.maximum(ends - 1, 0)] if len(weights) else 0, 1)
    return most >= least


def _answers(top: int, first: int, parted: np.ndarray, home: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (slot, asked, ids, qid, codes), in each slot the block's sets before the queries: (qid, whole, ids, hits, weights), where
    a query of a slot in ``parted`` has other answers in other blocks. With ``home`` rows without ids and qid tell which codes are in no other
    block, and a query is whole unless other blocks may have works that come before its last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held, own, block = None, [], [], None
        for batch in batches:
            slots, asked = batch.column("slot").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            ids, qid, lists = batch.column("ids"), batch.column("qid"), batch.column("codes")
            ends, codes = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(slots) != 0) | (asked[1:] != asked[:-1])) + 1), len(slots)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if slots[lo] != slot:
                    slot, held, own, block = slots[lo], [], [], None
                mine, sizes, words = ids.slice(lo, hi - lo), np.diff(ends[lo : hi + 1]), codes[ends[lo] : ends[hi]]
                if not asked[lo]:
                    sets = mine.is_valid().to_numpy(zero_copy_only=False)
                    each = np.repeat(sets, sizes)
                    held.append((mine.filter(pa.array(sets)), sizes[sets], words[each]))
                    own.append(words[~each])
                    continue
                if block is None:
                    block, held, own = Block(held, ids.type), [], np.sort(np.concatenate(own or [np.empty(0, np.int64)]))
                if not home and not len(block.ids):
                    continue
                found = _listed(block, block.many(words, sizes, top, first), top)
                whole = pa.array(~_open(found, words, sizes, own, top)) if home else pa.repeat(pa.scalar(not parted[slot]), hi - lo)
                yield pa.RecordBatch.from_arrays([qid.slice(lo, hi - lo), whole, *found], names=["qid", "whole", "ids", "hits", "weights"])

    return run


def _realms(rows: DataFrame) -> DataFrame:
    return rows if "realm" in rows.columns else rows.withColumn("realm", F.lit(""))


@dataclass
class WordIndex:
    """``sets``: realm, ids (the smallest) of works with the same words, codes of these. ``words``: realm, word, df, code, hot.
    ``profiles``: pid, codes of hot words, and the smallest ids that have just these among the hot ones."""

    sets: DataFrame
    words: DataFrame
    profiles: DataFrame

    @staticmethod
    def build(works: DataFrame, power: int = 2, path: str | None = None, total: int | None = None) -> WordIndex:
        """An index of (work_id, words), or (work_id, realm, words): then a word is another word in another realm, and works in several
        realms, which have as many rows, are ``total``. A word weighs ln(1 + N / df) to the ``power``, in whole thousandths, so that
        sums do not depend on order. With ``path`` its tables are kept there, for ``open``; without, in the shared folder."""
        named = _realms(works).filter(F.size("words") > 0).withColumn("set", F.struct("realm", "words"))
        count = named.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
        equal = _smallest(named, "set", "work_id").join(count, "set").select("set.realm", "set.words", "ids", "n", F.monotonically_increasing_id().alias("sid"))
        equal, _ = write_table(equal, "equal-works")
        total = F.lit(int(equal.agg(F.sum("n").alias("n")).first()["n"] or 0) if total is None else total)
        posts = equal.select("sid", "realm", F.explode("words").alias("word"), "n")
        df, _ = write_table(posts.groupBy("realm", "word").agg(F.sum("n").alias("df")), "frequencies")
        idf = F.ln(1 + total / F.col("df"))
        weight = F.round((idf if power == 1 else F.pow(idf, F.lit(power))) * 1000).cast("long")
        code = F.shiftleft(weight, BITS) + F.col("number")
        words = _keep(numbered(df, [F.col("realm"), F.col("word")]).select("realm", "word", "df", code.alias("code"), (F.col("df") * HOT >= total).alias("hot")), "words", path)
        coded = posts.select("sid", "realm", "word").join(words.select("realm", "word", "code", "hot"), ["realm", "word"]).groupBy("sid")
        coded = coded.agg(F.array_sort(F.collect_list("code")).alias("codes"), F.array_sort(F.collect_list(F.when(F.col("hot"), F.col("code")))).alias("hots"))
        sets = _keep(equal.select("sid", "realm", "ids").join(coded, "sid").drop("sid"), "sets", path)
        profiles = _smallest(sets.filter(F.size("hots") > 0).select(F.col("hots").alias("codes"), F.explode("ids").alias("work_id")), "codes", "work_id")
        return WordIndex(sets, words, _keep(profiles.select(F.monotonically_increasing_id().alias("pid"), "codes", "ids"), "profiles", path))

    @staticmethod
    def open(spark: SparkSession, path: str) -> WordIndex:
        return WordIndex(*[spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in ("sets", "words", "profiles")])

    def search(self, asked: DataFrame, top: int = 5, first: int = FIRST) -> DataFrame:
        """(ref_id, work_id, hits, weight, rank): the ``top`` works of each (ref_id, words), ties to the smaller work_id."""
        asked = self.keyed(asked)
        return self.told(asked, self.answers(asked, top, first))

    @staticmethod
    def keyed(asked: DataFrame) -> DataFrame:
        """asked (ref_id, words), and a realm where the index has some, with the key ``aid`` of what is asked."""
        return _realms(asked).filter(F.size("words") > 0).withColumn("aid", _digest("realm", "words"))

    @staticmethod
    def told(asked: DataFrame, answers: DataFrame) -> DataFrame:
        """The rows of ``search``, from ``keyed`` rows and their answers."""
        each = asked.select("ref_id", "aid").join(answers, "aid").select("ref_id", F.posexplode(F.arrays_zip("ids", "hits", "weights")).alias("at", "w"))
        return each.select("ref_id", F.col("w.ids").alias("work_id"), F.col("w.hits").alias("hits"), F.col("w.weights").alias("weight"), (F.col("at") + 1).alias("rank"))

    def answers(self, asked: DataFrame, top: int = 5, first: int = FIRST) -> DataFrame:
        """(aid, ids, hits, weights), a row for each aid of ``keyed`` rows that has any, the first works first; a written table."""
        if top > KEEP:
            raise ValueError(f"an index keeps {KEEP} ids of equal works")
        once = asked.groupBy("aid").agg(F.first("realm").alias("realm"), F.first("words").alias("words"))
        known = once.select("aid", "realm", F.explode("words").alias("word")).join(self.words.select("realm", "word", "code", "hot"), ["realm", "word"]).groupBy("aid")
        known = known.agg(F.first("realm").alias("realm"), F.sort_array(F.collect_list("code"), asc=False).alias("codes"), F.bool_and("hot").alias("hot"))
        known, _ = write_table(known.withColumn("qid", _digest("codes")), "known-words")
        queries, _ = write_table(known.groupBy("qid").agg(F.first("realm").alias("realm"), F.first("codes").alias("codes"), F.first("hot").alias("hot")), "queries")
        found, _ = write_table(self._by_blocks(queries.filter("not hot"), top, max(top, first)), "found")
        rows = found.filter("not whole").select("qid", F.explode(F.arrays_zip("ids", "hits", "weights")).alias("w")).select("qid", F.col("w.ids").alias("work_id"), "w.hits", F.col("w.weights").alias("weight"))
        rows = rows.unionByName(self._by_profile(queries.filter("hot"), top))
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("weight"), "work_id"))
        merged = rows.withColumn("at", place).filter(F.col("at") <= top).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "work_id", "hits", "weight"))).alias("w"))
        merged = merged.select("qid", F.col("w.work_id").alias("ids"), F.col("w.hits").alias("hits"), F.col("w.weight").alias("weights"))
        ranked = found.filter("whole and size(ids) > 0").select("qid", "ids", "hits", "weights").unionByName(merged)
        return write_table(known.select("aid", "qid").join(ranked, "qid").drop("qid"), "answers")[0]

    def _slots(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, int, np.ndarray]:
        """Realms that are asked for; the large ones with the slots of their blocks and chunks; the number of slots that others share; of each
        slot whether it holds one of several blocks. Large realms are few: each has a task's share of the queries, or a block of sets."""
        spark = queries.sparkSession
        held, wanted = (t.groupBy("realm").agg(F.count(F.lit(1)).alias(n)) for t, n in ((self.sets, "sets"), (queries, "asked")))
        realms, _ = write_table(held.join(wanted, "realm"), "realms")
        tasks, asked = max(partitions(spark), spark.sparkContext.defaultParallelism), int(realms.agg(F.sum("asked").alias("n")).first()["n"] or 0)
        share = max(LEAST, min(CHUNK, -(-asked // tasks)))
        large = (F.col("sets") > BLOCK) | (F.col("asked") > share)
        rest = realms.filter(~large).agg(F.sum("sets").alias("sets"), F.sum("asked").alias("asked")).first()
        bundles = max(1, -(-(rest["sets"] or 0) // BLOCK), -(-(rest["asked"] or 0) // share))
        parted, rows = [False] * bundles, []
        for r in realms.filter(large).collect():
            blocks, own = max(1, -(-r["sets"] // BLOCK)), -(-tasks * r["asked"] // asked)
            chunks = max(1, -(-r["asked"] // CHUNK), min(-(-r["asked"] // LEAST), -(-own // blocks)))
            rows.append((r["realm"], len(parted), blocks, chunks))
            parted += [blocks > 1] * (blocks * chunks)
        kind = realms.schema["realm"].dataType.simpleString()
        return realms, spark.createDataFrame(rows, f"realm {kind}, base int, blocks int, chunks int"), bundles, np.array(parted)

    def _anchor(self) -> Column:
        """The code of a row's anchor, null where it has none."""
        weight = lambda cond, which: which(F.when(cond, _weight("code")))
        span = self.words.agg(weight(F.col("df") * SHARE <= BLOCK, F.min).alias("lo"), weight(F.col("df") >= ANCHOR, F.max).alias("hi")).first()
        if None in span:
            return F.lit(None).cast("long")
        return F.array_max(F.filter("codes", lambda c: F.shiftright(c, BITS).between(span["lo"], span["hi"])))

    def _by_anchors(self, queries: DataFrame, top: int, first: int, blocks: int) -> DataFrame:
        """What ``_by_blocks`` gives, of an index without realms whose sets fill several blocks: (block, codes) of sets and of queries follow
        from their anchors, those without are dealt evenly."""
        spark = queries.sparkSession
        anchor = self._anchor()
        home = lambda other: F.pmod(F.when(anchor.isNull(), F.xxhash64(other)).otherwise(F.xxhash64(anchor)), F.lit(blocks)).cast("int").alias("b")
        sets, mine = self.sets.select(home(F.col("ids")[0]), "ids", "codes"), queries.select(home(F.col("qid")), "qid", "codes", anchor.alias("like"))
        tasks, load = max(partitions(spark), spark.sparkContext.defaultParallelism), mine.groupBy("b").count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
        most, n = load["most"] or 0, load["n"] or 1
        chunks = max(1, -(-most // CHUNK), min(-(-most // LEAST), -(-tasks * most // n)))
        kind = sets.schema["ids"].dataType.simpleString()
        none = {"ids": F.lit(None).cast(kind), "qid": F.lit(None).cast("binary"), "like": F.lit(None).cast("long")}
        rows = lambda df, asked_: df.select((F.col("b") * chunks + F.col("c")).alias("slot"), F.lit(asked_).alias("asked"), *[F.col(c) if c in df.columns else v.alias(c) for c, v in none.items()], "codes")
        every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c")
        chunk = F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int").alias("c")

        def met(*parts: DataFrame) -> DataFrame:
            held = reduce(DataFrame.unionByName, [rows(p, "qid" in p.columns) for p in parts])
            return held.repartitionById(blocks * chunks, "slot").sortWithinPartitions("slot", "asked", "like")  # like queries are weighed together

        out = f"qid binary, whole boolean, ids {kind}, hits array<long>, weights array<long>"
        alone = sets.select("b", F.explode("codes").alias("code")).groupBy("code").agg(F.min("b").alias("b"), F.max("b").alias("_b")).filter("b = _b")
        alone = alone.groupBy("b", F.pmod(F.xxhash64("code"), F.lit(64))).agg(F.collect_list("code").alias("codes")).select("b", "codes")
        near, _ = write_table(met(sets.select("*", every), alone.select("*", every), mine.select("*", chunk)).mapInArrow(_answers(top, first, np.zeros(0), True), out), "found-near")
        if near.filter("not whole").isEmpty():
            return near
        rest = mine.join(near.filter("not whole").select("qid"), "qid", "left_semi")
        others = rest.select("qid", "codes", "like", F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: x != F.col("b"))).alias("b"))
        far = met(sets.select("*", every), others.select("*", chunk)).mapInArrow(_answers(top, first, np.ones(blocks * chunks, bool)), out)
        return near.unionByName(far)

    def _by_blocks(self, queries: DataFrame, top: int, first: int) -> DataFrame:
        """(qid, whole, ids, hits, weights): the first works of each block for each query (qid, realm, codes)."""
        size = self.sets.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("realm") != "").alias("named")).first()
        if size["n"] > BLOCK and not size["named"]:
            return self._by_anchors(queries, top, first, -(-3 * size["n"] // (2 * BLOCK)))
        realms, large, bundles, parted = self._slots(queries)
        dealt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        placed = lambda rows: rows.join(F.broadcast(large), "realm", "left")
        slot = F.when(F.col("base").isNull(), dealt("realm", F.lit(bundles))).otherwise(F.col("base") + F.col("b") * F.col("chunks") + F.col("c")).alias("slot")
        one = F.coalesce("blocks", F.lit(1)), F.coalesce("chunks", F.lit(1))
        mine = placed(self.sets.join(realms.select("realm"), "realm", "left_semi")).withColumn("b", dealt(F.col("ids")[0], one[0])).select("*", each(F.col("chunks")).alias("c"))
        mine = mine.select(slot, F.lit(False).alias("asked"), "ids", F.lit(None).cast("binary").alias("qid"), "codes", F.lit(None).cast("long").alias("like"))
        theirs = placed(queries).withColumn("c", dealt("qid", one[1])).select("*", each(F.col("blocks")).alias("b"))
        kind = mine.schema["ids"].dataType.simpleString()
        anchor = self._anchor()
        theirs = theirs.select(slot, F.lit(True).alias("asked"), F.lit(None).cast(kind).alias("ids"), "qid", "codes", anchor.alias("like"))
        met = mine.unionByName(theirs).repartitionById(len(parted), "slot").sortWithinPartitions("slot", "asked", "like")
        return met.mapInArrow(_answers(top, first, parted), f"qid binary, whole boolean, ids {kind}, hits array<long>, weights array<long>")

    def _by_profile(self, queries: DataFrame, top: int) -> DataFrame:
        """(qid, work_id, hits, weight): the first works by hot words alone."""
        one, other = queries.select("qid", F.explode("codes").alias("code")), self.profiles.select("pid", F.explode("codes").alias("code"))
        met = one.join(other, "code").groupBy("qid", "pid").agg(F.count(F.lit(1)).alias("hits"), F.sum(_weight("code")).alias("weight"))
        # the best profiles hold the best works: each has one that comes before all of the next
        placed = met.join(self.profiles.select("pid", "ids"), "pid").withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("weight"), F.col("ids")[0])))
        return placed.filter(F.col("_k") <= top).select("qid", F.explode("ids").alias("work_id"), "hits", "weight")


def phrase_words(title: Column) -> Column:
    """The words of a title in their order, each as often as it stands."""
    return F.filter(F.split(normalize_text(title), " "), lambda w: w != "")


def _grams(words: str = "words") -> Column:
    """(gram, at) of each word that has a next one together with it, or of the only word."""
    both = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(F.col(words), i + 1)).alias("gram"), i.alias("at")))
    return F.when(F.size(words) > 0, both)


@dataclass
class PhraseIndex:
    """``titles``: tid, ids, words in order. ``postings``: gram, tid, at, where a gram is a word with the next one, or a
    single word. ``grams``: gram, df."""

    titles: DataFrame
    postings: DataFrame
    grams: DataFrame

    @staticmethod
    def build(works: DataFrame, path: str | None = None) -> PhraseIndex:
        """An index of (work_id, words); works with the same words in the same order are one title."""
        titles = _keep(_smallest(works.filter(F.size("words") > 0), "words", "work_id").withColumn("tid", F.col("ids")[0]), "titles", path)
        pairs = titles.select("tid", F.explode(_grams()).alias("g")).select("g.gram", "tid", "g.at")
        single = titles.select("tid", F.posexplode("words").alias("at", "gram")).select("gram", "tid", "at")
        both = pairs.filter(F.contains("gram", F.lit(" "))).unionByName(single)
        postings = _keep(both.repartitionByRange("gram", "tid").sortWithinPartitions("gram", "tid"), "phrase-postings", path)
        return PhraseIndex(titles, postings, _keep(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "grams", path))

    @staticmethod
    def open(spark: SparkSession, path: str) -> PhraseIndex:
        return PhraseIndex(*[spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in ("titles", "phrase-postings", "grams")])

    def search(self, asked: DataFrame, top: int = 5) -> DataFrame:
        """(ref_id, work_id, rank): the ``top`` works, by work_id, in whose title the words stand one after another.

        The rarest gram of a phrase gives the titles and, shifted by its place, where the phrase would begin; the words from
        there are then compared. The number of places is cut only after that.
        """
        asked = asked.filter(F.size("words") > 0)
        phrases, _ = write_table(asked.select("words").distinct().withColumn("pid", F.monotonically_increasing_id()), "phrases")
        each = phrases.select("pid", "words", F.explode(_grams()).alias("g")).select("pid", F.size("words").alias("size"), "g.gram", "g.at")
        known = each.join(self.grams, "gram")
        whole = F.count(F.lit(1)).alias("n"), F.min(F.struct("df", "at", "gram")).alias("rarest"), F.first("size").alias("size")
        # a phrase with a gram that no title has is in none
        lead = known.groupBy("pid").agg(*whole).filter(F.col("n") == F.greatest(F.col("size") - 1, F.lit(1))).select("pid", "rarest.gram", F.col("rarest.at").alias("_at"))
        begun = lead.join(self.postings, "gram").filter(F.col("at") >= F.col("_at")).select("pid", "tid", (F.col("at") - F.col("_at")).alias("begin"))
        there = begun.join(phrases, "pid").join(self.titles.select("tid", "ids", F.col("words").alias("title")), "tid")
        held = there.filter(F.slice("title", F.col("begin") + 1, F.size("words")) == F.col("words")).select("pid", F.explode("ids").alias("work_id")).distinct()
        place = F.row_number().over(Window.partitionBy("pid").orderBy("work_id"))
        ranked = held.withColumn("rank", place).filter(F.col("rank") <= top)
        return asked.select("ref_id", "words").join(phrases, "words").join(ranked, "pid").select("ref_id", "work_id", "rank")
