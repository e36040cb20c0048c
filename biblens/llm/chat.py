"""Chat formatting: conversations become windows of turns within a budget of tokens, with a loss mask.

Turns cost their words and ``TURN_TOKENS`` for their marks. Prefix sums of these costs choose each window's span,
aligned to turns: as many new turns as the budget leaves beside the system turn, which every window repeats, and
up to ``HISTORY_TURNS`` turns (and ``HISTORY`` tokens) of those just before. A new turn that alone exceeds what is
left has a window of its own. The mask holds the texts of assistant turns where they are new, never where they
are repeated, so each is learned once.

The template marks turns by control strings; where these stand in a text or role, a backslash is put after their first
character, or one more where backslashes stand there, so that no control string is left and the text comes back exactly.

A conversation of over ``BLOCK`` tokens is dealt to blocks by the prefix sums of its turns, so no task holds
a whole one: windows end at the blocks' ends, and the turns that the next block repeats are sent to it too.

Turns are in order of turn (null last), then role, then the MD5 digest of the text; repeated turns all count. A null text is empty, a null role an
empty one; only the first turn can be a system turn that is kept. Rows with a null conv_id are one conversation.
Very long texts are never cut. An empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblens.llm.common import join_hot, pick, prefix_sums
from biblens.runtime import partitions, write_table

BUDGET, HISTORY, HISTORY_TURNS, TURN_TOKENS = 2048, 256, 4, 4
#: Tokens of a conversation that one task works on at a time.
BLOCK = 64 * BUDGET

# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
_ANGLE, _SQUARE = (rf"(?:{'|'.join(re.escape(c[1:]) for c in CONTROL if c[0] == first)})" for first in "<[")
_ESCAPE = re.compile(rf"(?<=<)(?=\\*{_ANGLE})|(?<=\[)(?=\\*{_SQUARE})")
_UNESCAPE = re.compile(rf"(?<=<)\\(?=\\*{_ANGLE})|(?<=\[)\\(?=\\*{_SQUARE})")
#: What stands before and after a turn's text; other roles are named.
MARKS = {"system": ("<s><<SYS>>", "<</SYS>></s>"), "user": ("<s>[INST]", "[/INST]</s>"), "assistant": ("<s>", "</s>")}
_TURN = re.compile(r"<s>(?:<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<<ROLE>>(?P<role>.*?)<</ROLE>>(?P<other>.*?)|(?P<assistant>.*?))</s>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn, and where its escaped text begins and ends in it."""
    before, after = MARKS.get(role) or (f"<s><<ROLE>>{escape(role)}<</ROLE>>", "</s>")
    inner = escape(text)
    return before + inner + after, len(before), len(before) + len(inner)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in a window."""
    for m in _TURN.finditer(formatted):
        role = next(k for k in ("role", "system", "user", "assistant") if m[k] is not None)
        yield (unescape(m["role"]), unescape(m["other"])) if role == "role" else (role, unescape(m[role]))


def spans(costs: np.ndarray, first: int, room: int, history: int, most_turns: int) -> Iterator[tuple[int, int, int]]:
    """(first repeated turn, first new turn, end) of each window over turns of given costs; new ones begin at ``first``."""
    p = np.concatenate([[0], np.cumsum(costs)])
    i, n = first, len(costs)
    while i < n:
        h = max(i - most_turns, 0, int(np.searchsorted(p, p[i] - history)), int(np.searchsorted(p, p[i + 1] - room)))
        h = min(h, i)
        end = max(i + 1, int(np.searchsorted(p, p[h] + room, "right")) - 1)
        yield h, i, end
        i = end


def windows(turns: list[tuple[str, str, int]], first: int, system: tuple[str, str, int] | None, new_system: bool, budget: int, history: int, most_turns: int) -> Iterator[tuple[int, str, list[dict]]]:
    """(repeated turns, text, mask) of each window. ``turns`` are (role, text, cost), the first ``first`` of them repeated ones."""
    costs = np.array([t[2] for t in turns], np.int64)
    room = budget - (system[2] if system else 0)
    cuts = list(spans(costs, first, room, history, most_turns))
    if system and new_system and not cuts:
        cuts = [(0, 0, 0)]
    for k, (h, i, end) in enumerate(cuts):
        fresh = new_system and k == 0
        whole = ([system] if system else []) + turns[h:end]
        repeated = (i - h) + (1 if system and not fresh else 0)
        parts, mask, at = [], [], 0
        for place, (role, text, _) in enumerate(whole):
            part, a, b = render(role, text)
            if role == "assistant" and place >= repeated:
                mask.append({"start": at + a, "end": at + b})
            parts.append(part)
            at += len(part)
        yield repeated, "".join(parts), mask


def _tokens(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"\S+")) + TURN_TOKENS).cast("long")


NEW, HELD, REPEATED = 2, 0, 1


def _dealt(rows: DataFrame, block: int, history: int) -> DataFrame:
    """rows with their block, and what they are in it: the system turn, repeated or new. Only long conversations need prefix sums."""
    spark = rows.sparkSession
    sizes = rows.groupBy("conv_key").agg(F.sum("cost").alias("size"), F.count(F.lit(1)).alias("n")).filter(F.col("size") > block)
    whole = rows.withColumns({"block": F.lit(0).cast("long"), "kind": F.lit(NEW)})
    if not sizes.take(1):
        return whole
    big, _ = write_table(sizes, "long-conversations")
    short = whole.join(big.select("conv_key"), "conv_key", "left_anti")
    long_ = join_hot(rows, big.select("conv_key", "n"), ["conv_key"], "n").select(rows.columns)
    order = ["no_turn", "turn", "role", "tie", "nth"]
    summed = prefix_sums(long_.withColumn("nth", F.monotonically_increasing_id()), ["conv_key"], order, "cost", "since")
    summed, _ = write_table(summed.withColumn("block", F.floor(F.col("since") / block)).drop("nth"), "turns-in-blocks")
    dealt = summed.withColumn("kind", F.lit(NEW))
    again = summed.filter((F.col("block") + 1) * block - F.col("since") <= history).withColumns({"block": F.col("block") + 1, "kind": F.lit(REPEATED)})
    first = summed.filter("since = 0 and role = 'system'").withColumn("kind", F.lit(HELD))
    every = summed.filter("block > 0").select("conv_key", "block").distinct()
    held = first.drop("block").join(every, "conv_key")
    out = dealt.unionByName(again.filter("since > 0 or role <> 'system'")).unionByName(held.select(dealt.columns))
    return short.withColumn("since", F.lit(0).cast("long")).unionByName(out.select(*short.columns, "since"))


def format_conversations(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, most_turns: int = HISTORY_TURNS, block: int = BLOCK) -> DataFrame:
    """(conv_id, window, repeated, text, mask): windows in order of ``window``; ``repeated`` turns at the front stood in earlier ones.

    ``rows`` are (conv_id, turn, role, text). ``mask`` holds spans of code points of the text, end exclusive.
    """
    spark = rows.sparkSession
    own = pick(rows, conv_id="conv_id", turn="turn", role="role", text="text")
    own = own.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")})
    own = own.withColumns({"conv_key": F.struct("conv_id"), "no_turn": F.col("turn").isNull(), "tie": F.md5(F.col("text").cast("binary")), "cost": _tokens(F.col("text"))})
    dealt = _dealt(own, block, history)
    since = F.col("since") if "since" in dealt.columns else F.lit(0).cast("long")
    order = ["block", "kind", "since", "no_turn", "turn", "role", "tie"]
    ready = dealt.withColumn("since", since).repartition(partitions(spark), "conv_key", "block").sortWithinPartitions("conv_key", *order)
    kind = dict(own.dtypes)["conv_id"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for (conv, part), turns in groupby(groups(batches), key=lambda r: r[:2]):
            listed = list(turns)
            held = [r[3:] for r in listed if r[2] == HELD]
            before = [r[3:] for r in listed if r[2] == REPEATED]
            new = [r[3:] for r in listed if r[2] == NEW]
            fresh = part == 0 and new[0][0] == "system"
            system = new.pop(0) if fresh else held[0] if held else None
            if not (new or fresh):
                continue
            for k, (repeated, text, mask) in enumerate(windows(before + new, len(before), system, fresh, budget, history, most_turns)):
                out.append((conv, (part << 32) + k, repeated, text, mask))
                size += len(text)
                if size > 1 << 22:
                    yield batch(out)
                    out, size = [], 0
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        conv, window, repeated, text, mask = zip(*out, strict=True)
        spans_ = pa.array(mask, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(conv, conv_type), pa.array(window, pa.int64()), pa.array(repeated, pa.int32()), pa.array(text, pa.string()), spans_], names=["conv_id", "window", "repeated", "text", "mask"])

    conv_type = _arrow_type(spark, kind)
    return ready.select("conv_id", "block", "kind", "role", "text", "cost").mapInArrow(run, f"conv_id {kind}, window long, repeated int, text string, mask array<struct<start:int,end:int>>")


def _arrow_type(spark, kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], f"x {kind}").schema).types[0]


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest reads a conversation in order, so windows of one go through one task, which holds one at a time.
    """
    spark = formatted.sparkSession
    kind = dict(formatted.dtypes)["conv_id"]
    conv_type = _arrow_type(spark, kind)
    key = F.struct("conv_id")
    ready = formatted.repartition(partitions(spark), key).sortWithinPartitions(key, "window").select("conv_id", "repeated", "text", "mask")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                yield tuple(c[i].as_py() for c in b.columns)

    def told(conv, parts: Iterator[tuple]) -> tuple:
        turns, loss, n, masked, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, repeated, text, mask in parts:
            chars += len(text)
            for place, (role, said) in enumerate(turns_of(text)):
                if place >= repeated:
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
            for span in mask:
                said = unescape(text[span["start"] : span["end"]])
                loss.update(said.encode())
                masked += len(said)
        return conv, n, turns.hexdigest(), masked, loss.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, parts in groupby(rows(batches), key=lambda r: r[0]):
            out.append(told(conv, parts))
            if len(out) == 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return ready.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
