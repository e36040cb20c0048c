"""The mix's tables against the form for few sources, its counts, and that reruns and partitions do not matter."""

import random

import numpy as np
import pytest

from biblens.llm import mixing
from biblens.llm.queries import op6_mixing


def documents(n: int, sources: int, seed: int = 1):
    r = random.Random(seed)
    names = [None, "", "é", "B", "a", *(f"s{i:04}" for i in range(sources))]
    return [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])) or None, names[min(int(r.expovariate(0.7)), len(names) - 1)]) for i in range(n)]


def check(rows, got, block, slack):
    size = {i: len((t or "").split()) for i, t, _ in rows}
    per = {}
    for i, _, s in rows:
        per[s] = per.get(s, 0) + size[i]
    order = sorted(per, key=lambda s: (s is None, (s or "").encode("utf-8")))
    goal = dict(zip(order, mixing.targets([per[s] for s in order], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(order))]), strict=True))
    taken = dict.fromkeys(per, 0)
    for i, _, s in rows:
        assert (got[i]["size"], got[i]["source_size"]) == (size[i], per[s]) and got[i]["target"] == pytest.approx(goal[s], rel=1e-12)
        assert 0 <= got[i]["taken"] <= 3 * size[i]
        taken[s] += got[i]["taken"]
    for s in per:
        assert abs(taken[s] - goal[s]) <= slack * block


@pytest.mark.parametrize("sources", [2, 300])
def test_against_the_plain_form(spark, sources):
    rows = documents(400 if sources == 2 else 1500, sources)
    if sources > 2:
        rows = [(i, t, s if k % 3 else f"only{i % 200}") for k, (i, t, s) in enumerate(rows)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_counts(table, block=8, shard=64)
    got = {r["doc_id"]: r for r in out.collect()}
    check(rows, got, 8, 3)
    again = mixing.mix_counts(table.repartition(7), block=8, shard=64)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.values()))


def test_shards(spark, monkeypatch):
    """Every draw is in one shard, shards are about equally large, and their counts of a source spread as a multinomial does."""
    monkeypatch.setattr(mixing, "GROUP", 16)
    draws = {0: 64_000, 1: 16_000, 2: 7, 3: 0}
    sources = spark.createDataFrame([(i, 500, d) for i, d in draws.items()], "source_no long, blocks long, draws long")
    rows = mixing.deal_slots(sources, 1000, 5).collect()
    per, counts = {}, {}
    for r in rows:
        per.setdefault(r["source_no"], []).append(r["block"])
        counts[r["shard"], r["source_no"]] = counts.get((r["shard"], r["source_no"]), 0) + 1
    assert {i: len(b) for i, b in per.items()} == {i: d for i, d in draws.items() if d}
    shards = -(-sum(draws.values()) // 1000)
    assert {k for k, _ in counts} == set(range(shards))
    for i in (0, 1):
        times = np.bincount(per[i], minlength=500)
        assert times.min() == draws[i] // 500 and times.max() == -(-draws[i] // 500)
        n = np.array([counts.get((k, i), 0) for k in range(shards)])
        assert 0.5 < n.var() / n.mean() < 1.6


def test_registered_query(spark, tmp_path):
    rows = documents(300, 3)
    table = spark.createDataFrame([(i, t, s, "size", 1) for i, t, s in rows], "doc_id long, text string, source string, size string, uid long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    out = op6_mixing(spark, str(tmp_path))
    assert [(c, t) for c, t in out.dtypes] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    check(rows, {r["doc_id"]: r for r in out.collect()}, mixing.BLOCK, 3)


def test_odd_tables(spark):
    columns = "doc_id long, text string, source string"
    assert mixing.mix_counts(spark.createDataFrame([], columns)).count() == 0
    none = mixing.mix_counts(spark.createDataFrame([(1, None, "a"), (2, " \n", None)], columns)).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    one = mixing.mix_counts(spark.createDataFrame([(1, "w " * 100_000, "a")], columns)).first()
    assert tuple(one) == (1, 100_000, 100_000, 100_000.0, 100_000)
