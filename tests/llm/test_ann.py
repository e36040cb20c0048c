"""Nearest neighbours against brute force: ties, spread and huge lengths, odd rows, and what the trees leave out."""

import numpy as np
import pytest

from biblens.llm import ann
from biblens.llm.queries import op7_vp_tree


def brute(ids, x, every=20, k=20):
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        v = min(tuple(r) for i, r in zip(ids, x.tolist(), strict=True) if i == q)
        s = (x * np.array(v)).sum(1)
        out[q] = sorted((-s[j], i) for j, i in enumerate(ids) if i != q and not np.isnan(s[j]))[:k]
    return out


def answers(spark, ids, x, extra=(), **options):
    rows = [(int(i), [float(v) for v in r], 1, "r") for i, r in zip(ids, x, strict=True)]
    table = spark.createDataFrame([*rows, *((i, v, 1, "r") for i, v in extra)], "vec_id long, embedding array<double>, dim int, rank string")
    got = {}
    for r in sorted(ann.search(table, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_odd_rows_and_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[50:120] = x[7]
    odd = [(400, None), (440, [0.0] * 8), (460, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (None, [1.0] * 8), (480, [1.0, 2.0]), (500, []), (520, [float("inf")] * 8)]
    assert answers(spark, range(400), x, odd, shard=100) == brute(range(400), x)


def test_all_ties_count(spark):
    """More vectors with the k-th score than k: the smallest ids are taken, wherever the trees put them."""
    rng = np.random.default_rng(5)
    x = np.zeros((1200, 6))
    x[:, 0] = 1
    x[:, 1:] = rng.integers(-8, 8, (1200, 5))
    x[::20, 1:] = 0
    ids = rng.permutation(1200)
    got = answers(spark, ids, x, shard=128)
    assert got == brute(ids.tolist(), x)
    assert any(len({s for s, _ in v}) == 1 for v in got.values())


def test_repeated_ids_are_one_query(spark):
    x = np.array([[1.0, 0], [0, 1], [0.5, 0.5], [0.2, 0.1], [3, 3]])
    ids = [20, 20, 1, 2, 40]
    assert answers(spark, ids, x) == brute(ids, x)


@pytest.mark.parametrize("long", [1, 10, 1e3, 1e160, 1e300])
def test_spread_and_huge_lengths(spark, long):
    rng = np.random.default_rng(4)
    for dim in (4, 32):
        x = rng.normal(size=(3000, dim)) * rng.uniform(0.2, 2, (3000, 1))
        x[5] *= long
        x[60] *= long
        q = np.arange(0, 3000, 20)
        with np.errstate(over="ignore", invalid="ignore"):
            want = brute(range(3000), x)
        ids, scores = ann.Tree(np.arange(3000), x).search(q, x[q])
        for i, row, s in zip(q.tolist(), ids, scores, strict=True):
            assert [(-b, a) for a, b in zip(row.tolist(), s.tolist(), strict=True) if a != ann.NO_ID] == want[i]


def test_huge_lengths_in_the_query(spark):
    x = np.array([[1e200, 0], [1, 0], [0, 1], [-1, 0], [1e200, 1e200]])
    ids = [20, 1, 2, 3, 40]
    got = answers(spark, ids, x)
    assert got[20] == [(-np.inf, 40), (-1e200, 1), (0.0, 2), (1e200, 3)] and len(got[40]) == 4


def test_pruning():
    """Trees leave subtrees out, more with a smaller factor; factor one loses nothing. Random directions in 64 dimensions leave little out."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64))
    near = centres[rng.integers(0, 40, 8000)] + 0.15 * rng.normal(size=(8000, 64))
    near *= rng.uniform(0.2, 2, (8000, 1))
    near[5] *= 1000
    few = rng.normal(size=(8000, 6))
    for x, most in ((near, 0.75), (few, 0.8)):
        q = np.arange(0, 8000, 40)
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        want = np.argsort(-s, axis=1, kind="stable")[:, :20]
        shares = []
        for factor in (1.0, 0.85, 0.6):
            tree = ann.Tree(np.arange(8000), x)
            got, _ = tree.search(q, x[q], 20, factor)
            recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got.tolist(), want.tolist(), strict=True)])
            shares.append(tree.compared / (len(q) * 8000))
            assert recall == 1 if factor == 1 else recall >= 0.9
        assert shares[0] < most and shares[0] > shares[1] > shares[2]


def test_shards_are_left_out(spark):
    """Queries go to those shards only that can hold something above their floor."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    seen = []
    kept, ann._answers = ann._answers, lambda rows, k, factor: (seen.append(rows), kept(rows, k, factor))[1]
    try:
        got = answers(spark, range(4000), x, shard=200, team=1)
    finally:
        ann._answers = kept
    assert got == brute(range(4000), x)
    asked = [r.filter("asks").count() for r in seen]
    assert asked[0] == 200 and asked[1] < 200 * 19 / 2


@pytest.mark.parametrize("team", [1, 3, 7, 32])
def test_teams_of_shards(spark, team):
    """A query travels once to a team of shards, whatever their number; lengths, copies and ties as before."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2000, 24)) * rng.choice([0.2, 1, 3], size=(2000, 1))
    x[300:900] = x[5]
    seen = []
    kept, ann._answers = ann._answers, lambda rows, k, factor: (seen.append(rows), kept(rows, k, factor))[1]
    try:
        got = answers(spark, range(2000), x, [(2020, [1.0, 2.0]), (2003, [2.0, 1.0])], shard=50, team=team)
    finally:
        ann._answers = kept
    want = brute(range(2000), x)
    want[2020] = [(-4.0, 2003)]
    assert got == want
    asked = seen[1].filter("asks").groupBy("vec_id").count().agg({"count": "max"}).first()[0]
    shards = seen[1].filter("not asks and dim = 24").select("team", "slot").distinct().count()
    assert asked <= -(-shards // team) + 1 and shards >= 40


def test_registered_query(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(100, 8)).astype(np.float32)
    spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = op7_vp_tree(spark, str(tmp_path))
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "double"]
    want = {(q, i + 1, v, -s) for q, row in brute(range(100), x.astype(float)).items() for i, (s, v) in enumerate(row)}
    assert {tuple(r) for r in out.collect()} == want
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
