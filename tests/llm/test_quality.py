"""The classifier: an independent forward pass, the sample it learns from, held-out documents, odd tables."""

import math
import random
import zlib

import numpy as np

from biblens.llm import quality
from biblens.llm.queries import op4_quality

WORDS = "river stone quiet market window letter garden morning traveller bridge harvest lantern".split()


def text(i: int, good: bool, n: int = 120) -> str:
    r = random.Random(i)
    words = [r.choice(WORDS) for _ in range(n)]
    return " ".join(words) if good else " ".join(w.upper() + "!!" if r.random() < 0.6 else w for w in words)


def labelled(n: int):
    return [(i, text(i, i % 3 > 0), 0) for i in range(n)], [(i, int(i % 3 > 0), 0) for i in range(n)]


def test_forward_pass():
    """Passage by passage in plain Python: tanh encoder, gated attention, weighted bag, logistic output."""
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(rng.integers(1, 7), quality.FEATURES)).astype(np.float32) for _ in range(40)]
    labels = np.array([float(b[:, 0].max() > 0.5) for b in bags])
    model = quality.fit(bags, labels)
    p = {k: v.astype(float) for k, v in model.params.items()}
    x, first = np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    got = model.score(x, first)
    for bag, score in zip(bags, got, strict=True):
        coded, logits = [], []
        for row in bag.astype(float):
            z = [min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale, strict=True)]
            h = [math.tanh(sum(a * b for a, b in zip(z, p["E"][:, j], strict=True)) + p["e"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(a * b for a, b in zip(h, p["V"][:, j], strict=True))) / (1 + math.exp(-sum(a * b for a, b in zip(h, p["U"][:, j], strict=True)))) for j in range(quality.GATE)]
            coded.append(h)
            logits.append(sum(a * b for a, b in zip(gate, p["w"], strict=True)))
        e = [math.exp(v) for v in logits]
        bagged = [sum(w * h[j] for w, h in zip(e, coded, strict=True)) / sum(e) for j in range(quality.HIDDEN)]
        want = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(bagged, p["c"], strict=True)) + p["b"][0])))
        assert abs(score - want) < 1e-4


def test_one_passage_decides():
    """Bags that differ in one of six passages are told apart."""
    rng = np.random.default_rng(2)
    bags = []
    for i in range(300):
        b = np.zeros((6, quality.FEATURES), np.float32)
        b[:, :3] = rng.normal(size=(6, 3))
        if i % 2:
            b[rng.integers(6), 3] = 4
        bags.append(b)
    labels = np.arange(300) % 2
    model = quality.fit(bags[:200], labels[:200])
    x, first = np.concatenate(bags[200:]), np.arange(101) * 6
    score = model.score(x, first)
    assert ((score >= 0.5) == labels[200:]).mean() > 0.9


def test_held_out_documents(spark, tmp_path):
    docs, labels = labelled(400)
    spark.createDataFrame([(i, t, "score", 0.0) for i, t, _ in docs], "doc_id long, text string, score string, y double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = op4_quality(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r["doc_id"]: r for r in out.collect()}
    truth = {i: y for i, y, _ in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] is (i in set(held)) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.95


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = labelled(120)
    table = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 0) for i, y, _ in labels]
    a, b = (quality.train(table, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert all((a.params[k] == b.params[k]).all() for k in a.params)


def test_the_sample_is_bounded_and_the_same_each_time(spark):
    docs, labels = labelled(200)
    long = [(1000 + i, text(i, True, 20_000), 0) for i in range(6)]
    table = spark.createDataFrame([(str(i), t) for i, t, _ in docs + long], "doc_id string, text string")
    lab = spark.createDataFrame([(str(i), y, 0) for i, y, _ in [*labels, *((i, 0, 0) for i, _, _ in long)]], "doc_id string, quality int, toxic int")
    seen = []
    kept, quality.fit = quality.fit, lambda bags, y, seed=7: (seen.append((sum(map(len, bags)), len(bags))), kept(bags, y, seed))[1]
    try:
        models = [quality.train(t, lab, most=100, most_bytes=40_000) for t in (table, table.repartition(9))]
    finally:
        quality.fit = kept
    assert seen[0] == seen[1] and 10 < seen[0][1] <= 100 and seen[0][0] < 100 * 6
    assert all((models[0].params[k] == models[1].params[k]).all() for k in models[0].params)
    assert {r["doc_id"] for r in quality.score(table, models[0]).collect()} == {str(i) for i, _, _ in docs + long}


def test_odd_tables(spark):
    columns = "doc_id long, text string"
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, ""), (None, "x"), (3, "y" * 3_000_000), (3, "word " * 300_000)], columns)
    model = quality.train(docs, labels)
    scores = sorted(r["score"] for r in quality.score(docs, model).collect())
    assert len(scores) == 7 and all(0 <= s <= 1 for s in scores)
    empty = spark.createDataFrame([], columns)
    assert quality.train(empty, labels).rate == 0.5 and quality.train(docs, labels.limit(0)).rate == 0.5
    assert quality.score(empty, model).count() == quality.keep_good(empty, model).count() == 0
    assert quality.train(docs, labels.filter("doc_id = 1")).rate in (0.5, 1.0)
