"""Near-duplicates: frequencies whatever the partitioning, classes against all pairs, very long texts."""

import itertools
import math
import random
import re
import weakref
from collections import Counter

import numpy as np
import pyarrow as pa

from biblens.llm import common, minhash

WORDS = "alpha beta gamma delta omega sigma kappa zeta theta iota lambda nu xi pi rho tau phi chi psi eta".split()


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]


def corpus(n: int) -> list[str]:
    """Texts, some with a common passage, some near others."""
    r = random.Random(1)
    passage = words(7, 12)
    out = []
    for i in range(n):
        own = words(100 + i, 120)
        if i % 4 == 0:
            own[10:10] = passage
        if i % 3 == 0 and out:
            own = r.choice(out).split()
            for k in range(r.randint(1, 3)):
                own[r.randrange(len(own))] = f"new{i}x{k}"
        out.append(" ".join(own))
    return out


def exact_frequencies(texts):
    df = {}
    for t in texts:
        for _, _, _, h, _ in common.shingle_sets(pa.array([t])):
            for x in h.tolist():
                df[x] = df.get(x, 0) + 1
    return {h: n for h, n in df.items() if n > minhash.FREQUENT * len(texts)}


def test_frequencies_are_exact_for_any_partitioning(spark, monkeypatch):
    texts = corpus(300)
    want = exact_frequencies(texts)
    assert len(want) > 5
    table = spark.createDataFrame([*enumerate(texts)], "uid long, text string")
    for parts, most in ((1, 256), (30, 256), (150, 256), (3, 16)):
        monkeypatch.setattr(minhash, "COUNT_TEXTS", most)
        got = minhash.frequent_shingles(table.repartition(parts))
        order = sorted(want)
        assert got.hashes.tolist() == order
        assert np.allclose(got.values, minhash.idf(np.array([want[h] for h in order], float), 300), rtol=0, atol=0)


def test_classes_against_all_pairs(spark):
    texts = corpus(240)
    n = len(texts)
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    weights = minhash.frequent_shingles(table)
    sets = [minhash.weighted_set(t, weights) for t in texts]
    root = list(range(n))
    links = 0
    for a, b in itertools.combinations(range(n), 2):
        if minhash.weighted_jaccard(sets[a], sets[b]) >= minhash.SIMILARITY:
            links += 1
            low, high = sorted((root[a], root[b]))
            root = [low if v == high else v for v in root]
    assert links > 40
    for parts in (2, 40):
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table.repartition(parts)).collect()}
        assert [got[i] for i in range(n)] == root


def test_very_long_texts(spark):
    """Words of a text beyond the size that is hashed at once are the same as those of its parts."""
    long = " ".join(words(3, 500_000))
    assert len(long) > 4 * common.CHUNK
    data, offsets = common.as_bytes(pa.array([long]))
    got, first = common.word_hashes(data, offsets)
    parts = [common.word_hashes(*common.as_bytes(pa.array([w])))[0][0] for w in long.split()[:3]]
    assert first.tolist() == [0, 500_000] and got[:3].tolist() == parts
    table = spark.createDataFrame([(1, long), (2, long + " more words here"), (3, "more words here")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table).collect()} == {1: 1, 2: 1, 3: 3}


def plain_shingles(text):
    """Five-word shingles of a text, by words and not by hashes."""
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w)))))


def test_every_frequency_counts(spark, monkeypatch):
    """Each text's own frequencies, of all its shingles, for any dealing, chunks and shards; null, empty and short texts."""
    texts = [*corpus(200), None, "", "one two", "one two", " \n"]
    df = Counter(x for t in texts for x in plain_shingles(t))
    assert sum(1 < n <= len(texts) / 10 for n in df.values()) > 1000
    table = spark.createDataFrame([*enumerate(texts)], "uid long, text string")
    for parts, most, size in ((1, 4096, 1 << 24), (30, 7, 1 << 24), (3, 64, 1 << 12)):
        monkeypatch.setattr(minhash, "COUNT_TEXTS", most)
        monkeypatch.setattr(minhash, "SHARD_BYTES", size)
        got, n = minhash.document_frequencies(table.repartition(parts))
        found = {r["uid"]: np.frombuffer(r["idf"], np.uint8) for r in got.collect()}
        assert n == len(texts)
        for i, t in enumerate(texts):
            assert sorted(found.get(i, np.zeros(0)).tolist()) == sorted(round(64 * (2 - math.log(df[x]) / (2 * math.log(n)))) for x in plain_shingles(t))
            h = minhash.weighted_set(t or "", minhash.Weights(np.zeros(0, np.int64), np.zeros(0), n))[0]
            assert len(h) == len(found.get(i, ()))


def test_classes_by_independent_weights(spark):
    """All pairs by words and by an idf written anew; shingles far below a tenth of the documents weigh less, and that decides classes."""
    r, texts = random.Random(3), corpus(200)
    for g in range(12):  # templates of 8 texts: what they share is in 8 of 300 documents, what is their own in one
        base = words(9000 + g, 110)
        for _ in range(8):
            mine = list(base)
            for k in r.sample(range(0, 110, 6), 2):
                mine[k] = f"own{len(texts)}x{k}"
            texts.append(" ".join(mine))
    n = len(texts)
    sets = [plain_shingles(t) for t in texts]
    df = Counter(x for s in sets for x in s)

    def classes(weigh):
        root = list(range(n))
        for a, b in itertools.combinations(range(n), 2):
            least = sum(min(c, sets[b][x]) * weigh(x) for x, c in sets[a].items() if x in sets[b])
            total = sum(c * weigh(x) for s in (sets[a], sets[b]) for x, c in s.items()) - least
            if least / total >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if v == high else v for v in root]
        return root

    want = classes(lambda x: round(64 * (2 - math.log(df[x]) / (2 * math.log(n)))) / 64)
    assert want != classes(lambda x: 1 + math.log10(n / max(df[x], n / 10)))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(n)] == want


def test_samples_from_the_table_of_weights():
    """Places read from the table are those that each weight gives by itself."""
    at = np.arange(0, 1 << 16, 97)
    table = minhash._places().reshape(-1, 1 << 16)
    for df in (1, 2, 9, 5_000, 1_000_000):
        w = float(minhash.idf(np.array([df]), 1_000_000)[0])
        assert (table[round(64 * w) - 96, at] == minhash._place(at, np.full(len(at), w))).all()


def test_workers_keep_nothing_of_a_table(spark, monkeypatch):
    """Workers live on after counting: no view of its arrays, which would hold them for good, is left in one."""
    monkeypatch.setattr(minhash, "COUNT_TEXTS", 16)
    table = spark.createDataFrame([*enumerate(corpus(300))], "uid long, text string").repartition(4)

    def views(batches):
        import gc

        held = sum(isinstance(x, memoryview) for x in gc.get_objects())
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([held])], names=["held"])

    for _ in range(2):
        assert minhash.document_frequencies(table)[0].count() == 300
    assert max(r["held"] for r in spark.range(0, 16, 1, 16).mapInArrow(views, "held long").collect()) < 20


def test_rows_cut_from_one_array():
    """Rows as slices of one array, empty ones and none at all; the array is free once the column is."""
    data = np.arange(20, dtype=np.uint8)
    for ends in ([0, 3, 3, 20], [5, 7], [0]):
        want = [data[i:j].tobytes() for i, j in zip(ends, ends[1:])]
        column = common.cut_bytes(data, np.array(ends))
        column.validate(full=True)
        assert column.to_pylist() == want
    wide = np.arange(4, dtype=np.uint16)
    assert common.cut_bytes(wide, np.array([0, 2, 8])).to_pylist() == [wide[:1].tobytes(), wide[1:].tobytes()]
    alive = weakref.ref(data)
    del data, column
    assert alive() is None
