"""Operators against brute force on small tables, and their edge cases: nulls, empties, ties, repeated
rows, empty tables, clashing extra columns and long texts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from biblens.llm import bpe, common, line_dedup, minhash, mixing, secret_scan, simhash, suffix_dedup
from biblens.llm.queries import vocabulary_path

WORDS = "alpha beta gamma delta omega sigma kappa zeta theta iota lambda nu xi pi rho tau phi chi psi eta".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, uid string, score string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def texts() -> list[str | None]:
    base = prose(1, 150)
    words = base.split()
    near = " ".join(words[:70] + ["changed"] + words[71:])
    passage = prose(9, 60)
    return [
        base, base, near, None, "", "", "é", "a" * 350, "\n\n", "short text", "short text", prose(2, 40) + "\n" + passage + "\n" + prose(3, 40),
        prose(4, 30) + "\n" + passage + "\n" + prose(5, 50), passage, "x\x00y 漢字 😀 " * 30, ("line of ten words here to be seen once more ok\n" * 5) + "end", "one\ntwo\nthree\nfour five six seven eight nine ten\nA",
        "B\none\ntwo\nthree\nfour five six seven eight nine ten\nC", "Wher. " * 400, prose(6, 3000),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "u", "s") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    return spark.createDataFrame([(1, prose(1, 60), "en", "s", 1, "u", "s")] * 2 + [(None, "x", "en", None, 1, "u", "s"), (None, None, None, None, None, None, None), (1, "y", "en", "s", 1, "u", "s")], COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_suffix_dedup_is_exact(docs):
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(docs, digest=True).collect()}
    want = suffix_dedup.brute_force([t or "" for t in texts()])
    for i, (t, gone) in enumerate(zip(texts(), want, strict=True)):
        kept = bytes(b for b, g in zip((t or "").encode(), gone, strict=True) if not g)
        spans = sum(1 for g, _ in itertools.groupby(gone) if g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(gone), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i


def test_suffix_dedup_hot_grams_and_long_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    some = [f"{prose(100 + i, 20)} {prose(9, 40)} {prose(200 + i, 20)}" for i in range(130)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), digest=True).collect()}
    assert [got[i] for i in range(130)] == [sum(g) for g in suffix_dedup.brute_force(some)]


def test_deep_shallow_order():
    r = random.Random(5)
    rows = [bytes(r.choice(b"ab\x00") for _ in range(r.choice([3, 9, 30, 64]))) for _ in range(400)]
    rows += [b"q" * 60 + bytes([r.choice(b"xyz")]) * 3 for _ in range(60)]
    sizes = np.array([len(x) for x in rows])
    padded = np.zeros((len(rows), 64), np.uint8)
    for i, x in enumerate(rows):
        padded[i, : len(x)] = np.frombuffer(x, np.uint8)
    place, lcp = suffix_dedup.suffix_order(padded, sizes, shallow=2)
    order = np.argsort(place)
    assert [rows[i] for i in order] == sorted(rows)
    for k in range(1, len(rows)):
        a, b = rows[order[k - 1]], rows[order[k]]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_line_dedup_is_exact(docs):
    word, seen = re.compile(mixing.WORD), set()
    got = {r["doc_id"]: r for r in line_dedup.dedup(docs, digest=True).collect()}
    for i, t in enumerate(texts()):
        lines = (t or "").split("\n")
        n, gone = [len(word.findall(x)) for x in lines], [False] * len(lines)
        for p in range(len(lines)):
            for e in range(p, len(lines)):
                if sum(n[p : e + 1]) >= line_dedup.MIN_WORDS:
                    key = tuple(lines[p : e + 1])
                    if key in seen:
                        gone[p : e + 1] = [True] * (e + 1 - p)
                    seen.add(key)
                    break
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), i


def test_line_dedup_keeps_columns(docs):
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["uid"] for r in out.collect()} == dict.fromkeys(range(len(texts())), "u")


def test_near_duplicates(docs):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got[1] == got[2] == 0 and got[4] == got[5] == 3 and got[10] == 9
    assert got[12] == 12 and got[13] == 13 and got[11] == 11
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(got.values()))


def test_sampling_estimates_weighted_jaccard():
    weights = minhash.Weights(np.zeros(0, np.int64), np.zeros(0), 10)
    words = prose(3, 400).split()
    other = words[:200] + [w + "x" if i % 20 == 0 else w for i, w in enumerate(words[200:])]
    rows = []
    for t in (" ".join(words), " ".join(other)):
        h, w = minhash.weighted_set(t, weights)
        rows.append((minhash.samples(np.zeros(len(h), np.int64), h, w * (1 + (h % np.uint64(3) == 0)), 1)[1][0], (h, w * (1 + (h % np.uint64(3) == 0)))))
    estimate = (rows[0][0] == rows[1][0]).mean()
    assert abs(estimate - minhash.weighted_jaccard(rows[0][1], rows[1][1])) < 0.15


@pytest.mark.parametrize("few", [0, 20_000])
def test_components_of_a_path(spark, monkeypatch, few):
    monkeypatch.setattr(minhash, "FEW_EDGES", few)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21)], "a long, b long")
    assert {r["uid"]: r["root"] for r in minhash.components(links).collect()} == {**dict.fromkeys(range(2, 13), 1), 21: 20}


def test_mixing(docs):
    rows = mixing.mix_counts(docs, block=8).collect()
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(mixing.mix_counts(docs, block=8).collect())]
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    per = {r["source_size"]: r["target"] for r in rows}
    taken = {}
    for r in rows:
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    assert all(abs(taken[s] - g) <= 16 for s, g in per.items())
    assert mixing.targets([10, 10, 100], [5, 2, 1]) == [30.0, 30.0, 60.0] and mixing.targets([], []) == []
    out = mixing.mixed_documents(docs, block=8)
    word = re.compile(mixing.WORD)
    assert out.columns == docs.columns and sum(len(word.findall(r["text"])) for r in out.collect()) == sum(r["taken"] for r in rows)


def test_permutation():
    for n in (1, 2, 3, 7, 100, 1000):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_edge_tables(spark, odd, empty):
    tok = vocabulary_path()
    assert suffix_dedup.dedup(odd, digest=True).count() == line_dedup.dedup(odd, digest=True).count() == 5
    assert sorted(r["n_removed"] for r in suffix_dedup.dedup(odd, digest=True).collect())[-1] == len(prose(1, 60))
    assert minhash.near_duplicates(odd).count() == simhash.compare_edited(odd).count() == mixing.mix_counts(odd).count() == 5
    assert bpe.encode_documents(odd, tok).count() == secret_scan.scan(odd).count() == 5
    for f in (lambda d: suffix_dedup.dedup(d, digest=True), lambda d: line_dedup.dedup(d, digest=True), minhash.near_duplicates, minhash.without_near_duplicates, simhash.compare_edited, mixing.mix_counts, mixing.mixed_documents, secret_scan.scan, lambda d: bpe.encode_documents(d, tok)):
        assert f(empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-duplicates", "mixing", "bpe"]


def test_chunks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 5)
    words = prose(8, 200).split()
    some = [" ".join(words[:i] + [f"new{i}"] + words[i + 1 :]) for i in range(0, 160, 4)]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}
    assert pa is not None


def test_classes_of_large_buckets(spark, monkeypatch):
    """Variants around a text, some near it and some only near each other, against all pairs."""
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 6)
    r, words = random.Random(5), prose(8, 200).split()

    def changed(base: list[str], n: int, tag: str) -> list[str]:
        at = set(r.sample(range(200), n))
        return [w + tag if i in at else w for i, w in enumerate(base)]

    some = [changed(words, 1 + i % 5, f"v{i}") for i in range(40)]
    for i in range(8):
        far = changed(words, 9, f"f{i}")
        some += [far, changed(far, 1, f"g{i}")]
    some = [" ".join(x) for x in some]
    table = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    weights = minhash.frequent_shingles(table)
    sets = [minhash.weighted_set(t, weights) for t in some]
    root = list(range(len(some)))
    for a, b in itertools.combinations(range(len(some)), 2):
        if minhash.weighted_jaccard(sets[a], sets[b]) >= minhash.SIMILARITY and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
    assert 1 < len(set(root)) < len(some)
    assert {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(table).collect()} == dict(enumerate(root))


def test_links_inside_a_family_below_the_threshold(spark):
    """Variants of a form text at about 0.75 to each other, some pairs of them at 0.816."""
    r, words = random.Random(7), [f"{a}{b}" for a in WORDS for b in WORDS]
    some = []
    for i in range(80):
        at = r.sample(range(6, 394, 6), 10)
        for twin in range(2 if i < 30 else 1):
            mine = {**dict.fromkeys(at[:2], f"v{i}"), **{k: f"v{i}x{twin}" for k in (at[6:] if twin else at[2:6])}}
            some.append(" ".join(mine.get(k, w) for k, w in enumerate(words)))
    n = len(some)
    table = spark.createDataFrame([*enumerate(some), *((n + i, prose(1000 + i, 8)) for i in range(10 * n))], "doc_id long, text string")
    weights = minhash.frequent_shingles(table)
    sets = [minhash.weighted_set(t, weights) for t in some]
    root = list(range(n))
    for a, b in itertools.combinations(range(n), 2):
        if minhash.weighted_jaccard(sets[a], sets[b]) >= minhash.SIMILARITY and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if v == high else v for v in root]
    assert 30 < len(set(root)) < n
    got = {v["doc_id"]: v["class_id"] for v in minhash.near_duplicates(table).collect()}
    assert [got[i] for i in range(n)] == root


def test_links_across_chunks_of_a_group(spark, monkeypatch):
    """Texts apart from a large group but near each other meet in whichever chunks they are."""
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 4)
    monkeypatch.setattr(minhash, "TURNS", 1)
    base = prose(8, 200).split()
    group = [[f"g{i}" if k == 7 * i else w for k, w in enumerate(base)] for i in range(25)]
    pairs = []
    for i in range(8):
        far = [f"f{i}x{k}" if k % 25 == i else w for k, w in enumerate(base)]
        pairs += [far, [*far[:-1], f"twin{i}"]]
    some = [" ".join(x) for x in group + pairs]
    monkeypatch.setattr(minhash, "verified", lambda pairs, rows, weights, similarity: pairs.limit(0).selectExpr("a", "b", "1.0D as similarity"))
    table = spark.createDataFrame([*enumerate(some), *((1000 + i, prose(1000 + i, 8)) for i in range(400))], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table).collect()}
    weights = minhash.frequent_shingles(table)
    sets = minhash.Sets(some, weights)
    root = list(range(len(some)))
    for a in range(len(some)):
        exact = sets.like_all(a)
        for b in range(len(some)):
            assert abs(exact[b] - sets.like(a, b)) < 1e-12
            if exact[b] >= minhash.SIMILARITY and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if v == high else v for v in root]
    assert len(set(root)) == 9 and [got[i] for i in range(len(some))] == root


def test_batches_by_bytes():
    texts = ["a" * 30, None, "", "b" * 200, "c", "d" * 10, "e" * 99]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    got = list(common.by_bytes(iter([batch, batch.slice(0, 0)]), 1, 100))
    assert [t for b in got for t in b.column(1).to_pylist()] == texts and len(got) > 2
    assert all(sum(len(t or "") for t in b.column(1).to_pylist()[1:]) < 100 for b in got)
