"""Fingerprints against an independent SimHash, the search by block tables against all pairs."""

import hashlib
import itertools
import random
import re

import xxhash

from biblens.llm import simhash
from biblens.llm.queries import op5_simhash


def own_simhash(text: str) -> int:
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text.lower()) if w]
    votes = [0] * 64
    for i, a in enumerate(words):
        b = words[i + 1] if i + 1 < len(words) else None
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        if b is not None:
            h = xxhash.xxh64_intdigest(b.encode(), h)
        for j in range(64):
            votes[j] += (len(a) + len(b or "")) * (1 if h >> j & 1 else -1)
    return sum(1 << j for j in range(64) if votes[j] > 0)


def table_of(n: int) -> list[tuple[int | None, str | None]]:
    r = random.Random(9)
    base = [" ".join(r.choice("ab cd efg hij klmno pq rst uvwxyz été 漢字".split()) for _ in range(r.randint(1, 60))) for _ in range(12)]
    out = []
    for i in range(n):
        words = r.choice(base).split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = r.choice(["new", "ab", "x"])
        out.append((i, " ".join(words)))
    out[3] = (3, None)
    out[4] = (4, "")
    out[5] = (5, "\n\t ")
    out[6] = (6, "one")
    return out


def test_every_column(spark, tmp_path):
    rows = table_of(260)
    spark.createDataFrame([(i, t, "v", 1) for i, t in rows], "doc_id long, text string, fp string, uid long").write.parquet(str(tmp_path / "documents.parquet"))
    out = op5_simhash(spark, str(tmp_path))
    assert out.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = {r["doc_id"]: r for r in out.collect()}
    text = {i: t or "" for i, t in rows}
    prints = {i: own_simhash(t) for i, t in text.items()}
    some = False
    for i, t in text.items():
        following = (i - 1) % len(rows)
        half = len(t) // 2
        edited = t[: len(t) - half] + text[following][:half]
        own, other = own_simhash(edited), prints[following]
        near = sum((prints[i] ^ p).bit_count() <= simhash.RADIUS for k, p in prints.items() if k != i) if i % 50 == 0 else None
        some = some or bool(near)
        want = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[i]:016x}", f"{own:016x}", 1 - (prints[i] ^ own).bit_count() / 64, 1 - (prints[i] ^ other).bit_count() / 64, near)
        assert tuple(got[i]) == want
    assert some


def test_block_tables_find_all(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(60)]
    flip = lambda b, n: (b + (1 << 63) ^ sum(1 << k for k in r.sample(range(64), n))) - (1 << 63)
    values = sorted({*base, *(flip(b, r.randint(1, 5)) for b in base for _ in range(3))})
    table = spark.createDataFrame([(v,) for v in values for _ in range(2)], "fp long")
    for radius, same in ((3, 3), (3, 1), (5, 2), (1, 1)):
        want = {(a, b): ((a ^ b) & (1 << 64) - 1).bit_count() for a, b in itertools.combinations(values, 2)}
        found = [tuple(x) for x in simhash.near_fingerprints(table, radius, same).collect()]
        assert len(found) == len(set(found)) and {(a, b): d for a, b, d in found} == {p: d for p, d in want.items() if d <= radius}


def test_odd_tables(spark):
    columns = "doc_id long, text string"
    odd = spark.createDataFrame([(50, "a b c"), (50, "a b c"), (None, "a b c"), (None, None), (50, "y")], columns)
    got = sorted((r["doc_id"] or 0, r["n_near"]) for r in simhash.compare_edited(odd).collect() if r["n_near"] is not None)
    assert got == [(50, 0), (50, 2), (50, 2)]
    assert simhash.compare_edited(spark.createDataFrame([], columns)).count() == 0
    long = simhash.compare_edited(spark.createDataFrame([(1, "word " * 200_000), (2, "word " * 200_000)], columns)).collect()
    assert {r["fingerprint"] for r in long} == {f"{own_simhash('word ' * 200_000):016x}"}
