"""Secret spans against an independent reading of the patterns and of entropy, the fast path of the scan against the plain one."""

import hashlib
import math
import random
import time

from biblens.llm import secret_scan as S
from biblens.llm.queries import op8_secrets

B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")


def own_base(text: str) -> list[tuple[int, int, str]]:
    """The three patterns by hand, without regular expressions."""
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    upper, low = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), set("0123456789abcdef")

    def lower(s: str) -> str:
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    out, i = [], 0
    while i < len(text):
        name = next((n for n in NAMES if lower(text[i : i + len(n)]) == n), None)
        if name is None:
            i += 1
            continue
        at = i + len(name)
        ends = []
        for quoted in (True, False):
            p = at
            if quoted:
                if text[p : p + 1] not in ("'", '"') or p >= len(text):
                    continue
                p += 1
            while text[p : p + 1] == " ":
                p += 1
            if text[p : p + 1] not in (":", "=") or p >= len(text):
                continue
            p += 1
            while text[p : p + 1] == " ":
                p += 1
            if p < len(text) and text[p] in "'\"":
                p += 1
            e = p
            while e < len(text) and text[e] in value:
                e += 1
            if e > p:
                ends.append((p, e))
        if not ends:
            i += 1
            continue
        p, e = ends[0]
        if e - p >= 6:
            out.append((i, e, 0))
        i = e
    i = 0
    while (i := text.find("AKIA", i)) >= 0:
        e = i + 4
        while e < len(text) and text[e] in upper:
            e += 1
        if e == i + 4:
            i += 1
            continue
        if e - i >= 20:
            out.append((i, e, 1))
        i = e
    i = 0
    while i < len(text):
        e = i
        while e < len(text) and text[e] in low:
            e += 1
        if e - i >= 24:
            out.append((i, e, 2))
        i = max(e, i + 1)
    return [(a, b, S.KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def texts(n: int) -> list[str]:
    r = random.Random(7)
    parts = [
        lambda: r.choice(NAMES).upper() + r.choice(["", '"', "'"]) + r.choice(["", " "]) + r.choice(":=") + r.choice(["", " ", "  "]) + r.choice(["", '"']) + "".join(r.choice(B64) for _ in range(r.randint(0, 9))),
        lambda: "AKIA" * r.randint(1, 2) + "".join(r.choice("ABZ019") for _ in range(r.randint(0, 22))),
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(18, 40))),
        lambda: "".join(r.choice(B64) for _ in range(r.randint(18, 40))),
        lambda: r.choice(["plain words", "é漢😀", "secret", "token=secret:password=abcdef", "a/long/path/of/words", "2024-01-02T03:04:05", "==", "x_y-z"]),
    ]
    return ["".join(r.choice(parts)() + r.choice([" ", "", "\n", ", "]) for _ in range(r.randint(0, 8))) for _ in range(n)]


def test_base_spans():
    for t in texts(3000):
        assert S.base_spans(t) == own_base(t), t


def test_entropy_by_windows():
    """Every stretch is made of the windows above the threshold, counted anew for each window."""
    for name, members, window, least in S.CLASSES:
        r = random.Random(3)
        for _ in range(100):
            s = "".join(r.choice(B64[: r.choice([4, 16, 62])] + "0123456789abcdef") for _ in range(r.randint(window, 70)))
            got = list(S.window_entropy(s, window))
            for i, h in enumerate(got):
                w = s[i : i + window]
                assert abs(h + sum(w.count(c) / window * math.log2(w.count(c) / window) for c in set(w))) < 1e-9
            assert members.fullmatch("a1" * window) and 0 < least < math.log2(window) and name


def test_entropy_spans():
    key = "q7Zx9Lm2Vt4Kp8Rw1Yc6"  # 20 characters, no assignment before it
    text = f"see {key} and é"
    base, spans = S.scan_text(text)
    assert base == [] and [text[a:b] for a, b, _ in spans] == [key]
    assert S.scan_text("a/very/long/path/of/plain/words/only " + "internationalizationism" * 2) == ([], [])
    assert S.scan_text("123e4567-e89b-12d3-a456-426614174000 2024-01-02T03:04:05Z0000000 ====================") == ([], [])
    held = "token = " + key
    assert [k for _, _, k in S.scan_text(held)[1]] == ["assign"]
    for t in texts(500):
        base, spans = S.scan_text(t)
        assert set(base) <= set(spans)
        more = [s for s in spans if s not in base]
        assert not any(a <= x and y <= b for x, y, _ in more for a, b, _ in base)


def test_cover():
    r = random.Random(1)
    for _ in range(300):
        cover, held = S.Cover(), []
        for _ in range(20):
            a = r.randrange(40)
            b = a + r.randrange(1, 12)
            assert cover.holds(a, b) == any(x <= a and b <= y for x, y in held)
            cover.add(a, b)
            held.append((a, b))


def test_time_grows_with_length():
    took = []
    for n in (1000, 8000):
        t = " ".join("%040x" % random.Random(i).getrandbits(160) for i in range(n))
        began = time.perf_counter()
        S.scan_text(t)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0]


def test_registered_query(spark, tmp_path):
    rows = [*enumerate([*texts(300), None, "", "no findings", " ".join(texts(4000))]), (5, "password=abcdefg"), (None, "x")]
    spark.createDataFrame([(i, t, "base") for i, t in rows], "doc_id long, text string, base string").write.parquet(str(tmp_path / "documents.parquet"))
    out = op8_secrets(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def want(i, t):
        base = own_base(t or "")
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        return (i, *[sum(k == kind for _, _, k in base) for kind in S.KINDS], hashlib.sha256(said.encode()).hexdigest(), S.digest(t)[-1])

    assert sorted(map(tuple, out.collect()), key=str) == sorted((want(i, t) for i, t in rows), key=str)
    assert S.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
