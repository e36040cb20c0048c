"""Fill-in-middle against a regular expression over code points, and its exact inverse."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from biblens.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = [
    None, "", " ", "\n\t ", "a", " a", "a ", " a  b ", "<P>", "a<S>b", "<M", "x <M>", "<<P>", "<PP>", "<P<S", "< P>", "<p>", "é ü x　y", "​ \x1c\x1f a",
    "𝒳𝒴 𝒵", "<" * 9 + " <S", "P> S> M>", "$1 \\ $2", "\x0b\x0ca\x0d", "<é>", "<Ṕ>", "a\x00b c",
]


def texts():
    rng = random.Random(3)
    parts = ["<", "P", "S", "M", ">", " ", "\n", "é", "𝒳", "ab", "　"]
    return ODD + ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(600)] + ["wörd " * 120_000 + "end", " " * 300_000, "x" * 300_000]


def test_equals_regular_expression_and_comes_back(spark):
    rows = list(enumerate(texts())) + [(7, "the same id"), (7, "the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("own"), "Form": F.lit(0), "output": F.lit(None).cast("int")})
    out = fim.transform(df.repartition(3)).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    key = lambda r: (r[0], r[-1])
    got = out.collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain(*r) for r in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert sorted((r["doc_id"], r["back"]) for r in got) == sorted((i, t or "") for i, t in rows)


def test_blocks_of_any_size():
    for i, text in enumerate(texts()[:300]):
        data = np.frombuffer((text or "").encode(), np.uint8)
        for block in (1, 2, 3, 5):
            n, form, a, b, out = fim.transform_text(data, str(i), block=block)
            assert (i, n, form, a, b, out.decode()) == plain(i, text)


def test_empty_table_and_null_id(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = fim.transform(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).first()
    assert row["doc_id"] is None and row["n"] == 3 and row["form"] == plain("", "a b c")[2]


def test_query_on_the_given_table(spark):
    from biblens.llm.queries import op12_fim

    d = "/root/testdata/sf0.001"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = [(*(p := plain(*r))[:5], sha(p[5]), sha(r["text"] or "")) for r in rows]
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert sorted(map(tuple, op12_fim(spark, d).select(*names).collect())) == sorted(want)
