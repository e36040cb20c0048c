"""Each stage of the pipeline on its own input: nulls, empty and long texts, repeated rows and ids, empty tables, clashing columns."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, uid string, score string, taken string"


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def row(i, text, source="s"):
    return (i, text, "en", source, len(text or ""), "u", "s", "t")


def test_odd_rows(spark, tmp_path):
    rows = [row(1, "one two three four five six seven eight nine ten eleven twelve")] * 2
    rows += [row(1, "another text of the same id"), row(None, "text without id", None), row(None, None), row(2, ""), row(3, "long words " * 60_000), (4, None, None, None, None, None, None, None)]
    sf = write(spark, tmp_path, rows, [(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            if name != "mixing":
                assert {r["uid"] for r in out.select("uid").distinct().collect()} <= {"u", None}
        sizes.append(out.count())
        out.write.parquet(str(tmp_path / name.replace(" ", "")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
    assert sizes[0] == 8 and sizes[1] == 8 and sizes[2] < 8 and sizes[3] == sizes[4] > 0


def test_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path, [], [])
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_near_stage_weighs_by_frequency(spark):
    """Texts that are near each other by equal weights are not where what they share is less rare than what parts them."""
    import math

    def text(*parts):
        return " ".join(parts)

    shared = " ".join(f"s{i}" for i in range(100))
    rows = [row(i, text(shared, " ".join(f"own{i}x{k}" for k in range(11)))) for i in range(8)]
    rows += [row(100 + i, " ".join(f"far{i}x{k}" for k in range(30))) for i in range(92)]
    weight = round(64 * (2 - math.log(8) / (2 * math.log(100)))) / 64  # of the 96 shingles that all 8 share
    assert 96 * 2 / (96 * 2 + 22 * 2) > 0.8 > 96 * weight / (96 * weight + 22 * 2)
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert kept.count() == 100  # by equal weights 93
