"""Equal texts are audited once, and only pairs that may come first are scored with the ratio; results are those of all."""

import pytest
from pyspark.sql import functions as F

from biblens.operators import score
from biblens.plans import audit as plan
from biblens.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def works(spark):
    return Q.works_table(spark, SF).filter("work_id % 3 = 0").localCheckpoint()


def seen(spark, monkeypatch, refs, works, **more):
    """The audit's rows, and how many rows each table had that it wrote."""
    rows, plain = {}, plan.write_table

    def written(df, name):
        out = plain(df, name)
        rows[name] = out[0].count()
        return out

    monkeypatch.setattr(plan, "write_table", written)
    got = plan.audit(refs, works, **more).select("ref_id", "input_text", "status", "note", "verification_status", "matched_doi", "comparison_summary", F.to_json("best_candidate").alias("best"), F.to_json("candidates").alias("listed"))
    return {r["ref_id"]: tuple(r)[1:] for r in got.collect()}, rows


def test_equal_texts_are_audited_once(spark, monkeypatch, works):
    line = "Abaason A, Mcaaer B. Words that no title has. Journal of Nothing. 2001; 1(1): e7."
    lines = [(1, line), (2, line), (3, None), (4, None), (5, ""), (6, line + " "), (7, line)]
    gaps = spark.createDataFrame([(2, "pubmed", None), (3, "jalc", "TimeoutError")], "ref_id long, source string, error string")
    got, rows = seen(spark, monkeypatch, spark.createDataFrame(lines, "ref_id long, input_text string"), works, gaps=gaps)
    assert rows["parsed"] == 4
    assert {k: v[0] for k, v in got.items()} == dict(lines)
    assert got[1] == got[7] and got[1][:3] == got[2][:3] and got[3][1:3] == got[4][1:3]
    assert {k: v[3] for k, v in got.items()} == {k: "partial" if k in (2, 3) else "complete" for k in got}


def test_pairs_that_can_not_be_first_are_not_scored(spark, monkeypatch, works):
    refs = Q.references_table(spark, SF).filter("work_id % 3 = 0 or ref_id % 20 = 1").select("ref_id", "input_text")
    some, few = seen(spark, monkeypatch, refs, works)
    monkeypatch.undo()
    monkeypatch.setattr(score, "contenders", lambda pairs: pairs)
    every, _ = seen(spark, monkeypatch, refs, works)
    assert some == every and {v[1] for v in some.values()} >= {"found", "likely_wrong"}
    texts = refs.select("input_text").distinct().count()
    assert few["ranked"] < 2 * texts


def test_contenders_keep_ties_and_all_of_unsure_references(spark):
    names, none = F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("string")
    rows = [
        (1, "Slow tides in narrow harbours", 2020, 1), (1, "Slow tides in narrow harbours", 2020, 2), (1, "Fast tides in wide harbours", 2014, 3),  # a tie, and one that can not come up
        (2, "Fast tides in wide harbours", 2014, 1), (2, "Ovens of the north", 2020, 2),  # none is sure
        (3, "Slow tides in narrow harbours", 2024, 1), (3, "Slow tides in harbours", 2014, 2),  # the years forbid it
    ]
    made = spark.createDataFrame(rows, "ref_id long, theirs string, year int, ordinal int")
    record = lambda title, year: F.struct(title.alias("title"), names.alias("authors"), year.alias("year"), F.lit("Coast Studies").alias("venue"), F.array().cast("array<string>").alias("venue_aliases"), F.lit("7").alias("volume"), F.lit("2").alias("issue"), F.lit("10").alias("page"), none.alias("article_number"), none.alias("source"), F.lit(False).alias("is_preprint"))
    pairs = made.select("ref_id", record(F.lit("Slow tides in narrow harbours"), F.lit(2020)).alias("r"), record(F.col("theirs"), F.col("year")).alias("c"), "ordinal")
    kept = score.contenders(score.with_normal(score.with_normal(pairs, "r"), "c"))
    assert sorted((r["ref_id"], r["ordinal"]) for r in kept.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
