"""Saved payloads as a data source, with filters that reach it."""

import contextlib
import io
import json

import pytest
from pyspark.sql import functions as F

from biblens.sources import payloads, saved


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("saved")
    csl = {"title": ["Listed"], "author": [{"family": "Ibsen"}], "issued": {"date-parts": [[2020]]}}
    files = {
        "csl/a.jsonl": [{"id": "10.1/a", "payload": csl}, {"id": "10.1/b", "payload": None}, {"id": None, "payload": "{}"}],
        "csl/b.jsonl": [{"id": "10.1/c", "payload": json.dumps({"title": "Té"}, ensure_ascii=False)}],
        "pubmed/x.jsonl": [{"id": 7, "payload": {"title": "T"}}, {"payload": 1}],
    }
    for name, rows in files.items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n")
    (top / "csl" / "_broken.crc").write_text("x")
    with (top / "pubmed" / "x.jsonl").open("a") as f:
        f.write("{not json\n[1]")
    return top


def load(spark, folder):
    saved.register(spark)
    return spark.read.format(saved.FORMAT).load(str(folder))


def test_rows(spark, folder):
    got = {(r["source"], r["id"], r["payload"]) for r in load(spark, folder).collect()}
    assert {x[:2] for x in got} == {("csl", "10.1/a"), ("csl", "10.1/b"), ("csl", None), ("csl", "10.1/c"), ("pubmed", "7"), ("pubmed", None)} and len(got) == 8
    assert ("pubmed", None, "{not json") in got and ("pubmed", None, "[1]") in got and ("csl", "10.1/b", None) in got and ("pubmed", None, "1") in got
    records = payloads.csl_records(load(spark, folder).filter("source = 'csl'").select(F.col("id").alias("doi"), F.col("payload").alias("json")))
    assert {(r["doi"], r["title"]) for r in records.collect()} == {("10.1/a", "Listed"), ("10.1/c", "Té")}


def test_filters_reach_the_files(spark, folder, tmp_path):
    asked = load(spark, folder).filter("source = 'csl' and id in ('10.1/a', '10.1/c')")
    assert {r["id"] for r in asked.collect()} == {"10.1/a", "10.1/c"}
    assert asked.rdd.getNumPartitions() == 2  # the files of one source
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        asked.explain("extended")
    physical = told.getvalue().split("== Physical Plan ==")[1]
    assert "BatchScan" in physical and "10.1/a" not in physical.split("BatchScan")[0], physical
    assert load(spark, folder).filter("source = 'csl' and id = '7'").count() == 0
    assert load(spark, folder).filter("source = 'none'").count() == 0 == load(spark, tmp_path).count()
