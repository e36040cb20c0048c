"""The interactive page's BibTeX dialect and whole report, CSL-JSON, PubMed details, streams that are replayed."""

import json
import os

import pytest
from pyspark.sql import functions as F

from biblens import runtime
from biblens.operators import report
from biblens.plans.audit import audit, citation_index
from biblens.runtime import numbered, shared_dir
from biblens.sources import payloads
from biblens.sources import text as T
from biblens.streaming.audit import audit_stream
from test_results import LINE, table, work


@pytest.mark.parametrize(
    "text,lines",
    [
        ("@article{k, author = {Imai, E and Kataoka, Y}, title={{A} {Great} Title}, year=2025, journal = \"J A\", doi={10.1/x}}", ["Imai, Kataoka. 2025. A Great Title. J A. DOI: 10.1/x"]),
        ("@misc{k, author={Jo Van Kettle}, title={T}, eprint={2307.06464}, archivePrefix={arXiv}}", ["Kettle. T. arXiv:2307.06464"]),
        ("@misc{k, title={T}, eprint={2307.06464}, archiveprefix={arXiv preprint}}", ["T"]),
        ("@book{k, title={unclosed value", ["unclosed val"]),
        ("@book{k, title={closed}, year={19", ["closed"]),
        ('@book{k, title="a, {b} c", booktitle={B}, month = feb, year = 1999 }', ["1999. a, b c. B"]),
        ("@book{k, title={an equation a = {b}, year = 7}}", ["7. an equation a = b, year = 7"]),
        ("@comment{@book{k, title={inner}}}", ["inner"]),
        ("@article{a, title={x @book{b, title={y}} z}}", ["y", "y"]),
        ("@book{k, title={  two   blanks }}\n@string{s = {no}} @online{o, title={not listed}}", ["two   blanks"]),
        ("@book(k, title={paren})", []),
        ("@book{k, author={A B AND C D, E}, title={T}}", ["B, C D. T"]),
        ("@book{k, author={}, year=2}", ["2"]),
        ("@book{k}", []),
    ],
)
def test_page_bibtex(text, lines):
    assert [x for x in map(T.page_line, T.page_entries(text)) if x] == lines


def test_page_references(spark):
    docs = spark.createDataFrame([("b", "@misc{e, title={T}}\n@misc{f}\n@book{g, title={U}}"), ("p", "[1] First\r\nReferences\n 2.Second still \n\n"), ("n", None), ("e", "")], "source_doc string, text string")
    got = sorted(tuple(r) for r in T.page_references(docs).collect())
    assert got == [("b", 0, "T"), ("b", 2, "U"), ("p", 0, "First"), ("p", 2, "Second still")]
    assert T.page_references(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def results(spark):
    works = table(spark, work(1, "Slow tides in narrow harbours"), work(2, "Fast tides in wide harbours", year=2019, volume="9"))
    lines = [LINE, "Marlow A, Quill B. Quick storms over open harbours. Coast Studies 2020; 7(2): 10-19.", "Tool ``` https://example.org", "Nobody X. Grammar of unseen lamps and kettles. Void 1950; 3(3): 77."]
    out = audit(spark.createDataFrame(list(zip((10, 20, 30, 40), lines)), "ref_id long, input_text string"), works)
    return spark.createDataFrame(out.collect(), out.schema)


def markdown(df):
    return "\n".join(r["markdown"] for r in df.orderBy("part", "number").collect())


def test_whole_page_report(spark, results):
    failed = results.filter("ref_id = 40").withColumns({"ref_id": F.lit(50).cast("long"), "status": F.lit("error"), "message": F.lit("timeout")})
    both = results.withColumn("message", F.lit(None).cast("string")).unionByName(failed)
    checks = spark.createDataFrame(
        [(10, 1.5, 55.0, [], {}, None), (20, 2.0, 55.0, ["jalc", "arxiv"], {"pubmed": "TimeoutError"}, None), (50, None, None, None, None, "timeout")],
        "ref_id long, elapsed_sec double, budget_sec double, skipped array<string>, source_errors map<string,string>, error string",
    )
    text = markdown(report.page_report(both, checks=checks)).split("\n")
    assert text[:6] == ["# Reference Audit Report", "", "## 入力", "", "```", LINE] and text[7] == "Tool ``​` https://example.org" and text[10] == "```"
    at = text.index("## チェック結果")
    assert text[at + 2 : at + 11] == ["- 正常: 1", "- 未検証あり: 0", "- 誤引用候補: 1", "- 未発見: 1", "- 撤回: 0", "- 年注意: 0", "- ウェブサイト: 1", "- エラー: 1", ""]
    assert [x.split("**")[0] + x.split("**")[1] for x in text[at + 11 : at + 16]] == ["1. [正常]", "2. [誤引用候補]", "3. [ウェブサイト]", "4. [未発見]", "5. [エラー]"]
    at = text.index("## 注意すべき候補")
    assert text[at - 1 : at + 3] == ["", "## 注意すべき候補", "", "### ⚠️ Likely Wrong Citation"]
    assert any(x.startswith("-   • 📄 タイトル: ") for x in text) and "- 理由: timeout" in text and "- 理由: no_match" in text
    at = text.index("## Diagnostics")
    assert text[at - 2 : at + 2] == ["---", "", "## Diagnostics", ""] and text[at + 2] == report.ERRORS_REMARK
    assert text[at + 6 :] == ["| 1 | 1.5 | 55 | - | - |", "| 2 | 2 | 55 | jalc, arxiv | pubmed:TimeoutError |", "| 3 | - | - | - | - |", "| 4 | - | - | - | - |", "| 5 | - | - | - | timeout |", ""]
    fine = markdown(report.page_report(results.filter("ref_id = 10"), spark.createDataFrame([(1, "as ``` typed"), (2, None)], "number long, line string"), checks))
    assert fine.endswith("## 注意すべき候補\n\n" + report.NO_PROBLEM) and "as ``​` typed\n\n```" in fine
    assert "- 正常: 0" in markdown(report.page_report(results.filter("false")))


def test_numbers_go_on_over_slices(spark):
    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)], "k long, v string").repartition(5)
    assert [(r["k"], r["n"]) for r in numbered(df, [F.col("k")], "n").orderBy("k").collect()] == [(i, i + 1) for i in range(101)]


def test_checks_that_fail(spark, results):
    asked = spark.createDataFrame([(10,), (99,)], "ref_id long")
    got = {r["ref_id"]: (r["code"], json.loads(r["answer"])) for r in report.answers(asked, results, F.lit(1.234)).collect()}
    assert got[99] == (500, {"ok": False, "error": "internal_error"})
    assert got[10][0] == 200 and got[10][1]["diagnostics"]["elapsed_sec"] == 1.23 and got[10][1]["result"]["status"] == "found"


def test_csl_of_both_shapes(spark):
    rows = [
        ("10.1/a", json.dumps({"title": "Plain", "author": [{"family": "Ibsen", "given": "E"}, {"literal": "The Group"}], "issued": {"date-parts": [[2020, 5]]}, "container-title": "Journal", "volume": "7", "number": "3", "page": "1-9"})),
        ("10.1/b", json.dumps({"title": ["Listed", "Other"], "author": [{"family": "山川"}], "issued": {"date-parts": [["1999"]]}, "container-title": ["First", "Second"], "issue": "2", "volume": 12, "page": "e5"})),
        ("10.1/c", json.dumps({"title": "Bare", "issued": "2001", "author": None, "container-title": []})),
        ("10.1/d", "{"), ("10.1/e", None), ("10.1/f", "[1]"), ("10.1/g", json.dumps({"title": []})),
    ]
    raw = spark.createDataFrame(rows, "doi string, json string")
    got = {r["doi"]: r for r in payloads.csl_records(raw).collect()}
    told = lambda d: tuple(got[d][c] for c in ("title", "authors", "year", "venue", "volume", "issue", "page", "article_number"))
    assert set(got) == {"10.1/a", "10.1/b", "10.1/c"}
    assert told("10.1/a") == ("Plain", ["ibsen", "group"], 2020, "Journal", "7", "3", "1-9", None) or told("10.1/a")[1][0] == "ibsen"
    assert told("10.1/b") == ("Listed", ["山川"], 1999, "First", "12", "2", "e5", "e5")
    assert told("10.1/c") == ("Bare", [], None, None, None, None, None, None)
    assert payloads.csl_metadata(raw).count() == 7


def test_pubmed_details(spark):
    summary = lambda **more: json.dumps({"title": "T", "authors": [{"name": "Hale A"}, {"name": " "}, {}], "source": "J", **more})
    summaries = spark.createDataFrame(
        [("1", summary(pubdate="", sortpubdate="2011/02/03 00:00")), ("2", summary(pubdate="Spring", sortpubdate="2012", articleids=[{"idtype": "pmc", "value": "x"}, {"idtype": "DOI", "value": "10.1/two"}, {"idtype": "doi", "value": "10.1/no"}])), ("3", summary(pubdate="2013 Jan")), ("4", summary()), ("5", "{")],
        "pmid string, json string",
    )
    xml = '<A><ArticleIdList><ArticleId IdType="pmc">x</ArticleId><ArticleId IdType="{}"> 10.1/{} </ArticleId></ArticleIdList></A>'
    articles = spark.createDataFrame([(str(i), xml.format("DoI" if i == 3 else "doi", f"x{i}")) for i in (1, 2, 3, 4)], "pmid string, xml string")
    found = spark.createDataFrame([(7, p, i) for i, p in enumerate(["1", "2", "3", "4", "5", "9"], 1)] + [(8, "4", 1)], "ref_id long, pmid string, place int")
    got = {(r["ref_id"], r["pmid"]): r for r in payloads.pubmed_details(found, summaries, articles).collect()}
    assert {k: (r["year"], r["doi"]) for k, r in got.items()} == {
        (7, "1"): (2011, "10.1/x1"), (7, "2"): (None, "10.1/two"), (7, "3"): (2013, "10.1/x3"), (7, "4"): (None, None), (7, "5"): (None, None), (7, "9"): (None, None), (8, "4"): (None, "10.1/x4"),
    }
    assert got[7, "1"]["authors"] == ["Hale A"] and got[7, "9"]["authors"] == [] and got[7, "9"]["title"] == ""
    records = {r["source_id"]: r for r in payloads.pubmed_records(payloads.pubmed_details(found, summaries)).collect()}
    assert (records["2"]["venue"], records["2"]["venue_aliases"], records["2"]["aliases_resolved"], records["9"]["venue"]) == ("J", ["J"], True, None)


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    works = table(spark, work(1, "Slow tides in narrow harbours"))
    kept = str(tmp_path / "index")
    citation_index(works, kept)
    for i in range(3):
        spark.createDataFrame([(i, LINE)], "ref_id long, input_text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))

    def run():
        stream = spark.readStream.schema("ref_id long, input_text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = audit_stream(stream, works, str(tmp_path / "out"), index=kept, details=False).option("checkpointLocation", str(tmp_path / "one")).start()
        q.processAllAvailable()
        q.stop()

    run()
    # the commit of the last batch is lost: it comes again
    for name in ("2", ".2.crc"):
        os.remove(tmp_path / "one" / "commits" / name)
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["ref_id"] for r in got.collect()) == [0, 1, 2] and {r["status"] for r in got.collect()} == {"found"}
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) == before


def test_slices_of_a_numbering_stay_small(spark, monkeypatch):
    monkeypatch.setattr(runtime, "SLICE", 100, raising=False)
    dealt = []
    plain = runtime.write_table
    monkeypatch.setattr(runtime, "write_table", lambda df, name: dealt.append(plain(df, name)[0]) or (dealt[-1], ""))
    rows = runtime.numbered(spark.range(2000).select((F.col("id") * 7 % 2000).alias("k")), [F.col("k")]).collect()
    assert sorted((r["k"], r["number"]) for r in rows) == [(i, i + 1) for i in range(2000)]
    assert max(r["count"] for r in dealt[0].groupBy(F.input_file_name()).count().collect()) <= 200
