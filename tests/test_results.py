"""Whole results and reports as they are printed, sources beyond the first, partial verification, answers to requests."""

import json

import pytest
from pyspark.sql import functions as F

from biblens.functions import text as X
from biblens.operators import collect, decide, report
from biblens.plans.audit import audit
from biblens.sources.payloads import RECORD_COLUMNS

KIND = (
    "work_id long, title string, authors array<string>, year int, venue string, venue_aliases array<string>, issns array<string>, volume string, issue string, page string, "
    "article_number string, doi string, source string, source_id string, is_preprint boolean, aliases_resolved boolean"
)
LINE = "Marlow A, Quill B. Slow tides in narrow harbours. Coast Studies 2020; 7(2): 10-19."


def work(work_id, title, **more):
    own = dict(authors=["marlow", "quill"], year=2020, venue="Coast Studies", venue_aliases=[], issns=[], volume="7", issue="2", page="10-19", article_number=None, doi=f"10.5555/w{work_id}", source="crossref", source_id=None, is_preprint=False, aliases_resolved=False)
    return tuple({"work_id": work_id, "title": title, **own, **more}[c.split()[0]] for c in KIND.split(", "))


def table(spark, *rows):
    return spark.createDataFrame(list(rows), KIND)


def run(spark, lines, works, **more):
    refs = spark.createDataFrame(list(enumerate(lines)), "ref_id long, input_text string")
    return audit(refs, works, **more)


def section(results, ref_id):
    return report.section_text(results).filter(F.col("ref_id") == ref_id).first()["markdown"].split("\n")


@pytest.fixture(scope="module")
def works(spark):
    return table(spark, work(1, "Slow tides in narrow harbours"), work(2, "Fast tides in wide harbours", year=2019, volume="9"), work(3, "Ovens of the north", authors=["zell"], year=1990, venue="Bread", volume="1", page="3"))


@pytest.fixture(scope="module")
def results(spark, works):
    lines = [
        LINE,
        "Marlow A, Quill B. Quick storms over open harbours. Coast Studies 2020; 7(2): 10-19.",
        "Nobody X. Grammar of unseen lamps and kettles. Void 1950; 3(3): 77.",
        "Marlow A, Quill B. Slow tides in narrow harbours. Coast Studies 2021; 7(2): 10-19.",
        "Rayyan. https://rayyan.ai",
        "Marlow A. Other words entirely different. Coast Studies 2020; 7(2): 10-19. DOI: 10.5555/w3",
        "Marlow A. Some title of no work. DOI: 10.5555/none",
    ]
    gaps = spark.createDataFrame([(2, "pubmed", None), (2, "jalc", "TimeoutError"), (0, "arxiv", None)], "ref_id long, source string, error string")
    notices = spark.createDataFrame([("10.5555/w3", "10.5555/n", "retraction", "publisher", "Note", "2020-01-01")], "target_doi string, notice_doi string, update_type string, source string, label string, updated string")
    out = run(spark, lines, works, gaps=gaps, notices=notices)
    return spark.createDataFrame(out.collect(), out.schema)


def test_statuses(results):
    got = {r["ref_id"]: (r["status"], r["note"], r["method"], r["found"], r["verification_status"], r["matched_doi"]) for r in results.collect()}
    assert got[0] == ("found", None, "bibliographic", True, "complete", "10.5555/w1")
    assert got[1] == ("likely_wrong", "candidate_mismatch", "bibliographic", False, "complete", "10.5555/w1")
    assert got[2] == ("not_found", "no_match", "bibliographic", False, "partial", None)
    assert got[3] == ("found", "year_warning", "bibliographic", True, "complete", "10.5555/w1")
    assert got[4] == ("website", "website_reference", "website", True, "complete", None)
    assert got[5][:4] == ("likely_wrong", "candidate_mismatch", "doi-crossref", False)
    assert got[6] == ("not_found", "doi_not_resolved", "doi-crossref", False, "complete", "10.5555/none")


def test_details(results):
    rows = {r["ref_id"]: r for r in results.collect()}
    wrong = rows[1]
    assert [c["doi"] for c in wrong["candidates"]][0] == "10.5555/w1" and wrong["suggestions"][0] == "Slow tides in narrow harbours (10.5555/w1)"
    assert wrong["matched_authors"] == ["marlow", "quill"] == wrong["input_authors"] and wrong["best_candidate"]["container"] == "Coast Studies"
    assert wrong["field_signals"]["authors"] == "ok" and wrong["comparison_summary"].startswith("title ")
    assert rows[0]["candidates"] is None and rows[0]["suggestions"] is None
    assert rows[2]["unchecked_sources"] == ["pubmed"] and rows[2]["source_errors"] == {"jalc": "TimeoutError"} and rows[0]["unchecked_sources"] is None
    assert rows[2]["suggestions"][1] == "Google検索: https://www.google.com/search?q=Grammar+of+unseen+lamps+and+kettles"
    assert rows[6]["suggestions"] == ["DOI解決失敗: 10.5555/none", "doi.orgで確認: https://doi.org/10.5555/none"]
    assert rows[5]["retracted"] and rows[5]["retraction_details"][0]["notice_doi"] == "10.5555/n"


def test_sections(results):
    wrong = section(results, 1)
    assert wrong[:5] == ["## ⚠️ Likely Wrong Citation", "", "- 入力: `Marlow A, Quill B. Quick storms over open harbours. Coast Studies 2020; 7(2): 10-19.`", "- 最有力候補: **Slow tides in narrow harbours**", "- DOI: `10.5555/w1`"]
    assert wrong[5] == "- ⚠ 要確認 (1件):" and wrong[6] == '  - 📄 タイトル: "Quick storms over open harbours" → Crossref では "Slow tides in narrow harbours"'
    assert wrong[7:12] == ["- ✓ 一致 (4件): 👤 著者, 📅 出版年, 📚 掲載先, 📖 巻号・ページ", "- 注記: candidate_mismatch", "", "### 修正候補", ""]
    assert wrong[12:14] == ["- **Slow tides in narrow harbours**", "- DOI: `10.5555/w1`"] and "- 書誌: Coast Studies / 2020" in wrong
    lost = section(results, 2)
    assert lost[3:9] == ["- 理由: no_match", "", "- 検証状態: 一部ソースを検証できませんでした。", "- 未検証ソース: `pubmed`", "- ソースエラー: `jalc`=TimeoutError", ""]
    assert lost[9:12] == ["### 次のチェック候補", "", '- タイトル候補でウェブ検索: "Grammar of unseen lamps and kettles"']
    late = section(results, 3)
    assert late[0] == "## △ 出版年注意" and "    （1年ずれ（オンライン公開／印刷年の差の可能性））" in late
    assert section(results, 4) == ["### 🌐 ウェブサイト参照", "- 入力: `Rayyan. https://rayyan.ai`", "- 説明: ソフトウェア/ウェブサイト参照のため学術DB検索はスキップしました。", ""]
    gone = section(results, 5)
    assert gone[3] == "- マッチ: **Ovens of the north**" and gone[8] == "- 種別: **retraction**, 通知DOI: `10.5555/n`, source: `publisher`, date: `2020-01-01`"
    assert section(results, 0)[:4] == ["### ✅ 正常", f"- 入力: `{LINE}`", "- マッチ: **Slow tides in narrow harbours**", "- DOI: `10.5555/w1`"]


def test_whole_reports(spark, results, tmp_path):
    bad = report.report_rows(results).orderBy("part", F.col("ref_id").asc_nulls_first()).collect()
    assert bad[0]["markdown"].split("\n")[0] == "# Reference Audit Report" and [r["ref_id"] for r in bad[1:]] == [1, 2, 3, 5, 6]
    full = report.report_rows(results, full=True).orderBy("part", F.col("ref_id").asc_nulls_first()).collect()
    assert full[0]["markdown"].split("\n")[2] == "合計: 7、正常: 1、問題あり: 5、ウェブサイト: 1"
    assert [r["ref_id"] for r in full] == [None, 1, 2, 3, 5, 6, None, 0, None, 4]
    none = report.report_rows(results.filter("status = 'website'"), full=True).orderBy("part", F.col("ref_id").asc_nulls_first()).collect()
    assert none[0]["markdown"].endswith(report.NO_PROBLEM) and none[1]["markdown"].endswith(report.NONE_OK) and len(none) == 4
    report.write_markdown(report.report_rows(results, full=True), str(tmp_path / "report"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text.index("# Reference Audit Report (Full)") < text.index("## ⚠️ Likely Wrong Citation") < text.index("## 正常") < text.index("🌐")


def test_partial_section(spark, results):
    found = results.filter("ref_id = 0").withColumns({"verification_status": F.lit("partial"), "unchecked_sources": F.array(F.lit("jalc"))})
    lines = section(found, 0)
    assert lines[0] == "## ⏱ 検証未完了" and lines[3:5] == ["- 現時点のマッチ: **Slow tides in narrow harbours**", "- DOI: `10.5555/w1`"] and "- 未検証ソース: `jalc`" in lines


def test_interactive_view(spark, results):
    got = {r["ref_id"]: r for r in report.browser_lines(results.withColumn("input_text", F.concat("input_text", F.lit("`")))).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {0: "ok", 1: "likely_wrong", 2: "not_found", 3: "year_warning", 4: "website", 5: "retracted", 6: "not_found"}
    assert got[0]["verdict"] == f"**[正常]** `{LINE}\\`` — Slow tides in narrow harbours (DOI: 10.5555/w1)" and got[0]["markdown"] is None
    assert got[1]["markdown"].startswith("### ⚠️ Likely Wrong Citation\n\n- 入力: `") and "#### 修正候補" in got[1]["markdown"]
    assert got[5]["markdown"].split("\n")[6] == "#### 参照された更新（通知）"


def test_classes(spark):
    rows = [("error", False, None, "complete"), ("likely_wrong", False, "year_warning", "partial"), ("not_found", False, None, "partial"), ("found", False, "year_warning", "partial"), ("found", False, None, "partial"), ("found", True, None, "complete"), ("found", False, None, "complete"), ("website", False, None, "complete")]
    table_ = spark.createDataFrame(rows, "status string, retracted boolean, note string, verification_status string")
    assert [r[0] for r in table_.select(report.browser_class()).collect()] == ["error", "likely_wrong", "not_found", "year_warning", "partial", "retracted", "ok", "website"]


def test_json_and_answers(spark, results):
    body = json.loads(report.as_json(results.filter("ref_id = 2")).first()["json"])
    assert body["ok"] is True and body["result"]["status"] == "not_found" and body["diagnostics"] == {"budget_sec": 55.0, "skipped": ["pubmed"], "source_errors": {"jalc": "TimeoutError"}}
    good = json.dumps({"ref": "x", "email": "a@b.co"})
    rows = [("GET", None), ("OPTIONS", None), ("POST", "{"), ("POST", "{}"), ("POST", json.dumps({"ref": "x", "email": "nope"})), ("POST", good)]
    got = report.responses(spark.createDataFrame(rows, "verb string, body string")).collect()
    assert [(r["code"], r["answer"] and json.loads(r["answer"])["error"]) for r in got] == [(405, "method_not_allowed"), (204, None), (400, "invalid_json"), (400, "reference text is required"), (400, "email format is invalid"), (None, None)]


def test_other_sources(spark, works):
    """An article of PubMed completed by its DOI, an arXiv preprint behind its published version, a Japanese title."""
    doi = table(spark, work(1, "Slow tides in narrow harbours"), work(7, "Lanterns for blind corridors", authors=["ito"], venue="Optics", volume=None, issue=None, page=None), work(8, "夜の港の潮流と月の満ち欠けについての研究", authors=["山川"], venue="医学教育", doi="10.1241/j8"))
    pubmed = table(spark, work(50, "Copper kettles and their makers", authors=["hale"], venue="Metal", year=2011, volume="3", issue="1", page="5-9", doi="10.5555/w50", source="pubmed", source_id="p50"))
    arxiv = table(spark, work(60, "Lanterns for blind corridors", authors=["ito"], doi="10.5555/w7", venue="arXiv", source="arxiv", source_id="2101.00001v2", is_preprint=True))
    jalc = spark.createDataFrame([("夜の港の潮流と月の満ち欠けについての研究", "10.1241/j8"), ("別の題", None)], "title string, doi string")
    everything = doi.unionByName(table(spark, work(50, "Copper kettles and their makers", authors=["hale"], venue="Metal", venue_aliases=["Metals"], year=2011, volume="3", issue="1", page="5-9", doi="10.5555/w50")))
    lines = ["Hale A. Copper kettles and their makers. Metal 2011; 3(1): 5-9.", "Ito K. Lanterns for blind corridors. 2020. arXiv:2101.00001", "山川千佳. 夜の港の潮流と 月の満ち欠けについての研究. 医学教育 2020; 7(2): 10-19."]
    only = doi.filter("work_id = 1")
    got = {r["ref_id"]: r for r in run(spark, lines, only.unionByName(everything.filter("work_id <> 1").withColumn("title", F.when(F.col("work_id") == 50, "Unrelated words").otherwise(F.col("title")))), sources={"pubmed": pubmed, "arxiv": arxiv, "jalc": jalc}).collect()}
    assert (got[0]["status"], got[0]["method"]) == ("found", "pubmed-full-citation+doi-crossref")
    assert got[1]["matched_title"] == "Lanterns for blind corridors" and got[1]["arxiv_doi"] == "10.5555/w7" and got[1]["best_candidate"]["source"] != "arxiv"
    assert got[2]["matched_doi"] == "10.1241/j8"


def test_arxiv_titles(spark):
    entries = table(
        spark, work(1, "The $x$ of \\emph{slow} tides", authors=["marlow"], source_id="a1"), work(2, "Slow tides", authors=["zell"], source_id="a2"),
        work(3, "Storms over open sea and land today", authors=["hale"], source_id="a3"),
    )
    refs = spark.createDataFrame(
        [(1, None, "Slow tides", ["marlow"]), (2, None, "Slow tides", ["nobody"]), (3, None, "Storms over open sea", ["x"]), (4, None, "Storms of ink", ["x"]), (5, "a2v3", None, None), (6, "zz", "Slow tides", ["zell"])],
        "ref_id long, arxiv_id string, title string, authors array<string>",
    )
    got = {r["ref_id"]: (r["source_id"], r["method"]) for r in collect.arxiv_hits(refs, entries).collect()}
    assert got == {1: ("a1", "arxiv-title-search"), 2: ("a1", "arxiv-title-search"), 3: ("a3", "arxiv-title-search"), 5: ("a2", "arxiv-id")}


def test_resolver_chain(spark):
    agencies = spark.createDataFrame([("10.1", "Crossref"), ("10.2", "DataCite"), ("10.3", "JaLC"), ("10.4", "mEDRA")], "prefix string, agency string")
    x = table(spark, work(1, "x1", doi="10.1/a"), work(2, "x9", doi="10.9/a"))
    d = table(spark, work(3, "d2", doi="10.2/a"))
    n = table(spark, *[work(10 + i, f"n{i}", doi=f"10.{i}/{k}") for i in (1, 2, 3, 4, 8, 9) for k in "ab"])
    asked = spark.createDataFrame([(v,) for v in ("10.1/A", "10.1/b", "10.2/a", "10.2/b", "10.3/a", "10.4/a", "10.8/a", "10.9/a", "10.7/z")], "doi string")
    got = {r["doi"]: (r["w"] and r["w"]["title"], r["doi_method"]) for r in collect.resolve(asked, agencies, x, d, n).collect()}
    assert got == {
        "10.1/A": ("x1", "doi-crossref"), "10.1/b": (None, "doi-crossref"), "10.2/a": ("d2", "doi-datacite"), "10.2/b": (None, "doi-datacite"), "10.3/a": ("n3", "doi-jalc"),
        "10.4/a": ("n4", "doi-medra"), "10.8/a": ("n8", "doi-content-negotiation"), "10.9/a": ("x9", "doi-crossref"), "10.7/z": (None, "doi-content-negotiation"),
    }
    loose = {r["doi"]: r["w"] and r["w"]["title"] for r in collect.resolve(asked, agencies, x, d, n, strict=False).collect()}
    assert loose["10.1/b"] == "n1" and loose["10.2/b"] == "n2"


def test_quoting(spark):
    from urllib.parse import quote, quote_plus

    values = ["10.1/a b", "a+b&c=d", "~é*'()", "漢字/x", "%"]
    rows = spark.createDataFrame([(v,) for v in values], "x string").select("x", X.path_quote(F.col("x")).alias("p"), X.query_quote(F.col("x")).alias("q"), X.escape_ticks(F.lit("a`b")).alias("t"), X.lower_squeezed(F.lit("  A  b ")).alias("l")).collect()
    assert all((r["p"], r["q"]) == (quote(r["x"]), quote_plus(r["x"])) for r in rows) and (rows[0]["t"], rows[0]["l"]) == ("a\\`b", "a b")


def test_alias_lookup_takes_issns_before_titles(spark):
    from biblens.operators.retrieve import with_aliases

    rows = [(1, ["9", "1", " 1", "", "5"], "J A", [], True), (2, ["7"], "J A", [], True), (3, ["1"], "J A", [], False), (4, [" "], "J A.", [], True), (5, None, "J A", ["X"], True)]
    pairs = spark.createDataFrame([(*r, False) for r in rows], "ref_id long, issns array<string>, venue string, venue_aliases array<string>, gate boolean, aliases_resolved boolean")
    names = spark.createDataFrame([("1", None, []), ("5", None, ["Five"]), ("5", None, ["Cinq"]), ("9", None, ["Nine"]), (None, "j a", ["Title"])], "issn string, title_norm string, aliases array<string>")
    got = {r["ref_id"]: (r["venue_aliases"], r["aliases_resolved"]) for r in with_aliases(pairs, names).collect()}
    assert got == {1: (["Cinq", "Five"], True), 2: ([], True), 3: ([], False), 4: (["Title"], True), 5: (["X", "Title"], True)}


def test_record_columns_are_kept():
    assert set(RECORD_COLUMNS) <= {c.split()[0] for c in KIND.split(", ")} and decide.PAYLOAD[0] == "title"
