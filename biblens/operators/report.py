"""Reports: section of each result, its lines, counts, and the JSON form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblens.functions.text import escape_ticks, nullif_blank
from biblens.runtime import numbered

# Titles, headings and labels.
TITLE, TITLE_FULL = "Reference Audit Report", "Reference Audit Report (Full)"
INTRO = "対象：貼り付けテキストのうち **問題があった書誌**（未発見／誤引用候補／撤回系）だけを列挙しています。"
NO_PROBLEM, NONE_OK = "_問題のある書誌は見つかりませんでした。_", "_該当なし_"
HEADINGS = {
    "retracted": "🚩 撤回・撤回相当（Crossref 更新通知）",
    "partial": "⏱ 検証未完了",
    "year_warning": "△ 出版年注意",
    "likely_wrong": "⚠️ Likely Wrong Citation",
    "not_found": "❌ 未発見",
    "website": "🌐 ウェブサイト参照",
    "ok": "✅ 正常",
}
PART_BAD, PART_OK, PART_WEBSITE = "## 問題あり", "## 正常", "## ウェブサイト/ソフトウェア参照（検証対象外）"
YEAR_REMARK = "- 注: タイトル・著者は一致していますが、出版年が参照と異なる可能性があります。"
WEBSITE_REMARK = "- 説明: ソフトウェア/ウェブサイト参照のため学術DB検索はスキップしました。"
PARTIAL_REMARK = "- 検証状態: 一部ソースを検証できませんでした。"
BROWSER_LABELS = {
    "ok": "正常", "partial": "未検証あり", "likely_wrong": "誤引用候補", "not_found": "未発見",
    "retracted": "撤回", "year_warning": "年注意", "website": "ウェブサイト", "error": "エラー",
}
FIELD_LABELS = {"title": "📄 タイトル", "authors": "👤 著者", "year": "📅 出版年", "venue": "📚 掲載先", "pages": "📖 巻号・ページ"}


def is_problem() -> Column:
    partial = F.coalesce(F.col("verification_status") == "partial", F.lit(False))
    return F.col("status").isin("likely_wrong", "not_found") | F.col("retracted") | (F.coalesce("note", F.lit("")) == "year_warning") | partial


def section() -> Column:
    """Heading key; what comes first holds."""
    late = F.coalesce("note", F.lit("")) == "year_warning"
    partial = F.coalesce(F.col("verification_status") == "partial", F.lit(False))
    return (
        F.when(F.col("retracted"), "retracted")
        .when(F.col("status") == "website", "website")
        .when(partial & F.col("found"), "partial")
        .when(late & F.col("found"), "year_warning")
        .when(F.col("status") == "likely_wrong", "likely_wrong")
        .when(F.col("status") == "found", "ok")
        .otherwise("not_found")
    )


def browser_class() -> Column:
    """The eight classes of the interactive view, whose precedence differs."""
    late = F.coalesce("note", F.lit("")) == "year_warning"
    partial = F.coalesce(F.col("verification_status") == "partial", F.lit(False))
    return (
        F.when(F.col("status") == "error", "error")
        .when(F.col("retracted"), "retracted")
        .when(F.col("status") == "likely_wrong", "likely_wrong")
        .when(F.col("status") == "website", "website")
        .when(F.col("status") == "not_found", "not_found")
        .when((F.col("status") == "found") & late, "year_warning")
        .when(partial, "partial")
        .otherwise("ok")
    )


NO_LINES = "array<string>"


def _lines(*parts: Column | str | tuple[Column, Column]) -> Column:
    """An array of lines: texts, columns, arrays of lines, and (condition, line) pairs."""
    out = []
    for p in parts:
        if isinstance(p, tuple):
            out.append(F.when(F.coalesce(p[0], F.lit(False)), F.array(p[1])).otherwise(F.array().cast(NO_LINES)))
        elif isinstance(p, str):
            out.append(F.array(F.lit(p)))
        else:
            out.append(F.coalesce(p, F.array().cast(NO_LINES)))
    return F.concat(*out)


def _has(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c) != "", F.lit(False))


def _code(c: str | Column) -> Column:
    return F.concat(F.lit("`"), F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("None")), F.lit("`"))


def _strong(c: str | Column) -> Column:
    return F.concat(F.lit("**"), F.col(c) if isinstance(c, str) else c, F.lit("**"))


def _input() -> Column:
    return F.array(F.concat(F.lit("- 入力: "), _code("input_text")))


def _doi() -> tuple[Column, Column]:
    return _has("matched_doi"), F.concat(F.lit("- DOI: "), _code("matched_doi"))


def diff_lines(diffs: Column, item: str = "  - ", why: str = "    ") -> Column:
    """The fields to look at with both values and the reason, then those that agree in one line. ``item`` and ``why`` begin their lines."""
    label = F.create_map(*[x for k, v in FIELD_LABELS.items() for x in (F.lit(k), F.lit(v))])
    bad = F.filter(diffs, lambda d: d["state"].isin("mismatch", "abbrev", "near", "missing_input", "missing_candidate"))
    good = F.transform(F.filter(diffs, lambda d: d["state"] == "ok"), lambda d: label[d["field"]])

    def told(d: Column) -> Column:
        mine, theirs = F.coalesce(d["input_value"], F.lit("(なし)")), F.coalesce(d["candidate_value"], F.lit("(取得不可)"))
        head = F.concat(F.lit(item), label[d["field"]], F.lit(": "))
        one = F.concat(head, F.lit("入力="), mine, F.lit(" / Crossref="), theirs)
        two = F.concat(head, F.lit('"'), mine, F.lit('" → Crossref では "'), theirs, F.lit('"'))
        line = F.when(d["state"].isin("missing_input", "missing_candidate"), one).otherwise(two)
        return F.when(d["reason"].isNotNull(), F.array(line, F.concat(F.lit(f"{why}（"), d["reason"], F.lit("）")))).otherwise(F.array(line))

    return _lines(
        (F.size(bad) > 0, F.concat(F.lit("- ⚠ 要確認 ("), F.size(bad).cast("string"), F.lit("件):"))),
        F.flatten(F.transform(bad, told)),
        (F.size(good) > 0, F.concat(F.lit("- ✓ 一致 ("), F.size(good).cast("string"), F.lit("件): "), F.array_join(good, ", "))),
    )


def candidate_lines() -> Column:
    """The listed candidates, each with an empty line after it."""

    def one(p: Column) -> Column:
        where = F.concat(F.lit("- 書誌: "), F.coalesce(nullif_blank(p["container"]), F.lit("N/A")), F.lit(" / "), F.coalesce(p["year"].cast("string"), F.lit("N/A")))
        return _lines(
            F.array(F.concat(F.lit("- "), _strong(F.coalesce(nullif_blank(p["title"]), F.lit("(no title)"))))),
            (_has(p["doi"]), F.concat(F.lit("- DOI: "), _code(p["doi"]))),
            (_has(p["field_summary"]), F.concat(F.lit("- 比較: "), p["field_summary"])),
            (_has(p["container"]) | p["year"].isNotNull(), where),
            "",
        )

    return F.flatten(F.transform("candidates", one))


def verification_lines() -> Column:
    """Which sources were not checked or failed, if the verification is partial."""
    errors = F.transform(F.map_entries("source_errors"), lambda e: F.concat(F.lit("`"), e["key"], F.lit("`="), e["value"]))
    lines = _lines(
        PARTIAL_REMARK,
        (F.size("unchecked_sources") > 0, F.concat(F.lit("- 未検証ソース: "), F.array_join(F.transform("unchecked_sources", lambda s: F.concat(F.lit("`"), s, F.lit("`"))), ", "))),
        (F.size("source_errors") > 0, F.concat(F.lit("- ソースエラー: "), F.array_join(errors, ", "))),
    )
    return F.when(F.col("verification_status") == "partial", lines).otherwise(F.array().cast(NO_LINES))


def _heading(kind: str, level: str = "##") -> str:
    return f"{level} {HEADINGS[kind]}"


def section_lines(kind: str) -> Column:
    """The lines of a result in a section."""
    summary = (_has("comparison_summary"), F.concat(F.lit("- 比較: "), F.col("comparison_summary")))
    titled = lambda label: (_has("matched_title"), F.concat(F.lit(f"- {label}: "), _strong("matched_title")))
    title = F.concat(F.lit("- マッチ: "), _strong(F.coalesce(nullif_blank(F.col("matched_title")), F.lit("(no title)"))))
    listed, verified, diffs = F.size("candidates") > 0, verification_lines(), F.coalesce(diff_lines(F.col("field_diffs")), F.array().cast(NO_LINES))
    if kind == "year_warning":
        return _lines(_heading(kind), "", _input(), titled("マッチ"), _doi(), F.when(F.size(diffs) > 0, diffs).otherwise(F.array(F.lit(YEAR_REMARK))), verified, "")
    if kind == "not_found":
        reason = F.concat(F.lit("- 理由: "), F.coalesce(nullif_blank(F.col("note")), F.lit("候補なし")))
        shown = F.when(listed, _lines("### 候補", "", candidate_lines()))
        next_ = F.when(F.size("suggestions") > 0, _lines("### 次のチェック候補", "", F.transform("suggestions", lambda s: F.concat(F.lit("- "), s)), ""))
        return _lines(_heading(kind), "", _input(), F.array(reason), "", verified, "", shown, next_)
    if kind == "likely_wrong":
        return _lines(_heading(kind), "", _input(), titled("最有力候補"), _doi(), diffs, (_has("note"), F.concat(F.lit("- 注記: "), F.col("note"))), verified, "", F.when(listed, _lines("### 修正候補", "", candidate_lines())))
    if kind == "retracted":
        na = lambda c: F.coalesce(nullif_blank(c), F.lit("N/A"))
        notices = F.transform("retraction_details", lambda d: F.concat(F.lit("- 種別: "), _strong(d["update_type"]), F.lit(", 通知DOI: "), _code(d["notice_doi"]), F.lit(", source: "), _code(na(d["source"])), F.lit(", date: "), _code(na(d["updated"]))))
        return _lines(_heading(kind), "", _input(), F.array(title), F.array(F.concat(F.lit("- DOI: "), _code("matched_doi"))), "", "### 参照された更新（通知）", "", notices, verified, "")
    if kind == "website":
        return _lines(_heading(kind, "###"), _input(), WEBSITE_REMARK, "")
    if kind == "partial":
        return _lines(_heading(kind), "", _input(), titled("現時点のマッチ"), _doi(), summary, verified, "")
    return _lines(_heading("ok", "###"), _input(), F.array(title), _doi(), summary, "")


def section_text(results: DataFrame, full: bool = False) -> DataFrame:
    """(ref_id, section, markdown) of each result; in the full report websites and correct ones have sections too."""
    kind = section()
    text = None
    for k in HEADINGS:
        lines = F.array_join(section_lines(k), "\n")
        text = F.when(kind == k, lines) if text is None else text.when(kind == k, lines)
    return results.select("ref_id", kind.alias("section"), text.alias("markdown"))


def counts(results: DataFrame) -> DataFrame:
    ok = (F.col("status") == "found") & ~is_problem()
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(is_problem()).alias("bad"), F.count_if(F.col("status") == "website").alias("website")
    )


def problem_report(results: DataFrame) -> DataFrame:
    """(ref_id, section, markdown) of results that need attention."""
    return section_text(results.filter(is_problem()))


#: The parts of a full report, in order.
PARTS = ("head", "bad", "ok", "website")


def report_rows(results: DataFrame, full: bool = False) -> DataFrame:
    """(part, ref_id, markdown): a whole report, head first, to be read in order of part and ref_id.

    Every head is a row of its own, made from counts, so nothing is collected.
    """
    n = counts(results)
    head = lambda part, *lines: n.select(F.lit(part).alias("part"), F.lit(None).cast(results.schema["ref_id"].dataType).alias("ref_id"), F.array_join(_lines(*lines), "\n").alias("markdown"))
    bad, none_bad = problem_report(results), (F.col("bad") == 0, F.lit(NO_PROBLEM))
    part = lambda rows, name: rows.select(F.lit(name).alias("part"), "ref_id", "markdown")
    if not full:
        return head("0", f"# {TITLE}", "", INTRO, "", none_bad).unionByName(part(bad, "1 bad"))
    text = lambda c: F.col(c).cast("string")
    summary = F.concat(F.lit("合計: "), text("total"), F.lit("、正常: "), text("ok"), F.lit("、問題あり: "), text("bad"), F.lit("、ウェブサイト: "), text("website"))
    good = section_text(results.filter((F.col("status") == "found") & ~is_problem()))
    sites = section_text(results.filter(F.col("status") == "website"))
    out = head("0", f"# {TITLE_FULL}", "", F.array(summary), "", PART_BAD, "", none_bad).unionByName(part(bad, "1 bad"))
    out = out.unionByName(head("2", PART_OK, "", (F.col("ok") == 0, F.lit(NONE_OK)))).unionByName(part(good, "3 ok"))
    return out.unionByName(head("4", PART_WEBSITE, "").join(n.select("website"), F.col("website") > 0).drop("website")).unionByName(part(sites, "5 website"))


def write_markdown(report: DataFrame, path: str) -> None:
    """A report of ``report_rows`` as text files that read in order of their names; nothing is collected."""
    ordered = report.repartitionByRange("part", "ref_id").sortWithinPartitions("part", F.col("ref_id").asc_nulls_first())
    ordered.select(F.col("markdown").alias("value")).write.mode("overwrite").text(path)


def browser_lines(results: DataFrame, *more: str) -> DataFrame:
    """(ref_id, more, kind, verdict, markdown) of the interactive view: a verdict for each result, and its section if it needs attention."""
    kind = browser_class()
    label = F.create_map(*[x for k, v in BROWSER_LABELS.items() for x in (F.lit(k), F.lit(f"🚩 {v}" if k == "retracted" else v))])
    code = F.concat(F.lit("`"), escape_ticks(F.col("input_text")), F.lit("`"))
    verdict = F.concat(F.lit("**["), label[kind], F.lit("]** "), code, F.when(_has("matched_title"), F.concat(F.lit(" — "), F.col("matched_title"))).otherwise(""), F.when(_has("matched_doi"), F.concat(F.lit(" (DOI: "), F.col("matched_doi"), F.lit(")"))).otherwise(""))
    entry, none = F.array(F.concat(F.lit("- 入力: "), code)), F.array().cast(NO_LINES)
    titled = lambda name: (_has("matched_title"), F.concat(F.lit(f"- {name}: "), _strong("matched_title")))
    summary = F.concat(F.lit("- 比較: "), F.col("comparison_summary"))
    errors = F.transform(F.map_entries("source_errors"), lambda e: F.concat(F.lit("- ソースエラー: "), e["key"], F.lit(" / "), e["value"]))
    diffs = F.coalesce(diff_lines(F.col("field_diffs"), "-   • ", "-       "), none)
    listed = F.flatten(F.transform("candidates", lambda p: _lines(F.array(F.concat(F.lit("- "), _strong(F.coalesce(nullif_blank(p["title"]), F.lit("候補"))))), (_has(p["doi"]), F.concat(F.lit("- DOI: "), _code(p["doi"]))), (_has(p["field_summary"]), F.concat(F.lit("- 比較: "), p["field_summary"])), "")))
    na = lambda c: F.coalesce(nullif_blank(c), F.lit("N/A"))
    notices = F.transform("retraction_details", lambda d: F.concat(F.lit("- 種別: "), _strong(na(d["update_type"])), F.lit(", 通知DOI: "), _code(na(d["notice_doi"])), F.lit(", source: "), _code(na(d["source"])), F.lit(", date: "), _code(na(d["updated"]))))
    sections = {
        "partial": _lines(_heading("partial", "###"), "", entry, titled("現時点のマッチ"), _doi(), (_has("comparison_summary"), summary), (F.size("unchecked_sources") > 0, F.concat(F.lit("- 未検証ソース: "), F.array_join("unchecked_sources", ", "))), errors, ""),
        "likely_wrong": _lines(_heading("likely_wrong", "###"), "", entry, titled("最有力候補"), _doi(), F.when(F.size(diffs) > 0, diffs).otherwise(_lines((_has("comparison_summary"), summary))), F.when(F.size("candidates") > 0, _lines("", "#### 修正候補", "", listed)).otherwise(F.array(F.lit("")))),
        "year_warning": _lines(_heading("year_warning", "###"), "", entry, titled("マッチ"), _doi(), YEAR_REMARK, ""),
        "not_found": _lines(_heading("not_found", "###"), "", entry, F.array(F.concat(F.lit("- 理由: "), F.coalesce(nullif_blank(F.col("note")), F.lit("候補なし")))), ""),
        "retracted": _lines(_heading("retracted", "###"), "", entry, F.array(F.concat(F.lit("- マッチ: "), _strong(F.coalesce(nullif_blank(F.col("matched_title")), F.lit("(no title)"))))), F.array(F.concat(F.lit("- DOI: "), _code(na(F.col("matched_doi"))))), "", "#### 参照された更新（通知）", "", notices, ""),
    }
    failed = F.col("message") if "message" in results.columns else F.lit(None).cast("string")
    sections["error"] = _lines(_heading("not_found", "###"), "", entry, F.array(F.concat(F.lit("- 理由: "), F.coalesce(nullif_blank(failed), F.lit(API_ERROR)))), "")
    text = F.lit(None).cast("string")
    for k, lines in sections.items():
        text = F.when(kind == k, F.array_join(lines, "\n")).otherwise(text)
    return results.select("ref_id", *more, kind.alias("kind"), verdict.alias("verdict"), text.alias("markdown"))


PAGE_PARTS = ("## 入力", "## チェック結果", "## 注意すべき候補", "## Diagnostics")
PAGE_COUNTS = ("ok", "partial", "likely_wrong", "not_found", "retracted", "year_warning", "website", "error")
API_ERROR = "APIエラー"
ERRORS_REMARK = "> **エラーが発生しています。** 問題が解消しない場合、このレポートファイルを開発者にお送りください。"
DIAGNOSTICS_HEAD = ("| # | elapsed (s) | budget (s) | skipped | error |", "|---|---|---|---|---|")
FENCE = "```"


def page_report(results: DataFrame, entered: DataFrame | None = None, checks: DataFrame | None = None) -> DataFrame:
    """(part, number, markdown): the interactive view's whole report, to be read in order of part and number (0 for heads).

    What was entered (rows ``number``, ``line``; the references themselves, if left out) is echoed, then come the
    eight counts, a numbered verdict for each result in order of ref_id, the sections of those that need attention, and, if any
    does, the table of diagnostics: ``checks`` is (ref_id, elapsed_sec, budget_sec, skipped, source_errors, error), a row
    for each result; a result without one has dashes. Numbers are given by slices; nothing goes through one task.
    """
    results = numbered(results, [F.col("ref_id")])
    lines = browser_lines(results, "number")
    kinds = results.agg(*[F.count_if(browser_class() == k).alias(k) for k in PAGE_COUNTS])
    bad = reduce(lambda a, b: a + b, [F.col(k) for k in PAGE_COUNTS if k not in ("ok", "website")])
    head = lambda part, *text, of=kinds: of.select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("number"), F.array_join(_lines(*text), "\n").alias("markdown"))
    rows = lambda part, df, text: df.select(F.lit(part).alias("part"), F.col("number").cast("long"), text.alias("markdown"))
    echo = F.replace(F.coalesce("line", F.lit("")), F.lit(FENCE), F.lit("``\u200b`"))
    counted = [F.array(F.concat(F.lit(f"- {BROWSER_LABELS[k]}: "), F.col(k).cast("string"))) for k in PAGE_COUNTS]
    entered = results.select("number", F.col("input_text").alias("line")) if entered is None else entered
    out = [
        head("0", f"# {TITLE}", "", PAGE_PARTS[0], "", FENCE),
        rows("1", entered, echo),
        head("2", FENCE, "", PAGE_PARTS[1], "", *counted, ""),
        rows("3", lines, F.concat(F.col("number").cast("string"), F.lit(". "), F.col("verdict"))),
        head("4", "", PAGE_PARTS[2], "", (bad == 0, F.lit(NO_PROBLEM))),
        rows("5", lines.filter(~F.col("kind").isin("ok", "website")), F.col("markdown")),
    ]
    if checks is not None:
        table = results.select("ref_id", "number").join(checks, "ref_id", "left")
        short = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\.0$", ""), F.lit("-"))
        failed = F.array_join(F.transform(F.map_entries("source_errors"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ", ")
        cells = [short("elapsed_sec"), short("budget_sec"), F.coalesce(nullif_blank(F.array_join("skipped", ", ")), F.lit("-")), F.coalesce(nullif_blank(failed), F.lit("-"))]
        told = F.when(F.col("error").isNotNull(), F.array(F.lit("-"), F.lit("-"), F.lit("-"), F.col("error"))).otherwise(F.array(*cells))
        line = F.concat(F.lit("| "), F.array_join(F.array_insert(told, 1, F.col("number").cast("string")), " | "), F.lit(" |"))
        shown = kinds.filter(bad > 0)
        remark = F.when(F.col("error") > 0, F.array(F.lit(ERRORS_REMARK), F.lit("")))
        out.append(head("6", "---", "", PAGE_PARTS[3], "", remark, *DIAGNOSTICS_HEAD, of=shown))
        out.append(rows("7", table.filter(kinds.select(bad > 0).scalar()), line))
        out.append(head("8", "", of=shown))
    return reduce(DataFrame.unionByName, out)


def diagnostics(results: DataFrame, elapsed: Column | None = None, budget: float = 55.0) -> Column:
    """What a response tells of its checks: seconds taken and allowed, sources skipped and failed."""
    skipped = F.coalesce("unchecked_sources", F.array().cast(NO_LINES)) if "unchecked_sources" in results.columns else F.array().cast(NO_LINES)
    none = F.map_from_arrays(F.array().cast(NO_LINES), F.array().cast(NO_LINES))
    errors = F.coalesce("source_errors", none) if "source_errors" in results.columns else none
    return F.struct((F.lit(None).cast("double") if elapsed is None else F.round(elapsed, 2)).alias("elapsed_sec"), F.lit(budget).alias("budget_sec"), skipped.alias("skipped"), errors.alias("source_errors"))


def as_json(results: DataFrame, elapsed: Column | None = None) -> DataFrame:
    """(ref_id, json): ok, result and diagnostics, with the seconds that a check took if they are told."""
    body = F.struct(F.lit(True).alias("ok"), F.struct(*results.columns).alias("result"), diagnostics(results, elapsed).alias("diagnostics"))
    return results.select("ref_id", F.to_json(body).alias("json"))


def answers(asked: DataFrame, results: DataFrame, elapsed: Column | None = None) -> DataFrame:
    """(ref_id, code, answer) of requests (ref_id) that were let through: 200 with the result, or 500 where the check gave none."""
    found = as_json(results, elapsed)
    lost = F.to_json(F.struct(F.lit(False).alias("ok"), F.lit(INTERNAL).alias("error")))
    both = asked.select("ref_id").join(found, "ref_id", "left")
    return both.select("ref_id", F.when(F.col("json").isNull(), 500).otherwise(200).alias("code"), F.coalesce("json", lost).alias("answer"))


#: Answers to requests that can not be read, are not allowed, or fail.
INVALID_JSON, NOT_ALLOWED, INTERNAL = "invalid_json", "method_not_allowed", "internal_error"


def responses(requests: DataFrame) -> DataFrame:
    """(code, body) beside requests (verb, body): 405 for GET, 204 without a body for OPTIONS, 400 with the error of
    a POST that is no JSON or breaks a rule; null where the reference is to be checked."""
    read = requests.withColumn("_r", F.from_json(F.coalesce(nullif_blank(F.col("body")), F.lit("{}")), "ref string, email string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    told = validate_requests(read.withColumns({"ref": F.col("_r.ref"), "email": F.col("_r.email")}))
    error = F.when(F.col("verb") == "GET", NOT_ALLOWED).when(F.col("verb") == "OPTIONS", F.lit(None)).when(F.col("_r._bad").isNotNull(), INVALID_JSON).otherwise(F.col("error"))
    code = F.when(F.col("verb") == "GET", 405).when(F.col("verb") == "OPTIONS", 204).when(error.isNotNull(), 400)
    answer = F.when(error.isNotNull(), F.to_json(F.struct(F.lit(False).alias("ok"), error.alias("error"))))
    return told.select(*[c for c in requests.columns], code.alias("code"), answer.alias("answer"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests (ref, email) with ``error``, the first rule broken, and ``valid``."""
    ref, email = F.trim(F.coalesce("ref", F.lit(""))), F.trim(F.coalesce("email", F.lit("")))
    error = (
        F.when(ref == "", "reference text is required")
        .when(F.length(ref) > 2000, "reference text must be 2000 characters or fewer")
        .when(email == "", "email is required")
        .when((F.length(email) > 320) | ~email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email format is invalid")
    )
    return requests.withColumn("error", error).withColumn("valid", error.isNull())
