"""Golden cases of parsing, scoring, deciding and reporting, and every query against its SQL."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from biblens.functions import similarity as S
from biblens.functions import text as X
from biblens.operators import collect, decide, parse, report, retrieve, score
from biblens.plans import queries as Q
from biblens.plans.audit import audit, candidates
from biblens.sources import payloads
from biblens.sources import text as T
from biblens.sources.payloads import RECORD_COLUMNS

SF = "/root/testdata/sf0.001"


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_split(spark):
    rows = T.split_references(T.from_text(spark, "[1] First\nReferences\n\n2. Second\r\n3)\n"))
    assert [r["input_text"] for r in rows.orderBy("line_no").collect()] == ["First", "Second", ""]


@pytest.mark.parametrize(
    ("text", "doi"), [("see 10.1000/abc.1).", "10.1000/abc.1"), ("none here", None), (None, None), ('"10.1000/x" more', "10.1000/x")]
)
def test_doi(spark, text, doi):
    assert one(spark, parse.doi, text) == doi


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("arXiv:2307.06464. 2023.", "2307.06464"), ("arXiv:2307.06464v1.", "2307.06464v1"), ("https://arxiv.org/abs/2510.06708v1", "2510.06708v1"),
        ("arXiv:hep-th/9901001", "hep-th/9901001"), ("arXiv:math.AG/0601001v1", "math.AG/0601001v1"), ("x arXiv 2510.06708.", "2510.06708"), ("J Anesth 2307.06464", None),
        ("ARXIV: HEP-TH/9901001", "HEP-TH/9901001"), ("arXiv:cond-mat.mes-hall/0601001", "cond-mat.mes-hall/0601001"), ("arXiv, 2307.064645678", None), ("arXiv x2307.06464", None),
    ],
)
def test_arxiv_id(spark, text, found):
    assert one(spark, parse.arxiv_id, text) == found


def test_year_is_the_last_one(spark):
    assert one(spark, parse.year, "A. Title. 2017. 10.1136/bmjopen-2016-012545") == 2016
    assert one(spark, parse.year, "no 12019 year") is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("J X 2020; 39(Suppl 2):S45-S50.", ("39", "Suppl 2", "S45-S50")), ("Y 2001;10(3 Pt 1):100-110", ("10", "3 Pt 1", "100-110")), ("Z 7: e12", ("7", None, "e12")),
        ("Z v7.12, 5", ("12", None, "5")), ("no numbers", (None, None, None)), ("3( 4 ), 5–9", ("3", "4", "5–9")),
    ],
)
def test_numbers(spark, text, want):
    assert tuple(one(spark, parse.numbers, text)) == want


def test_article_number(spark):
    got = {t: one(spark, parse.article_number, t) for t in ("e29080", "12a4", "S45_1", "1-9", "5–9", "x", None)}
    assert got == {"e29080": "e29080", "12a4": "12a4", "S45_1": "S45_1", "1-9": None, "5–9": None, "x": None, None: None}


def test_venue(spark):
    def venue(line, title):
        return spark.createDataFrame([(line, title)], "x string, t string").select(parse.venue(F.col("x"), F.col("t")).alias("y")).first()["y"]

    assert venue("A B. Some title. J Med. 2019; 3: 4.", "Some title") == "J Med"
    assert venue("J Med, DOI: 10.1/x 2019", None) == "J Med"
    assert venue("Some title. Available from arXiv 2019", "Some title") == "Available from arXiv"
    assert venue("Some title. Available from 2019 arXiv", "Some title") == "arXiv"


def test_websites_by_words_beside_the_address(spark):
    assert one(spark, parse.is_website, "one.two,three;four:five six seven eight https://x.org/a nine") is False
    assert one(spark, parse.is_website, "one.two a.b,c;d:e three four five six seven eight https://x.org/a") is True


def test_website(spark):
    assert one(spark, parse.is_website, "Covidence systematic review software, Melbourne")
    assert one(spark, parse.is_website, "Rayyan. https://rayyan.ai")
    assert not one(spark, parse.is_website, "Smith A. A trial of early caffeine therapy in preterm infants. BMJ Open 2020; 1(2): 3.")


def test_record(spark):
    line = "Barlow S, Kent BM. Mirror training of careful wooden puppets. Puppet Serious Plays 2021; 9(3): e29081."
    r = parse.parse(spark.createDataFrame([(1, line)], "ref_id long, input_text string")).first()
    assert (r["year"], r["volume"], r["issue"], r["page"], r["article_number"], r["venue"]) == (2021, "9", "3", "e29081", "e29081", "Puppet Serious Plays")
    assert r["authors"] == ["barlow", "kent"]
    assert parse.parse(spark.createDataFrame([(1, None)], "ref_id long, input_text string")).first()["doi"] is None


def test_bibtex(spark):
    text = "@comment{x}\n@ARTICLE{k, author = {Ibsen, E and Jo Kettle}, title = {{A} {Great} Title}, year = 2025, journal=\"J, A\", doi={10.1/x}}\n@misc{e, title={T}, eprint={2307.06464}, archiveprefix={arXiv}"
    rows = [r["input_text"] for r in T.load_references(T.from_text(spark, text)).orderBy("line_no").collect()]
    assert rows[0] == "Ibsen, Kettle. 2025. A Great Title. J, A. DOI: 10.1/x"
    assert "arXiv:2307.06464" in rows[1]
    assert not one(spark, T.is_bibtex, None) and one(spark, T.is_bibtex, "@BOOK{key, title={T}}")


def test_normalize(spark):
    assert one(spark, X.normalize_text, "  Ｈéllo,  World_1! ") == "héllo world_1"
    assert one(spark, X.normalize_venue, "Radiology [Internet]") == "radiology"
    assert one(spark, X.normalize_author, "山川千佳") == "山川"
    assert one(spark, X.normalize_author, "O'Brien, J") == "obrien"
    assert one(spark, X.normalize_arxiv, r"The $x^2$ \emph{case}, again") == "the case again"
    assert one(spark, X.normalize_number, "361-76") == "36176"


def test_abbreviation(spark):
    df = spark.createDataFrame([("j anesth", "journal of anesthesia"), ("anesth j", "journal of anesthesia"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(S.looks_like_abbreviation(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert S._venue(["j anesth"], ["journal of anesthesia"]) == (0.95, "abbrev")
    assert S._venue(["digit health"], ["digital health", "digit health"])[0] == 1.0
    assert S.ratio("tide", "diet") == 0.25 and S.ratio("diet", "tide") == 0.5


def pair(spark, mine, theirs):
    base = dict(title=None, authors=[], year=None, venue=None, volume=None, issue=None, page=None, article_number=None)
    kind = "title string, authors array<string>, year int, venue string, volume string, issue string, page string, article_number string"
    more = ", venue_aliases array<string>, doi string, source string, source_id string, is_preprint boolean, aliases_resolved boolean"
    extra = dict(venue_aliases=[], doi=None, source="crossref", source_id=None, is_preprint=False, aliases_resolved=False)
    return spark.createDataFrame([(1, base | mine, base | extra | theirs)], f"ref_id long, r struct<{kind.replace(' ', ':').replace(',:', ',')}>, c struct<{(kind + more).replace(' ', ':').replace(',:', ',')}>")


WHOLE = dict(title="A long title of a good study", authors=["ibsen", "kettle"], year=2024, venue="J Anesth", volume="38", issue="2", page="1-9")


def test_scores(spark):
    exact = score.score(pair(spark, WHOLE, WHOLE)).first()
    assert exact["total"] == 1.0 and exact["decision"] == "accept"
    near = score.score(pair(spark, WHOLE | dict(volume=None, issue=None, page=None), WHOLE | dict(year=2025, venue="Journal of Anesthesia"))).first()
    assert near["total"] == 0.765 and near["decision"] == "accept"
    states = {d["field"]: d["state"] for d in near["field_diffs"]}
    assert states == {"title": "ok", "authors": "ok", "year": "near", "venue": "ok", "pages": "missing_input"}
    wrong = score.score(pair(spark, WHOLE | dict(title="Something else entirely here"), WHOLE)).first()
    assert wrong["decision"] == "suggest" and wrong["note"] == "candidate_mismatch"
    other = score.score(pair(spark, WHOLE, WHOLE | dict(venue="Radiology"))).first()
    assert {d["field"]: d["state"] for d in other["field_diffs"]}["venue"] == "unverified"
    nothing = score.score(pair(spark, {}, {})).first()
    assert nothing["total"] == 0.0 and nothing["decision"] == "reject"


def test_audit_end_to_end(spark):
    works = Q.works_table(spark, SF)
    lines = [
        (1, "Abaason A, Mcaaer B. Notes on nothing at all here. J. 2001; 1(1): 2. DOI: 10.5555/p0."),
        (2, "X Y. Some unknown words altogether zzz. 2001. DOI: 10.9999/none"),
        (3, "Tool https://example.org"),
        (4, ""),
        (5, None),
    ]
    got = {r["ref_id"]: r for r in audit(spark.createDataFrame(lines, "ref_id long, input_text string"), works, Q._sql(spark, SF, Q.NOTICES)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "likely_wrong", 2: "not_found", 3: "website", 4: "not_found", 5: "not_found"}
    assert got[2]["note"] == "doi_not_resolved" and got[1]["matched_doi"] == "10.5555/p0" and got[1]["retraction_checked"]


def test_audit_finds_and_does_not_depend_on_order(spark):
    refs = Q.references_table(spark, SF).filter("ref_id % 3 = 0").select("ref_id", "input_text")
    a = {r["ref_id"]: (r["status"], r["note"]) for r in audit(refs, Q.works_table(spark, SF)).collect()}
    b = {r["ref_id"]: (r["status"], r["note"]) for r in audit(refs.orderBy(F.desc("ref_id")), Q.works_table(spark, SF)).collect()}
    assert a == b and sum(s == "found" for s, _ in a.values()) > 300


def test_citations_without_title_are_searched_whole(spark):
    works = Q.works_table(spark, SF)
    least = works.agg(F.min("work_id")).first()[0]
    works = works.withColumn("title", F.when(F.col("work_id") == least, "Zymurgy of quokkas").otherwise(F.col("title")))
    parsed = parse.parse(spark.createDataFrame([(1, "Smith J, Zymurgy of quokkas, 2001")], "ref_id long, input_text string"))
    untitled = parsed.withColumns({"title": F.lit(None).cast("string"), "doi": F.lit(None).cast("string"), "is_website": F.lit(False)})
    got = candidates(untitled, works).collect()
    first = min(got, key=lambda r: r["ordinal"])
    assert (len(got), first["c"]["title"], first["method"]) == (5, "Zymurgy of quokkas", "bibliographic")


def test_reports_run_the_whole_audit(spark, monkeypatch):
    told, results = [], spark.range(0)
    monkeypatch.setattr(Q, "audit", lambda refs, works, notices=None, **more: told.append((notices is not None, more)) or results)
    monkeypatch.setattr(report, "report_rows", lambda r: r)
    monkeypatch.setattr(report, "as_json", lambda r: r)
    for name in ("report_markdown", "json_payload"):
        Q.queries()[name](spark, SF)
    assert told == [(True, {})] * 2


def test_json_payloads(spark):
    work = {"DOI": "10.1/A", "title": ["T"], "author": [{"family": "Smith"}, {"name": "Group X"}], "issued": {"date-parts": [[None]]}, "published-online": {"date-parts": [[2020, 1]]}, "container-title": ["J"], "page": "e1"}
    rows = spark.createDataFrame([(1, json.dumps(work)), (2, "not json")], "k long, json string")
    got = {r["k"]: r for r in payloads.work_records(payloads.works_json(rows), ["k"]).collect()}
    assert got[1]["doi"] == "10.1/a" and got[1]["year"] is None and got[1]["article_number"] == "e1" and got[2]["doi"] is None


def test_arxiv_entry(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2307.06464v1</id><title>A  T</title><author><name>Ann Bee</name></author><published>2023-07-12T00:00:00Z</published><arxiv:doi>10.1/X</arxiv:doi></entry></feed>'
    rows = payloads.arxiv_entries(spark.createDataFrame([(xml,), ("<feed><entry><title>Error</title></entry></feed>",)], "xml string"))
    r = payloads.arxiv_records(rows).collect()
    assert len(r) == 1 and (r[0]["title"], r[0]["year"], r[0]["doi"], r[0]["is_preprint"]) == ("A T", 2023, "10.1/x", True)


def test_report(spark):
    rows = spark.createDataFrame([(1, "a", "likely_wrong", False, None, True, "complete"), (2, "b", "found", True, "year_warning", False, "complete")], "ref_id long, input_text string, status string, found boolean, note string, retracted boolean, verification_status string")
    assert [r["s"] for r in rows.select(report.section().alias("s")).collect()] == ["retracted", "year_warning"]
    bad = spark.createDataFrame([("x", "nope")], "ref string, email string")
    assert report.validate_requests(bad).first()["error"] == "email format is invalid"


def test_block_is_the_join_on_every_word(spark, monkeypatch):
    """Titles of frequent words only included; both rounds of the search."""
    import random

    r = random.Random(3)
    vocabulary = ["of", "the", "and", *(f"w{i}" for i in range(12))]
    title = lambda: " ".join(r.choices(vocabulary, [30, 20, 10, *range(12, 0, -1)], k=r.randint(1, 7)))
    works = [(i, title()) for i in range(300)] + [(900, None), (901, "!")]
    refs = [(i, title()) for i in range(80)] + [(80, "of the"), (81, None), (82, "unknown"), (83, "the")]
    words = {i: set(t.split()) for i, t in works if t and t != "!"}
    df = {}
    for w in words.values():
        for x in w:
            df[x] = df.get(x, 0) + 1
    import math

    idf = {x: round(math.log(1 + len(words) / n) * 1000) for x, n in df.items()}
    want = set()
    for i, t in refs:
        mine = set((t or "").split())
        scored = sorted((-sum(idf[x] for x in mine & w), k, len(mine & w)) for k, w in words.items() if mine & w)[:5]
        want |= {(i, k, hits, -s, n + 1) for n, (s, k, hits) in enumerate(scored)}
    for first in (200, 1):
        monkeypatch.setattr(retrieve, "FIRST", first)
        got = retrieve.block(spark.createDataFrame(refs, "ref_id long, title string"), spark.createDataFrame(works, "work_id long, title string"))
        assert {tuple(x) for x in got.collect()} == want


def test_block_ties(spark):
    works = spark.createDataFrame([(2, "rare words"), (1, "rare words"), (3, None)], "work_id long, title string")
    refs = spark.createDataFrame([(9, "Rare, words!")], "ref_id long, title string")
    assert [r["work_id"] for r in retrieve.block(refs, works, 1).collect()] == [1]


def test_stream(spark, tmp_path):
    from biblens.streaming.audit import audit_stream

    spark.createDataFrame([(1, "Tool https://example.org")], "ref_id long, input_text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ref_id long, input_text string").parquet(str(tmp_path / "in"))
    got = []
    q = audit_stream(stream, Q.works_table(spark, SF), lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["status"] for r in got] == ["website"]


def test_retractions_are_counted_once(spark):
    rows = [("n1", "10.1/a", "Retraction", "p", "l", "2020"), ("n1", "10.1/A", "Retraction", "p", "l", "2020"), ("n2", "10.1/a", "correction", "p", "l", "2020")]
    found = decide.retractions(spark.createDataFrame(rows, "notice_doi string, target_doi string, update_type string, source string, label string, updated string")).collect()
    assert len(found) == 1 and len(found[0]["retraction_details"]) == 1


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    a, b = Q.queries()[name](spark, SF).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    text = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert text(a) == text(b)


def test_key_terms(spark):
    text = "Smith J, Doe A, Roe B, Poe C. Early caffeine, EARLY use. Lancet 2013;12(3):45-67. doi 10.1000/x.y"
    got = collect.search_stages(spark.createDataFrame([(1, text), (2, None), (3, "plain words")], "ref_id long, input_text string")).collect()
    assert got[0]["key_terms"] == "2013 Smith Doe Roe Lancet Early caffeine use"
    assert got[0]["simplified"] == "Smith J Doe A Roe B Poe C Early caffeine EARLY use Lancet 2013 doi"
    assert [r["key_terms"] for r in got[1:]] == ["", ""] and got[1]["cleaned"] == ""


def _works(spark, *rows):
    """Records from dictionaries."""
    types = {"year": "int", "is_preprint": "boolean", "aliases_resolved": "boolean"} | dict.fromkeys(("authors", "venue_aliases", "issns"), "array<string>")
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in RECORD_COLUMNS)
    blank = dict.fromkeys(("authors", "venue_aliases", "issns"), []) | {"is_preprint": False, "aliases_resolved": False}
    return spark.createDataFrame([tuple((blank | r).get(c) for c in RECORD_COLUMNS) for r in rows], schema)


def test_staged_candidates(spark):
    works = spark.createDataFrame([(i, t) for i, t in enumerate(["caffeine therapy early", "renal outcomes", "another thing"])], "work_id long, title string")
    refs = spark.createDataFrame([(1, "renal outcomes"), (2, "nothing here")], "ref_id long, input_text string")
    got = collect.staged_candidates(refs, works).collect()
    assert [(r["ref_id"], r["work_id"], r["stage"]) for r in got] == [(1, 1, "raw")]


def test_candidates_by_way_of_other_sources(spark):
    works = _works(spark, {"title": "Published", "doi": "10.1/A", "volume": "7", "source": "crossref"})
    entries = _works(spark, {"title": "Pre", "doi": "10.1/a", "source_id": "2001.00001v2", "is_preprint": True}, {"title": "Alone", "source_id": "2001.00002"})
    refs = spark.createDataFrame([(1, "2001.00001"), (2, "2001.00002v9"), (3, None), (4, "2001.9")], "ref_id long, arxiv_id string")
    got = collect.arxiv_candidates(refs, entries, works).orderBy("ref_id", "ordinal").collect()
    assert [(r["ref_id"], r["c"]["title"], r["method"]) for r in got] == [(1, "Published", "doi-crossref"), (1, "Pre", "arxiv-id"), (2, "Alone", "arxiv-id")]

    titles = spark.createDataFrame([(1, "\u6f22\u5b57\u306e\u984c"), (2, "latin")], "ref_id long, title string")
    hits = spark.createDataFrame([(1, "a", "10.1/a", 1), (1, "b", "10.1/b", 2), (1, "c", None, 3), (2, "d", "10.1/a", 1)], "ref_id long, title string, doi string, rank int")
    got = collect.japanese_candidates(titles, hits, works).orderBy("ordinal").collect()
    assert [(r["c"]["title"], r["c"]["source"], r["method"]) for r in got] == [("Published", "jalc", "jalc-title+doi-crossref"), ("b", "jalc-search", "jalc-title")]

    found = _works(spark, {"title": "Mine", "doi": "10.1/a", "source": "pubmed"}).select(F.struct("*").alias("c"))
    pairs = found.select(F.lit(1).alias("ref_id"), "c", F.lit("pubmed-full").alias("method")).unionByName(found.select(F.lit(2).alias("ref_id"), "c", F.lit("bibliographic").alias("method")))
    got = {r["ref_id"]: r for r in collect.enriched(pairs, works).collect()}
    assert (got[1]["c"]["title"], got[1]["c"]["volume"], got[1]["c"]["source"], got[1]["method"]) == ("Mine", "7", "pubmed-doi", "pubmed-full+doi-crossref")
    assert (got[2]["c"]["volume"], got[2]["method"]) == (None, "bibliographic")
