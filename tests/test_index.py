"""Searches of kept indexes against plain scans, citations searched whole, DOI chain and field states of the audit."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from biblens.operators import collect, index, score
from biblens.plans.audit import audit, citation_index
from biblens.runtime import scratch, shared_dir, write_table
from test_results import KIND, table, work

ASKED = "ref_id long, words array<string>"
NAMED = "work_id long, words array<string>"


def some_rows(seed):
    r = random.Random(seed)
    vocabulary = ["of", "the", "and", "in", *(f"w{i}" for i in range(14))]
    line = lambda: sorted(set(r.choices(vocabulary, [30, 20, 10, 8, *range(14, 0, -1)], k=r.randint(1, 7))))
    works = [(i, line()) for i in range(250)] + [(900, []), (901, None)] + [(1000 + i, ["of", "the"]) for i in range(30)]
    refs = [(i, line()) for i in range(80)] + [(80, ["of", "the"]), (81, None), (82, ["unknown"]), (83, ["the"]), (84, []), (85, ["of", "the"]), (86, ["of", "unknown", "w3"])]
    return works, refs


def plain(works, refs, power, top):
    words = {i: set(t) for i, t in works if t}
    df = {}
    for w in words.values():
        for x in w:
            df[x] = df.get(x, 0) + 1
    weight = {x: round(math.log(1 + len(words) / n) ** power * 1000) for x, n in df.items()}
    want = set()
    for i, t in refs:
        mine = set(t or ())
        scored = sorted((-sum(weight[x] for x in mine & w), k, len(mine & w)) for k, w in words.items() if mine & w)[:top]
        want |= {(i, k, hits, -s, n + 1) for n, (s, k, hits) in enumerate(scored)}
    return want


@pytest.mark.parametrize("power,top,first", [(2, 5, 100), (1, 3, 1), (2, 10, 1)])
def test_word_search_is_the_join_on_every_word(spark, tmp_path, power, top, first):
    works, refs = some_rows(top)
    kept = index.WordIndex.build(spark.createDataFrame(works, NAMED), power, str(tmp_path / "kept"))
    asked = spark.createDataFrame(refs, ASKED)
    want = plain(works, refs, power, top)
    assert {tuple(x) for x in kept.search(asked, top, first).collect()} == want
    if first == 100:
        again = index.WordIndex.open(spark, str(tmp_path / "kept"))
        assert {tuple(x) for x in again.search(asked, top).collect()} == want and again.profiles.count() > 3


def test_a_search_shuffles_no_pairs_of_works_and_queries(spark):
    r = random.Random(7)
    line = lambda i: sorted(r.sample([f"w{k}" for k in range(60)], 6))
    works, refs = [(i, line(i)) for i in range(3000)], [(i, line(i)) for i in range(600)]
    told = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    kept, before = index.WordIndex.build(spark.createDataFrame(works, NAMED)), told()
    got = {tuple(x) for x in kept.search(spark.createDataFrame(refs, ASKED)).collect()}
    assert got == plain(works, refs, 2, 5) and told() - before < 3_000_000


def test_blocks_meet_chunks(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 40)
    monkeypatch.setattr(index, "CHUNK", 20)
    works, refs = some_rows(6)
    got = index.WordIndex.build(spark.createDataFrame(works, NAMED)).search(spark.createDataFrame(refs, ASKED), 5, 1)
    assert {tuple(x) for x in got.collect()} == plain(works, refs, 2, 5)


def test_queries_go_on_only_to_blocks_that_may_hold_more(spark, monkeypatch):
    """Works of an author are in one block, where most of its queries end; others meet every block, and all answers are those of the join."""
    for name, most in (("BLOCK", 60), ("CHUNK", 50), ("LEAST", 5), ("ANCHOR", 3), ("SHARE", 4)):
        monkeypatch.setattr(index, name, most)
    r, both, plain_answers = random.Random(5), [], index._answers
    line = lambda i: [f"a{i % 60}", f"b{i % 60}", *sorted(r.sample([f"w{k}" for k in range(12)], 4))]
    works = [(i, line(i)) for i in range(400)] + [(400, ["alone", "w1"]), (401, None)]
    refs = [(i, line(i)) for i in range(200)] + [(200, ["w1", "w2", "alone"]), (201, ["a1", "a2", "a3"]), (202, ["no"]), (203, None)]
    monkeypatch.setattr(index, "_answers", lambda *more: both.append(more) or plain_answers(*more))
    written, plain_write = {}, index.write_table
    monkeypatch.setattr(index, "write_table", lambda df, name: written.setdefault(name, plain_write(df, name)))
    got = index.WordIndex.build(spark.createDataFrame(works, NAMED)).search(spark.createDataFrame(refs, ASKED), 5, 10)
    assert {tuple(x) for x in got.collect()} == plain(works, refs, 2, 5)
    near = written["found-near"][0]
    assert [len(m) for m in both] == [4, 3] and near.filter("not whole").count() < near.count() / 4


def test_queries_weighed_together_have_the_same_firsts(monkeypatch):
    """Ties, sets with nothing of the anchor, queries of unknown words and pieces of a group included."""
    r, pick = random.Random(3), lambda n, k: np.array(sorted((w << index.BITS) + c for c, w in r.sample(words, n) if c % k), np.int64)
    words = [(c, 900 - 20 * (c // 10)) for c in range(1, 300)] + [(c, 5) for c in range(300, 312)]
    sets = [np.union1d(pick(6, 2), pick(3, 300)) for _ in range(600)]
    held = [(pa.array([[i] for i in range(600)], pa.list_(pa.int64())), np.array([len(x) for x in sets]), np.concatenate(sets))]
    asked = [r.choice(sets)[::-1] for _ in range(150)] + [pick(5, 300)[::-1] for _ in range(150)] + [np.array([7 + (999 << index.BITS)])]
    monkeypatch.setattr(index, "ANCHOR", 8)
    for cells in (1 << 22, 3000):
        monkeypatch.setattr(index, "CELLS", cells)
        block, alone = index.Block(held, pa.list_(pa.int64())), []
        want, plain = [block.firsts(q, 5, 20) for q in asked], block.firsts
        block.firsts = lambda *more: alone.append(0) or plain(*more)
        got = block.many(np.concatenate(asked), np.array([len(q) for q in asked]), 5, 20)
        assert all(x.tolist() == y.tolist() for g, w in zip(got, want) for x, y in zip(g, w)) and 0 < len(alone) < len(asked)


def test_sets_and_queries_meet_in_their_realm_only(spark, monkeypatch):
    """A realm's sets go to one slot, those of a large one to slots of its own; answers are those of a join inside the realm."""
    for name, most in (("BLOCK", 40), ("CHUNK", 20), ("LEAST", 5)):
        monkeypatch.setattr(index, name, most)
    works, refs = some_rows(8)
    realm = lambda i: "ab" if i % 2 else f"r{i % 24}"
    named = [(i, realm(i), w) for i, w in works] + [(i, "other", w) for i, w in works[:100]]
    asked = [(i, realm(i), w) for i, w in refs] + [(500 + i, "none", w) for i, w in refs[:3]]
    kept = index.WordIndex.build(spark.createDataFrame(named, "work_id long, realm string, words array<string>"), total=len(works) - 2)
    want, inside = set(), lambda rows, r: [(i, w) for i, k, w in rows if k == r]
    for r in {k for _, k, _ in asked}:
        mine = inside(named, r)
        df = {x: sum(x in (w or ()) for _, w in mine) for _, w in mine for x in w or ()}
        weight = {x: round(math.log(1 + (len(works) - 2) / n) ** 2 * 1000) for x, n in df.items()}
        for i, w in inside(asked, r):
            shared = [(k, set(w or ()) & set(v or ())) for k, v in mine]
            scored = sorted((-sum(weight[x] for x in s), k, len(s)) for k, s in shared if s)[:5]
            want |= {(i, k, hits, -s, n + 1) for n, (s, k, hits) in enumerate(scored)}
    assert {tuple(x) for x in kept.search(spark.createDataFrame(asked, "ref_id long, realm string, words array<string>"), 5, 1).collect()} == want and len(want) > 200
    queries = spark.createDataFrame([(bytes([i]), r, [1]) for i, (_, r, _) in enumerate(asked)], "qid binary, realm string, codes array<long>")
    realms, large, bundles, parted = kept._slots(queries)
    assert [(r["realm"], r["base"], r["blocks"] > 1) for r in large.collect()] == [("ab", bundles, True)] and bundles < realms.count()
    alone = index.WordIndex(kept.sets.filter("realm <> 'ab'"), kept.words, kept.profiles)
    assert alone._slots(queries)[1].count() == 0 and not alone._slots(queries)[3].any()


def test_empty_indexes(spark):
    none, asked = spark.createDataFrame([], NAMED), spark.createDataFrame([(1, ["a"])], ASKED)
    assert index.WordIndex.build(none).search(asked).count() == 0 == index.PhraseIndex.build(none).search(asked).count()
    assert index.WordIndex.build(asked.withColumnRenamed("ref_id", "work_id")).search(spark.createDataFrame([], ASKED)).count() == 0


def test_phrase_search_cuts_after_the_phrase(spark):
    r = random.Random(4)
    works = [(i, r.choices(["a", "b", "c"], k=r.randint(1, 8))) for i in range(300)] + [(400 + i, ["b", "a"]) for i in range(30)] + [(500, []), (501, None)]
    refs = [(i, r.choices(["a", "b", "c"], k=r.randint(1, 6))) for i in range(60)] + [(70, ["a", "z"]), (71, []), (72, None), (73, ["z"]), (74, ["a"])]
    held = lambda t, p: any(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1))
    want = set()
    for i, p in refs:
        if p:
            want |= {(i, k, n + 1) for n, k in enumerate(sorted(k for k, t in works if t and held(t, p))[:5])}
    got = index.PhraseIndex.build(spark.createDataFrame(works, NAMED)).search(spark.createDataFrame(refs, ASKED))
    assert {tuple(x) for x in got.collect()} == want


def test_one_title_in_its_order_among_many_of_the_same_words(spark):
    titles = ["tides slow in harbours narrow", "narrow harbours in slow tides", "harbours slow narrow in tides", "slow narrow tides in harbours", "in slow tides narrow harbours", "harbours in narrow tides slow"]
    records = table(spark, *[work(i, t) for i, t in enumerate(titles)], work(9, "On slow tides in narrow harbours, again"))
    refs = spark.createDataFrame([(1, "Slow tides in narrow harbours")], "ref_id long, title string")
    assert [tuple(x) for x in collect.title_phrase(refs, records).collect()] == [(1, 9, 1)]


def test_the_right_author_among_many_equal_titles(spark):
    entries = table(spark, *[work(i, "Slow tides", authors=["zell", f"other{i}"], source_id=f"a{i}") for i in range(6)], work(9, "Slow tides", authors=["quill", "marlow"], source_id="a9"))
    refs = spark.createDataFrame([(1, None, "Slow tides", ["marlow"]), (2, None, "Slow tides", ["nobody"]), (3, None, "Slow tides", []), (4, None, "Slow tides", None)], "ref_id long, arxiv_id string, title string, authors array<string>")
    assert {r["ref_id"]: r["source_id"] for r in collect.arxiv_hits(refs, entries).collect()} == {1: "a9", 2: "a0", 3: "a0", 4: "a0"}


def golden(spark):
    blank = dict(volume=None, issue=None, page=None)
    rows = [
        work(1, "Augmented, mixed, and virtual reality-based head-mounted devices for medical education: systematic review", authors=["barteit", "lanfermann", "barnighausen"], year=2021, venue="JMIR Serious Games", volume="9", issue="3", page="e29080", article_number="e29080", doi="10.2196/29080"),
        work(2, "Virtual Reality for Medical Training: Systematic Review and Meta-Analysis by the Digital Health Education Collaboration", authors=["kyaw", "saxena", "posadzki"], year=2019, venue="J Med Internet Res", volume="21", issue="1", page="e12959", article_number="e12959"),
        work(3, "Simulation in Healthcare Education: A Best Evidence Practical Guide", authors=["motola", "devine", "chung"], year=2013, venue="Med Teach", volume="35", issue="10", page="e1511-e1530"),
        work(4, "Clinical debriefing patterns for engaged simulation teams", authors=["cheng", "rudolph", "morse"], year=2017, venue="Simul Healthc", volume="12", issue="5", page="319-25"),
        work(5, "Debriefing with good judgment: combining rigorous feedback with genuine inquiry", authors=["rudolph", "simon", "rivard"], year=2007, venue="Anesthesiol Clin", volume="25", issue="2", page="361-76"),
        work(6, "Cognitive assessment and training in extended reality: multimodal systems, clinical utility, and current challenges", authors=["gonzalez-erena", "fernandez-guinea", "kourtesis"], year=2024, venue="Preprints.org", is_preprint=True, **blank),
        work(7, "Cognitive assessment and training in extended reality: multimodal systems, clinical utility, and current challenges", authors=["gonzalez-erena", "fernandez-guinea", "kourtesis"], year=2025, venue="Encyclopedia", volume="5", issue="1", page="8"),
        work(8, "The control-value theory of achievement emotions: assumptions, corollaries, and implications for educational research and practice", authors=["pekrun"], year=2006, venue="Educ Psychol Rev", volume="18", issue=None, page="315-41"),
        work(9, "Japanese medical learners' achievement emotions: accounting for culture in translating western medical educational theories and instruments into an asian context", authors=["nomura", "wiseman", "sunohara"], year=2021, venue="Adv Health Sci Educ Theory Pract", volume="26", issue="4", page="1255-76"),
        work(10, "患者との医療コミュニケーションの重要性とその客観的評価研究", authors=["松村", "矢野"], year=2020, venue="京都薬科大学紀要", volume="1", issue="2", page="113-8"),
    ]
    lines = [
        "Barteit S, Kyaw BM, Muller A, et al. The Effectiveness of Digital Game-Based Learning in Health Professions Education: Systematic Review and Meta-Analysis. JMIR Serious Games2021; 9(3): e29080.",
        "Kyaw BM, Saxena N, Posadzki P, et al. Virtual Reality for Medical Training: Systematic Review and Meta-Analysis by the Digital Health Education Collaboration. J Med Internet Res 2019; 21(1): e12959.",
        "Motola I, Devine LA, Chung HS, et al. Simulation in Healthcare Education: A Best Evidence Practical Guide. Med Teach 2013; 35(10),e1511-e1530.",
        "Cheng A, Morse K, Rudolph J, et al. Strategies to Enhance Engagement in Healthcare Simulation. Simul Healthc 2017; 12(5): 319-25.",
        "Rudolph JW, Simon R, Raemer DB and Eppich WJ. Debriefing as Formative Assessment: Translating Medical Simulation into Effective Learning. Anesthesiol Clin 2007; 25(2): 361-76.",
        "Gonzalez-Erena PV, Fernandez-Guinea S and Kourtesis P. Cognitive Assessment and Training in Extended Reality: Multimodal Systems, Clinical Utility, and Current Challenges, arXiv,2025, 2501(08237). Available from.",
        "Pekrun R. The Impact of Academic Emotions on Learning and Achievement. Educ Psychol Rev 2006; 18: 315-41.",
        "Nomura O, Fukui T, Shimizu K, et al. The Role of Emotional Intelligence in Medical Education: Insights from a Longitudinal Study. Adv Health Sci Educ 2021; 26: 1255-76.",
        "松村千佳子・矢野義孝. 患者との医療コミュニケーションの重要性とその客観的評価研究. 医学教育 2020; 51(3): 123-30.",
    ]
    return spark.createDataFrame(rows, KIND), spark.createDataFrame(list(enumerate(lines, 1)), "ref_id long, input_text string")


def test_golden_references_are_found_by_their_whole_citation(spark):
    """All works in one table: each reference has to find its own, though the titles cited are mostly others."""
    works, refs = golden(spark)
    got = {r["ref_id"]: r for r in audit(refs, works).collect()}
    assert {k: r["status"] for k, r in got.items()} == {k: "found" if k in (2, 3) else "likely_wrong" for k in range(1, 10)}
    first = got[1]
    assert (first["matched_doi"], first["comparison_summary"]) == ("10.2196/29080", "title ~ / authors ok / year ok / venue ok / pages ok")
    assert {d["field"]: d["state"] for d in first["field_diffs"]} == {"title": "near", "authors": "ok", "year": "ok", "venue": "ok", "pages": "ok"}
    assert first["field_signals"] == {"title": "~", "authors": "ok", "year": "ok", "venue": "ok", "pages": "ok"} and first["candidates"][0]["doi"] == "10.2196/29080"


def test_audit_leaves_one_table_and_takes_a_kept_index(spark, tmp_path):
    works, refs = golden(spark)
    kept = citation_index(works, str(tmp_path / "citations"))
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    results = audit(refs, works, index=kept)
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert results.count() == 9 and len(left) == 1 and next(iter(left)).startswith("results-")
    with scratch(spark):
        write_table(spark.range(3), "gone")
        assert audit(refs.limit(1), works, index=kept).count() == 1
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before == left


def test_dois_go_through_the_agencies_in_the_audit(spark):
    title = "Slow tides in narrow harbours"
    line = f"Marlow A, Quill B. {title}. Coast Studies 2020; 7(2): 10-19. DOI: "
    agencies = spark.createDataFrame([("10.1001", "Crossref"), ("10.5001", "DataCite"), ("10.3001", "JaLC"), ("10.4001", "mEDRA")], "prefix string, agency string")
    own = lambda *dois: table(spark, *[work(i, title, doi=d) for i, d in enumerate(dois)])
    dois = collect.DoiTables(own("10.1001/a", "10.9001/c"), agencies, own("10.5001/a"), own("10.1001/b", "10.5001/b", "10.3001/a", "10.4001/a", "10.9001/n"))
    asked = ["10.1001/a", "10.1001/b", "10.5001/a", "10.5001/b", "10.3001/a", "10.4001/a", "10.9001/c", "10.9001/n", "10.9001/x"]
    refs = spark.createDataFrame([(i, line + d) for i, d in enumerate(asked)], "ref_id long, input_text string")
    got = {r["ref_id"]: r for r in audit(refs, own("10.7777/other"), dois=dois).collect()}
    assert [(got[i]["status"], got[i]["method"], got[i]["note"]) for i in range(9)] == [
        ("found", "doi-crossref", None), ("not_found", "doi-crossref", "doi_not_resolved"), ("found", "doi-datacite", None), ("not_found", "doi-datacite", "doi_not_resolved"),
        ("found", "doi-jalc", None), ("found", "doi-medra", None), ("found", "doi-crossref", None), ("found", "doi-content-negotiation", None), ("not_found", "doi-content-negotiation", "doi_not_resolved"),
    ]
    assert (got[0]["best_candidate"]["source"], got[0]["matched_doi"]) == ("doi", "10.1001/a")


def test_states_and_reasons_where_a_side_says_nothing(spark):
    whole = work(1, "Slow tides in narrow harbours")
    cases = [
        ({}, {}, "title ok / authors ok / year ok / venue ok / pages ok", {}),
        ({}, {"venue": None}, "title ok / authors ok / year ok / venue ? / pages ok", {"venue": ("missing_candidate", "Crossref から取得できず")}),
        ({"venue": " "[:0]}, {}, "title ok / authors ok / year ok / venue ? / pages ok", {"venue": ("missing_input", "入力に記載なし")}),
        ({"year": None, "authors": []}, {"year": None}, "title ok / authors ? / year ? / venue ok / pages ok", {"authors": ("missing_input", "入力に記載なし"), "year": ("missing_both", None)}),
        ({"year": 2021}, {}, "title ok / authors ok / year ok / venue ok / pages ok", {"year": ("near", "1年ずれ（オンライン公開／印刷年の差の可能性）")}),
        ({"venue": "Coast Stud"}, {}, "title ok / authors ok / year ok / venue ok / pages ok", {"venue": ("ok", "正式誌名・略誌名の差として許容")}),
        ({"venue": "Harbour Letters"}, {}, "title ok / authors ok / year ok / venue x / pages ok", {"venue": ("unverified", "論文自体は一致。掲載誌名だけ別表記の可能性")}),
        ({"volume": None, "issue": None, "page": None}, {}, "title ok / authors ok / year ok / venue ok / pages ?", {"pages": ("missing_input", "入力に記載なし")}),
        ({"volume": None, "issue": None, "page": None}, {"volume": None, "issue": None, "page": None}, "title ok / authors ok / year ok / venue ok / pages ?", {"pages": ("missing_both", None)}),
        ({"title": None}, {}, "title ? / authors ok / year ok / venue ok / pages ok", {"title": ("missing_input", "入力に記載なし")}),
    ]
    names = [c.split()[0] for c in KIND.split(", ")]
    side = lambda more: tuple((dict(zip(names, whole, strict=True)) | more)[n] for n in names)
    rows = [(i, side(r), side(c)) for i, (r, c, _, _) in enumerate(cases)]
    record = f"struct<{', '.join(':'.join(c.split()) for c in KIND.split(', '))}>"
    scored = score.score(spark.createDataFrame(rows, f"i long, r {record}, c {record}"))
    for row in scored.select("i", "summary", "field_diffs", "field_states").collect():
        _, _, summary, told = cases[row["i"]]
        assert row["summary"] == summary and row["field_states"] == dict(x.split(" ") for x in summary.split(" / "))
        for d in row["field_diffs"]:
            assert (d["state"], d["reason"]) == told.get(d["field"], ("ok", None)), (row["i"], d)


def test_equal_citations_are_searched_once(spark, monkeypatch):
    asked, block = [], collect.block
    monkeypatch.setattr(collect, "block", lambda refs, works, top: asked.append(refs.count()) or block(refs, works, top))
    works = spark.createDataFrame([(1, "Slow tides in narrow harbours"), (2, "Slow rivers")], "work_id long, title string")
    texts = ["Slow tides (2020). 10.1234/x", "Slow, rivers", "", None]
    refs = spark.createDataFrame([(i, texts[i % 4]) for i in range(200)], "ref_id long, input_text string")
    got = {tuple(r) for r in collect.staged_candidates(refs, works).collect()}
    assert asked[0] < 10
    assert got == {(i, *x, "raw") for i in range(200) for x in {0: [(1, 1), (2, 2)], 1: [(2, 1), (1, 2)]}.get(i % 4, [])}


def test_rows_without_doi_do_not_meet_in_one_task(spark):
    works = table(spark, work(1, "Slow tides", doi="10.1/A"))
    rows = spark.createDataFrame([(i, "10.1/a" if i % 10 == 0 else "10.1/none" if i % 10 == 1 else None) for i in range(1000)], "i long, doi string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        parts = collect.DoiTables(works).lookup(rows).select("i", "doi", "w.title", "doi_method", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted((r["i"], r["title"], r["doi_method"]) for r in parts) == [(i, "Slow tides" if i % 10 == 0 else None, "doi-crossref" if i % 10 < 2 else None) for i in range(1000)]
    tasks = [r["task"] for r in parts if r["doi"] is None]
    assert max(tasks.count(t) for t in set(tasks)) < 400


def test_field_states_reads_orders_once(spark):
    from biblens.plans import queries

    plan = queries.QUERIES["field_states"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") == 1


def test_long_lists_of_authors(spark):
    a = spark.createDataFrame([(["a", "b", "c", "d"],), (["a", "b"],), ([],)], "x array<string>").select(score.display_authors(F.col("x")).alias("s"))
    assert [r["s"] for r in a.collect()] == ["a, b, c, et al.", "a, b", None]


def test_references_of_one_partition_are_parsed_by_all_tasks(spark, monkeypatch):
    from biblens.plans import audit as plan

    class Seen(Exception):
        pass

    def first(df, name):
        raise Seen(name, df.rdd.getNumPartitions())

    works, refs = golden(spark)
    monkeypatch.setattr(plan, "write_table", first)
    with pytest.raises(Seen) as seen:
        audit(refs.coalesce(1), works)
    assert seen.value.args == ("parsed", 4)
