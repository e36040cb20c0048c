"""The audit: references and authority tables to one result a reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblens.operators import collect as C
from biblens.operators import decide as D
from biblens.operators import retrieve as R
from biblens.operators import score as S
from biblens.operators.index import WordIndex, citation_words, title_words
from biblens.operators.parse import parse
from biblens.runtime import scratch, ship, write_table
from biblens.sources.payloads import RECORD_COLUMNS

REFERENCE_FIELDS = ("title", "authors", "year", "venue", "volume", "issue", "page", "article_number", "doi")
NO_DETAILS = "array<struct<notice_doi:string,update_type:string,source:string,updated:string,label:string>>"


def _record(prefix: str = ""):
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in RECORD_COLUMNS])


def citation_index(works: DataFrame, path: str | None = None) -> WordIndex:
    """The index in which whole citations are looked for; with ``path`` it stays there, for audits to come."""
    return WordIndex.build(works.select("work_id", citation_words(works).alias("words")), path=path)


def candidates(parsed: DataFrame, works: DataFrame, top: int = 5, sources: dict[str, DataFrame] | None = None, dois: C.DoiTables | None = None, index: WordIndex | None = None) -> DataFrame:
    """(ref_id, r, c, ordinal, method): the work that a DOI names, else works by the words of the whole citation, then those
    of the other sources in their fixed order. A DOI that names nothing has a row without c, which tells its method.

    ``sources`` may hold records of ``pubmed`` and ``arxiv`` (source_id is their id) and (title, doi) of ``jalc``.
    References and works are brought to normal form here, once for each, not for each pair.
    """
    dois = dois or C.DoiTables(works)
    r = F.struct(*[F.col(f).alias(f) for f in REFERENCE_FIELDS]).alias("r")
    refs = S.with_normal(parsed.filter(~F.col("is_website")).select("ref_id", r), "r")
    named = dois.lookup(parsed.filter("not is_website and doi is not null").select("ref_id", "doi"))
    named = named.select("ref_id", F.col("w").withField("source", F.lit("doi")).withField("source_id", F.col("doi")).alias("c"), F.lit(1).alias("ordinal"), F.col("doi_method").alias("method"))
    open_ = parsed.filter("not is_website and doi is null")
    index = index or citation_index(works)
    ranked = index.search(open_.select("ref_id", title_words(F.col("input_text")).alias("words")), top)
    shown = S.with_normal(works.select("work_id", _record().alias("c")), "c")
    mine = ranked.join(shown, "work_id").select("ref_id", "c", F.col("rank").alias("ordinal"), F.lit("bibliographic").alias("method"))
    parts, sources = {"crossref": mine}, sources or {}
    if "pubmed" in sources:
        parts["pubmed"] = C.pubmed_candidates(open_.select("ref_id", "input_text", "title"), sources["pubmed"])
    if "arxiv" in sources:
        parts["arxiv"] = C.arxiv_candidates(open_.select("ref_id", "arxiv_id", "title", "authors"), sources["arxiv"], dois, index)
    if "jalc" in sources:
        parts["jalc"] = C.japanese_candidates(open_.select("ref_id", "title"), C.japanese_hits(open_.select("ref_id", "title"), sources["jalc"]), dois)
    found = S.with_normal(named, "c").unionByName(R.union_sources({k: S.with_normal(v.select("ref_id", "c", "ordinal", "method"), "c") for k, v in parts.items()}))
    return found.join(refs, "ref_id").select("ref_id", "r", "c", "ordinal", "method")


def audit(
    refs: DataFrame, works: DataFrame, notices: DataFrame | None = None, aliases: DataFrame | None = None, sequence: bool = True, top: int = 5,
    sources: dict[str, DataFrame] | None = None, gaps: DataFrame | None = None, details: bool = True, debug: bool = False,
    dois: C.DoiTables | None = None, index: WordIndex | None = None, columns: Sequence[str] | None = None,
) -> DataFrame:
    """One result a reference (ref_id, input_text). ``works`` holds work_id, a record's columns and maybe the agency.

    ``sources`` are the tables of further sources (see ``candidates``), ``gaps`` the sources that were skipped or
    failed, as (ref_id, source, error). ``dois`` tells where DOIs are looked up, if not in ``works``; ``index`` is a kept
    ``citation_index`` of the works. Without ``details`` only what decides is computed, with ``columns`` only these
    columns of the result. A function of frames, so a stream can call it on each micro-batch; its result is one written
    table, and what it wrote before is deleted.

    References are read once. What is said of one follows from its text (and its gaps), so each text is audited once,
    however many references have it.
    """
    ship(refs.sparkSession)
    with scratch(refs.sparkSession) as keep:
        given, texts = C.equal_texts(refs)
        told = _audit(texts, works, notices, aliases, sequence, top, sources, details, debug, dois or C.DoiTables(works), index)
        own = given.select(*[c for c in given.columns if c == "ref_id" or c not in told.columns], F.col("input_text").alias("_text"))
        results = told.drop("ref_id").join(own, F.col("input_text").eqNullSafe(F.col("_text"))).drop("_text")
        if gaps is not None:
            results = D.with_gaps(D.source_gaps(results.drop(*D.GAPS), gaps))
        order = [c for c in (*given.columns, *told.columns) if columns is None or c in columns]
        return keep(results.select(*dict.fromkeys(order)), "results")


def _audit(texts, works, notices, aliases, sequence, top, sources, details, debug, dois, index) -> DataFrame:
    parsed, _ = write_table(parse(texts).withColumn("ref_id", F.monotonically_increasing_id()), "parsed")
    every = D.dedup_candidates(candidates(parsed, works, top, sources, dois, index))
    columns = ["ref_id", "r", "c", "ordinal", "method"]
    completed = bool(sources and "pubmed" in sources)
    # what completes a record may lower its total, so then every pair is scored
    scored = S.decide_pairs(every if completed else S.contenders(every), sequence)
    if aliases is not None:
        # only pairs whose candidate got new names are scored again
        first, _ = write_table(scored.withColumn("gate", S.alias_gate()), "scored")
        named = R.with_aliases(first.filter("gate").select("ref_id", "r", "ordinal", "method", "gate", "c.*"), aliases)
        again = S.decide_pairs(named.select("ref_id", "r", F.struct(*RECORD_COLUMNS, "n").alias("c"), "ordinal", "method"), sequence)
        kept = first.filter("not gate")
        scored = kept.drop("gate").unionByName(again.select(*[c for c in kept.columns if c != "gate"]))
    if completed:
        # accepted PubMed hits are completed by the work that their DOI names, and scored again
        split, _ = write_table(scored, "decided")
        hit = F.coalesce((F.col("decision") == "accept") & F.startswith("method", F.lit("pubmed")) & F.col("c.doi").isNotNull(), F.lit(False))
        again = S.decide_pairs(S.with_normal(C.enriched(split.filter(hit).select(*columns), dois), "c").select(*columns), sequence)
        scored = split.filter(~hit).unionByName(again.select(*split.columns))
    ranked, _ = write_table(D.listed(D.rank(scored)), "ranked")
    pairs = ranked.filter("c is not null")
    lost = ranked.filter("c is null").select("ref_id", F.col("method").alias("doi_method"))
    results = D.decide(parsed.join(lost, "ref_id", "left"), pairs)
    if not details:
        return results
    results = D.with_details(results.withColumns({c: F.lit(None).cast(t) for c, t in D.GAPS.items()}), S.with_diffs(pairs), debug=debug)
    if sources and "arxiv" in sources:
        results = with_arxiv(results, sources["arxiv"])
    if notices is None:
        return results.withColumns({"retracted": F.lit(False), "retraction_details": F.lit(None).cast(NO_DETAILS), "retraction_checked": F.lit(False)})
    return D.with_retractions(results, notices)


def with_arxiv(results: DataFrame, entries: DataFrame) -> DataFrame:
    """results with the entry's DOI and journal reference beside the arXiv id that was named or found, for references without DOI."""
    asked = results.filter("doi is null and not is_website").select("ref_id", "arxiv_id", "title", "authors")
    own = entries.select("source_id", F.col("doi").alias("arxiv_doi"), F.when(F.col("venue") != "arXiv", F.col("venue")).alias("journal_ref"))
    hits = C.arxiv_hits(asked, entries).select("ref_id", "source_id").join(own, "source_id")
    return results.join(hits, "ref_id", "left").withColumn("arxiv_id", F.coalesce("source_id", "arxiv_id")).drop("source_id")
