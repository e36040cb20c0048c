"""Ranking of candidates, the status of references, and retraction notices."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblens.functions.text import nullif_blank, query_quote
from biblens.operators.retrieve import SOURCES
from biblens.sources.payloads import RETRACTING

def decision_rank(c: str = "decision") -> Column:
    return F.when(F.col(c) == "accept", 2).when(F.col(c) == "suggest", 1).otherwise(0)


def rank(scored: DataFrame, key: str = "ref_id", ordinal: str = "ordinal", preprint: str = "c.is_preprint") -> DataFrame:
    """Rank in each reference: decision, total, published before what its record calls a preprint, then collection order."""
    order = Window.partitionBy(key).orderBy(F.desc(decision_rank()), F.desc("total"), F.coalesce(preprint, F.lit(False)).cast("int"), ordinal)
    return scored.withColumn("rank", F.row_number().over(order))


def dedup_candidates(rows: DataFrame, key: str = "ref_id", ordinal: str = "ordinal") -> DataFrame:
    """The first candidate of each (doi, title, source_id); nulls count as equal."""
    w = Window.partitionBy(key, "c.doi", "c.title", "c.source_id").orderBy(ordinal)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def listed(ranked: DataFrame, key: str = "ref_id", keep: int = 3) -> DataFrame:
    """The ranked pairs that results tell of: the first of all, and of references without an accepted pair the first ``keep``."""
    accepted = F.max(F.col("decision") == "accept").over(Window.partitionBy(key))
    return ranked.withColumn("_any", accepted).filter((F.col("rank") <= keep) & ((F.col("rank") == 1) | ~F.col("_any"))).drop("_any")


#: What tells of sources that were not asked.
GAPS = {"unchecked_sources": "array<string>", "source_errors": "map<string,string>"}


def with_gaps(results: DataFrame) -> DataFrame:
    """Decided results with unchecked_sources or source_errors: a search without an accepted candidate is partial, others forget them."""
    some = reduce(or_, [F.coalesce(F.size(c) > 0, F.lit(False)) for c in GAPS])
    partial = some & ~F.col("found") & F.col("doi").isNull()
    return results.withColumns({"verification_status": F.when(partial, "partial").otherwise("complete")} | {c: F.when(partial & (F.size(c) > 0), F.col(c)) for c in GAPS})


def decide(refs: DataFrame, ranked: DataFrame, key: str = "ref_id") -> DataFrame:
    """refs with status, note, found, method and verification_status.

    website before everything; with a DOI the work it names decides (found if accepted, else likely
    wrong, doi_not_resolved if it names none); without, the first accepted is found, else the first suggested
    makes it likely wrong, else it is not found. The note of a wrong one is its candidate's own, before a
    warning of the year. Only the columns that decide come from ``ranked``. Where refs have
    unchecked_sources or source_errors, a search without an accepted candidate is partial.
    """
    first = ranked.filter("rank = 1").select(key, F.col("decision").alias("_d"), F.col("note").alias("_own"), F.col("method").alias("_method"), (F.col("s_year") == 0.7).alias("_late"))
    joined = refs.join(first, key, "left")
    d, by_doi, site = F.col("_d"), F.col("doi").isNotNull(), F.col("is_website")
    none = d.isNull()
    wrong = (by_doi & ~none & (d != "accept")) | (~by_doi & (d == "suggest"))
    accepted = F.coalesce(d == "accept", F.lit(False))
    status = F.when(site, "website").when(accepted, "found").when(wrong, "likely_wrong").otherwise("not_found")
    late = F.when(F.col("_late"), F.lit("year_warning"))
    note = (
        F.when(site, "website_reference")
        .when(by_doi & none, "doi_not_resolved")
        .when(accepted, late)
        .when(wrong & by_doi, F.coalesce("_own", late, F.lit("candidate_mismatch")))
        .when(wrong, F.coalesce("_own", F.lit("candidate_mismatch")))
        .otherwise("no_match")
    )
    method = F.when(site, "website").when(accepted | wrong, F.col("_method")).when(by_doi, F.coalesce("doi_method", F.lit("doi-crossref")) if "doi_method" in refs.columns else F.lit("doi-crossref")).otherwise("bibliographic")
    out = joined.withColumns({"status": status, "note": note, "found": site | accepted, "method": method, "verification_status": F.lit("complete")})
    if "unchecked_sources" in refs.columns:
        out = with_gaps(out)
    return out.drop("_d", "_own", "_method", "_late", "doi_method")


#: The payload of a candidate.
PAYLOAD = ("title", "doi", "source", "method", "score", "decision", "field_summary", "field_states", "field_diffs", "signals", "year", "container", "page", "volume", "issue")


def payload() -> Column:
    own = {"field_states": "field_states", "method": "method", "score": "total", "decision": "decision", "field_summary": "summary", "field_diffs": "field_diffs", "signals": "signals"}
    own |= {f: f"c.{f}" for f in ("title", "doi", "source", "year", "page", "volume", "issue")} | {"container": "c.venue"}
    return F.struct(*[F.col(own[f]).alias(f) for f in PAYLOAD])


def with_details(results: DataFrame, scored: DataFrame, key: str = "ref_id", keep: int = 3, debug: bool = False) -> DataFrame:
    """results with what reports show: best candidate, candidates, suggestions, authors.

    ``scored`` are ranked pairs with field_diffs. A likely wrong reference without DOI lists its first
    ``keep`` suggested candidates; with ``debug`` one that is not found lists the first of all.
    """
    near = scored.filter(F.col("rank") <= keep).select(key, "rank", "decision", payload().alias("p"), F.slice("c.authors", 1, 5).alias("names"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "decision", "p")), lambda x, y: x["rank"] - y["rank"])
    top = near.groupBy(key).agg(F.min_by(F.struct("p", "names"), "rank").alias("_best"), listed.alias("_list"))
    joined = results.join(top, key, "left")
    known = F.col("status").isin("found", "likely_wrong")
    wrong = (F.col("status") == "likely_wrong") & F.col("doi").isNull()
    suggested = F.transform(F.filter("_list", lambda x: x["decision"] == "suggest"), lambda x: x["p"])
    shown = F.when(wrong, suggested)
    if debug:
        shown = shown.when((F.col("status") == "not_found") & F.col("doi").isNull(), F.transform("_list", lambda x: x["p"]))
    shown = F.when(F.size(shown) > 0, shown)
    titled = F.transform(F.filter(shown, lambda p: F.coalesce(p["title"] != "", F.lit(False))), lambda p: F.concat(p["title"], F.lit(" ("), F.coalesce(nullif_blank(p["doi"]), F.lit("DOIなし")), F.lit(")")))
    lost = F.array(F.concat(F.lit("DOI解決失敗: "), F.col("doi")), F.concat(F.lit("doi.orgで確認: https://doi.org/"), F.col("doi")))
    search = F.array(F.concat(F.lit('タイトル候補でウェブ検索: "'), F.col("title"), F.lit('"')), F.concat(F.lit("Google検索: https://www.google.com/search?q="), query_quote(F.col("title"))))
    texts = (
        F.when(F.col("note") == "doi_not_resolved", lost)
        .when((F.col("status") == "not_found") & F.coalesce(F.col("title") != "", F.lit(False)), search)
        .when(wrong & (F.size(titled) > 0), titled)
    )
    some = lambda a: F.when(F.size(a) > 0, a)
    best = F.when(known, F.col("_best.p"))
    return joined.withColumns(
        {
            "matched_doi": F.when(known, F.col("_best.p.doi")).otherwise(F.when(F.col("note") == "doi_not_resolved", F.col("doi"))),
            "matched_title": F.when(known, F.col("_best.p.title")),
            "matched_authors": F.when(known, some(F.col("_best.names"))),
            "input_authors": some(F.col("authors")),
            "best_candidate": best,
            "comparison_summary": F.when(known, F.col("_best.p.field_summary")),
            "field_signals": F.when(known, F.col("_best.p.field_states")),
            "field_diffs": F.when(known, F.col("_best.p.field_diffs")),
            "candidates": shown,
            "suggestions": texts,
        }
    ).drop("_best", "_list")


def source_gaps(refs: DataFrame, sources: DataFrame, key: str = "ref_id") -> DataFrame:
    """refs with unchecked_sources and source_errors from rows (ref_id, source, error): a null error says that the source was skipped."""
    order = F.array(*[F.lit(s) for s in SOURCES])
    placed = lambda a: F.array_sort(a, lambda x, y: (F.array_position(order, x) - F.array_position(order, y)).cast("int"))
    skipped = F.collect_set(F.when(F.col("error").isNull(), F.col("source")))
    failed = F.collect_set(F.when(F.col("error").isNotNull(), F.struct("source", "error")))
    told = sources.groupBy(key, "source").agg(F.max("error").alias("error")).groupBy(key).agg(placed(skipped).cast("array<string>").alias("unchecked_sources"), F.map_from_entries(failed).alias("source_errors"))
    return refs.join(told, key, "left")


def retractions(notices: DataFrame) -> DataFrame:
    """(target_doi, details): notices that retract, each (notice, type in any case) once, in order of time."""
    kept = notices.filter(F.lower("update_type").isin(*RETRACTING)).withColumn("target_doi", F.lower("target_doi"))
    once = Window.partitionBy("target_doi", "notice_doi", F.lower("update_type")).orderBy("updated", "update_type", "label")
    kept = kept.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return kept.groupBy("target_doi").agg(F.array_sort(F.collect_list(F.struct("notice_doi", "update_type", "source", "updated", "label"))).alias("retraction_details"))


def with_retractions(results: DataFrame, notices: DataFrame, doi: str = "matched_doi") -> DataFrame:
    """Results with retracted, retraction_details, and whether there was anything to look up."""
    found = retractions(notices)
    joined = results.join(found, F.lower(results[doi]) == found["target_doi"], "left").drop("target_doi")
    looked = F.col(doi).isNotNull() & F.col("status").isin("found", "likely_wrong")
    details = F.when(looked, F.col("retraction_details"))
    return joined.withColumns({"retracted": looked & (F.coalesce(F.size(details), F.lit(0)) > 0), "retraction_details": details, "retraction_checked": looked})
