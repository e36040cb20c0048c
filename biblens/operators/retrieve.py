"""Candidates for references: joins by identifier, and blocking by title words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblens.functions.text import normalize_text
from biblens.operators.index import WordIndex, title_words

#: Postings that the first round of a search by title reads, beside those of the rarest word.
FIRST = 200
#: The order in which sources are collected.
SOURCES = ("crossref", "pubmed", "arxiv", "jalc")


def by_doi(refs: DataFrame, works: DataFrame) -> DataFrame:
    """References with a DOI and the work it names, if any (left join; DOIs compared in lower case)."""
    w = works.withColumn("_key", F.lower("doi"))
    return refs.filter("doi is not null").withColumn("_key", F.lower("doi")).join(w.drop("doi"), "_key", "left").drop("_key")


def agency_of(refs: DataFrame, agencies: DataFrame) -> DataFrame:
    """Registration agency by DOI prefix (prefix, agency); a left join that Spark broadcasts if it is small."""
    return refs.withColumn("prefix", F.substring_index("doi", "/", 1)).join(agencies, "prefix", "left")


def word_sets(rows: DataFrame, key: str, title: str = "title") -> DataFrame:
    """(key, words): the distinct words of each row's title, sorted; rows without any are left out."""
    return rows.select(key, title_words(F.col(title)).alias("words")).filter(F.size("words") > 0)


def block(refs: DataFrame, works: DataFrame, top: int = 5) -> DataFrame:
    """(ref_id, work_id, hits, weight, rank): the top works of each reference by shared title words.

    Words weigh ln(1 + N / df), in whole thousandths; ties go to the smaller work_id. The result is that of a
    join on every word; how it does without one, ``WordIndex`` tells.
    """
    return WordIndex.build(word_sets(works, "work_id"), power=1).search(word_sets(refs, "ref_id"), top, FIRST)


#: More than any source's candidates of a reference.
PLACES = 1000


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Candidates (ref_id, c, ordinal, method) of all sources, numbered on in the fixed order of sources."""
    out = None
    for place, name in enumerate(SOURCES):
        if name in parts:
            df = parts[name].withColumn("ordinal", (F.lit(place * PLACES) + F.col("ordinal")).cast("int"))
            out = df if out is None else out.unionByName(df)
    return out


def first_stage(rows: DataFrame, key: str, stage: str = "stage") -> DataFrame:
    """Candidates of each key's first non-empty stage of a fallback chain."""
    w = Window.partitionBy(key)
    return rows.withColumn("_least", F.min(stage).over(w)).filter(F.col(stage) == F.col("_least")).drop("_least")


def with_aliases(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias names of the venue, where the gate is open: by the first two ISSNs in sorted order (trimmed, distinct, not
    empty), or by the normalised title where there is none.

    ``aliases`` is (issn, title_norm, aliases); ``gate`` a boolean column of ``candidates``. The first of
    these with names decides; rows of one key are taken together, in sorted order. Joins are left joins
    that Spark broadcasts if the alias table is small.
    """
    names = lambda key, out: aliases.filter(f"{key} is not null and size(aliases) > 0").groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias(out))
    issns = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("issns", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")))
    keyed = candidates.withColumns({f"_issn{i}": F.when(F.col("gate"), F.try_element_at(issns, F.lit(i))) for i in (1, 2)} | {"_title": F.when(F.col("gate") & (F.size(issns) == 0), normalize_text(F.col("venue")))})
    for i in (1, 2):
        keyed = keyed.join(names("issn", f"_a{i}").withColumnRenamed("issn", f"_issn{i}"), f"_issn{i}", "left")
    keyed = keyed.join(names("title_norm", "_a3").withColumnRenamed("title_norm", "_title"), "_title", "left")
    none = F.array().cast("array<string>")
    more = F.array_union(F.coalesce("venue_aliases", none), F.coalesce("_a1", "_a2", "_a3", none))
    return keyed.withColumns({"venue_aliases": more, "aliases_resolved": F.col("gate") | F.coalesce("aliases_resolved", F.lit(False))}).drop("_issn1", "_issn2", "_title", "_a1", "_a2", "_a3")
