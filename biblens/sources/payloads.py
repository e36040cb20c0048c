"""Payloads of scholarly indexes to records (P14 to P23, S19, S23, S30). Each adapter is one select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblens.functions.text import normalize_author, nullif_blank
from biblens.schema import NOTICE_JSON, WORK_JSON

RECORD_COLUMNS = (
    "title", "authors", "year", "venue", "venue_aliases", "issns", "volume", "issue", "page", "article_number",
    "doi", "source", "source_id", "is_preprint", "aliases_resolved",
)
# Marks of a preprint's container, and update types that retract a work.
PREPRINT_MARKS = ("preprint", "arxiv")
RETRACTING = ("retraction", "withdrawal", "removal", "partial_retraction")


def json_rows(raw: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """Other columns and the fields of a JSON column; what can not be read is null."""
    others = [c for c in raw.columns if c != column]
    return raw.select(*others, F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("w")).select(*others, "w.*")


def works_json(raw: DataFrame, column: str = "json") -> DataFrame:
    return json_rows(raw, WORK_JSON, column)


def notices_json(raw: DataFrame, column: str = "json") -> DataFrame:
    """One row a notice target: (notice_doi, target_doi, update_type, source, label, updated)."""
    rows = json_rows(raw, NOTICE_JSON, column).select(F.col("DOI").alias("notice_doi"), F.explode("update-to").alias("u"))
    return rows.select("notice_doi", F.lower("u.DOI").alias("target_doi"), F.col("u.type").alias("update_type"), "u.source", "u.label", F.col("u.updated.date-time").alias("updated"))


def published_year(print_: Column, issued: Column, online: Column) -> Column:
    """The first of the three with date parts decides, even where its year is null."""
    has = lambda d: F.size(d["date-parts"]) > 0
    of = lambda d: F.try_element_at(F.try_element_at(d["date-parts"], F.lit(1)), F.lit(1))
    return F.when(has(print_), of(print_)).when(has(issued), of(issued)).when(has(online), of(online))


def page_article_number(page: Column) -> Column:
    return F.when(~F.contains(page, F.lit("-")), nullif_blank(page))


def _record(df: DataFrame, keep: list[str], **fields) -> DataFrame:
    empty = F.array().cast("array<string>")
    base = {c: F.lit(None).cast("string") for c in RECORD_COLUMNS}
    base |= {"authors": empty, "venue_aliases": empty, "issns": empty, "year": F.lit(None).cast("int"), "is_preprint": F.lit(False), "aliases_resolved": F.lit(False)}
    base |= fields
    return df.select(*keep, *[base[c].alias(c) for c in RECORD_COLUMNS])


def _keys(names: Column) -> Column:
    """Author keys of an array of names, by way of one joined string so that folding is one UDF call."""
    from biblens.operators.parse import author_keys

    return author_keys(names)


def work_records(works: DataFrame, keep: list[str] | None = None, source: str = "crossref") -> DataFrame:
    """Works with nested fields to records."""
    names = F.filter(F.transform("author", lambda a: F.coalesce(nullif_blank(a["family"]), nullif_blank(a["name"]))), lambda n: n.isNotNull())
    venue = F.try_element_at(F.col("container-title"), F.lit(1))
    low = F.lower(F.coalesce(venue, F.lit("")))
    marked = (F.col("type") == "posted-content") | F.contains(low, F.lit(PREPRINT_MARKS[0])) | F.contains(low, F.lit(PREPRINT_MARKS[1]))
    return _record(
        works, keep or [],
        title=F.try_element_at(F.col("title"), F.lit(1)), authors=F.coalesce(_keys(names), F.array().cast("array<string>")),
        year=published_year(F.col("published-print"), F.col("issued"), F.col("published-online")).cast("int"), venue=venue,
        issns=F.filter(F.coalesce("ISSN", F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False))),
        volume=F.col("volume"), issue=F.col("issue"), page=F.col("page"), article_number=page_article_number(F.col("page")),
        doi=F.lower("DOI"), source=F.lit(source), is_preprint=F.coalesce(marked, F.lit(False)),
    )


def pubmed_records(hits: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """PubMed hits to records; both forms of the journal are aliases."""
    return _record(
        hits, keep or [],
        title=F.col("title"), authors=_keys(F.col("authors")), year=F.col("year").cast("int"), venue=nullif_blank(F.col("journal")), aliases_resolved=F.lit(True),
        venue_aliases=F.array_distinct(F.array_compact(F.array(nullif_blank(F.col("journal")), nullif_blank(F.col("journal_full"))))),
        volume=F.col("volume"), issue=F.col("issue"), page=F.col("pages"), article_number=page_article_number(F.col("pages")),
        doi=F.lower("doi"), source=F.lit("pubmed"), source_id=F.col("pmid"),
    )


def arxiv_records(hits: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """arXiv entries to records: always preprints; a date that can not be read gives no year."""
    return _record(
        hits, keep or [],
        title=F.col("title"), authors=_keys(F.col("authors")), year=F.year(F.try_to_timestamp("published")).cast("int"),
        venue=F.coalesce(nullif_blank(F.col("journal_ref")), F.lit("arXiv")), doi=F.lower("doi"), source=F.lit("arxiv"),
        source_id=F.col("arxiv_id"), is_preprint=F.lit(True),
    )


def arxiv_entries(xml: DataFrame, column: str = "xml") -> DataFrame:
    """Atom entries to (arxiv_id, title, authors, published, updated, doi, journal_ref, categories, abstract).
    Entries titled "Error" and empty ones are dropped."""
    one = lambda p: nullif_blank(F.regexp_replace(F.xpath_string(F.col(column), F.lit(p)), r"\s+", " "))
    tag = lambda n: f'//*[local-name()="entry"]/*[local-name()="{n}"]'
    ids = F.regexp_extract(one(tag("id")), r"abs/(.+)$", 1)
    rows = xml.select(
        ids.alias("arxiv_id"), one(tag("title")).alias("title"),
        F.xpath(F.col(column), F.lit(tag("author") + '/*[local-name()="name"]/text()')).alias("authors"),
        one(tag("published")).alias("published"), one(tag("updated")).alias("updated"), one(tag("doi")).alias("doi"), one(tag("journal_ref")).alias("journal_ref"),
        F.xpath(F.col(column), F.lit(tag("category") + "/@term")).alias("categories"), one(tag("summary")).alias("abstract"),
    )
    return rows.filter("title is not null and title <> 'Error'")


def journal_aliases(xml: DataFrame, keep: list[str], column: str = "xml") -> DataFrame:
    """Titles of a catalogue entry without their final points, in sorted order."""
    all_of = lambda n: F.xpath(F.col(column), F.lit(f'//*[local-name()="{n}"]//text()'))
    names = F.concat(all_of("TitleMain"), all_of("MedlineTA"), all_of("TitleAlternate"))
    tidy = F.transform(names, lambda n: F.regexp_replace(F.trim(n), r"\.$", ""))
    return xml.select(*keep, F.array_sort(F.array_distinct(F.filter(tidy, lambda n: n != ""))).alias("aliases"))


def metadata_works(meta: DataFrame) -> DataFrame:
    """DOI metadata (doi, title, authors, year, container_title, volume, issue, page) as works."""
    authors = F.transform("authors", lambda a: F.struct(a["family"].alias("family"), a["given"].alias("name")))
    parts = F.struct(F.array(F.array(F.col("year").cast("int"))).alias("date-parts"))
    none = F.lit(None).cast("struct<`date-parts`:array<array<int>>>")
    return meta.select(
        F.col("doi").alias("DOI"), F.array("title").alias("title"), authors.alias("author"), F.lit(None).cast("string").alias("type"), parts.alias("issued"),
        none.alias("published-print"), none.alias("published-online"), F.array("container_title").alias("container-title"),
        F.array().cast("array<string>").alias("ISSN"), "volume", "issue", "page",
    )


def datacite_metadata(rows: DataFrame) -> DataFrame:
    """(doi, title, creators "Last, First", publicationYear, publisher) as DOI metadata."""
    person = lambda n: F.struct(F.trim(F.substring_index(n, ",", 1)).alias("family"), F.trim(F.try_element_at(F.split(n, ",", 2), F.lit(2))).alias("given"))
    none = F.lit(None).cast("string")
    return rows.select(
        "doi", "title", F.transform("creators", person).alias("authors"), F.col("publicationYear").cast("int").alias("year"),
        F.col("publisher").alias("container_title"), none.alias("volume"), none.alias("issue"), none.alias("page"),
    )


def merged(a: str, b: str) -> dict[str, Column]:
    """Fields of two records, the first's where it has one; aliases in order, preprint if both, resolved if either."""
    text = lambda f: F.coalesce(nullif_blank(F.col(f"{a}.{f}")), F.col(f"{b}.{f}"))
    many = lambda f: F.when(F.size(f"{a}.{f}") > 0, F.col(f"{a}.{f}")).otherwise(F.col(f"{b}.{f}"))
    out = {f: text(f) for f in ("title", "venue", "volume", "issue", "page", "article_number", "doi", "source", "source_id")}
    out |= {f: many(f) for f in ("authors", "issns")}
    out["year"] = F.coalesce(F.when(F.col(f"{a}.year") != 0, F.col(f"{a}.year")), F.col(f"{b}.year"))
    out["venue_aliases"] = F.array_union(f"{a}.venue_aliases", f"{b}.venue_aliases")
    out["is_preprint"] = F.col(f"{a}.is_preprint") & F.col(f"{b}.is_preprint")
    out["aliases_resolved"] = F.col(f"{a}.aliases_resolved") | F.col(f"{b}.aliases_resolved")
    return out


def csl_metadata(raw: DataFrame, column: str = "json") -> DataFrame:
    """CSL-JSON to DOI metadata beside the other columns, of which ``doi`` is one.

    Values whose type changes from agency to agency (a title as text or as an array of texts, parts of dates as numbers or
    texts) are read from a variant. What can not be read is null; a row that is no JSON object has only nulls.
    """
    v = F.try_parse_json(column)
    one = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    is_array = lambda path: F.startswith(F.coalesce(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), F.lit("")), F.lit("ARRAY"))
    either = lambda path: F.when(is_array(path), one(f"{path}[0]")).otherwise(one(path))
    people = F.coalesce(one("$.author", "array<struct<family:string,given:string,literal:string>>"), F.array().cast("array<struct<family:string,given:string,literal:string>>"))
    person = lambda a: F.struct(F.coalesce(a["family"], F.lit("")).alias("family"), F.coalesce(a["given"], a["literal"], F.lit("")).alias("given"))
    year = one('$.issued["date-parts"][0][0]').try_cast("int")
    rows = raw.withColumn("_v", v)
    return rows.select(
        *[c for c in raw.columns if c != column], either("$.title").alias("title"), F.transform(people, person).alias("authors"), year.alias("year"),
        either('$["container-title"]').alias("container_title"), one("$.volume").alias("volume"), F.coalesce(nullif_blank(one("$.issue")), one("$.number")).alias("issue"), one("$.page").alias("page"),
    )


def csl_records(raw: DataFrame, column: str = "json") -> DataFrame:
    """CSL-JSON rows (doi, json) to records, as a table that content negotiation answers from. No work of theirs is a preprint by its type."""
    return work_records(metadata_works(csl_metadata(raw.select("doi", column), column).filter("title is not null")), source="crossref")


SUMMARY = (
    "struct<title:string,authors:array<struct<name:string>>,pubdate:string,sortpubdate:string,source:string,fulljournalname:string,"
    "volume:string,issue:string,pages:string,articleids:array<struct<idtype:string,value:string>>>"
)
#: Hits of a search for which a missing DOI is looked up in the article's XML.
FETCHED = 3


def pubmed_details(found: DataFrame, summaries: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """The hits of searches with their details, for ``pubmed_records``. ``found`` is (ref_id, pmid, place) with places from 1.

    ``summaries`` is (pmid, json). The year is the first of pubdate, or of sortpubdate where that is empty; the DOI is the first
    article id of that type. Where it is missing, the first ``FETCHED`` hits of a search look into ``articles`` (pmid, xml).
    A hit without a summary keeps its id, with empty fields.
    """
    read = json_rows(summaries.select("pmid", "json"), SUMMARY)
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    said = F.coalesce(some("pubdate"), some("sortpubdate"), F.lit(""))
    names = F.filter(F.transform("authors", lambda a: F.trim(F.coalesce(a["name"], F.lit("")))), lambda n: n != "")
    ids = F.filter("articleids", lambda a: F.coalesce(F.lower(a["idtype"]) == "doi", F.lit(False)))
    told = read.select(
        "pmid", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), nullif_blank(F.regexp_extract(said, r"\b((?:19|20)\d{2})\b", 1)).cast("int").alias("year"),
        some("source").alias("journal"), some("fulljournalname").alias("journal_full"), some("volume").alias("volume"), some("issue").alias("issue"), some("pages").alias("pages"), F.try_element_at(ids, F.lit(1))["value"].alias("doi"),
    )
    hits = found.join(told.dropDuplicates(["pmid"]), "pmid", "left").withColumns({"title": F.coalesce("title", F.lit("")), "authors": F.coalesce("authors", F.array().cast("array<string>"))})
    if articles is None:
        return hits
    lower = "translate(@IdType, 'DOI', 'doi') = 'doi'"
    inner = F.trim(F.xpath_string("xml", F.lit(f"//ArticleIdList/ArticleId[{lower}]")))
    open_ = hits.filter(f"coalesce(doi, '') = '' and place <= {FETCHED}").select("pmid").distinct()
    own = open_.join(articles.dropDuplicates(["pmid"]), "pmid").select("pmid", inner.alias("_doi"))
    looked = (F.coalesce("doi", F.lit("")) == "") & (F.col("place") <= FETCHED)
    return hits.join(own, "pmid", "left").withColumn("doi", F.when(looked, F.coalesce("_doi", "doi")).otherwise(F.col("doi"))).drop("_doi")
