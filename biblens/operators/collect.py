"""Candidates that need more than one lookup: staged searches, published versions, enriched records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblens.functions.text import contains_japanese, normalize_arxiv, normalize_japanese_query, normalize_text, nullif_blank, squeeze, strip_version
from biblens.operators.index import PhraseIndex, WordIndex, citation_words, phrase_words, title_words
from biblens.operators.retrieve import agency_of, block, first_stage
from biblens.runtime import spread, write_table
from biblens.sources.payloads import RECORD_COLUMNS, merged

# Journals looked for first to last, and the words of a title that a search keeps.
JOURNALS = (r"BMC\s+\w+", r"J\s+Pediatr", "JAMA", "Lancet", r"N\s+Engl\s+J\s+Med")
TITLE_WORDS = (
    "systematic", "review", "meta-analysis", "randomized", "controlled", "trial", "trials", "caffeine", "therapy", "treatment",
    "outcomes", "timing", "initiation", "early", "late", "renal", "replacement", "kidney", "injury", "acute", "birth", "weight",
    "infants", "infant", "neonatal", "pediatric", "association", "trends", "use", "clinical", "very", "low",
)
STAGES = ("raw", "cleaned", "simplified", "key_terms")


def equal_texts(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refs as a written table, so that they are read once, and their distinct texts, dealt over all tasks."""
    given, _ = write_table(refs, "given")
    return given, spread(given.select("input_text"), "input_text").distinct()


def _plain(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"[&;,.()\[\]]", " "))


def key_terms(c: Column) -> Column:
    """The first year, three capitalised words before the first point (of 50 characters, if there is none),
    the first journal of the list, and eight title words after that point, each once in any case."""
    dotted = F.contains(c, F.lit("."))
    head = F.when(dotted, F.substring_index(c, ".", 1)).otherwise(F.substring(c, 1, 50))
    tail = F.when(dotted, F.regexp_replace(c, r"(?s)\A[^.]*\.", "")).otherwise(c)
    names = F.slice(F.regexp_extract_all(head, F.lit(r"(?U)\b[A-Z][a-z]+\b"), F.lit(0)), 1, 3)
    journal = F.coalesce(*[nullif_blank(F.regexp_extract(c, rf"(?iU)\b{j}", 0)) for j in JOURNALS])
    words = F.regexp_extract_all(tail, F.lit(rf"(?iU)\b({'|'.join(TITLE_WORDS)})\b"), F.lit(0))
    low = F.transform(words, F.lower)
    once = F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)
    year = F.regexp_extract(c, r"(?U)\b(?:19|20)\d{2}\b", 0)
    return F.concat_ws(" ", nullif_blank(year), names, journal, F.slice(once, 1, 8))


def search_stages(refs: DataFrame, text: str = "input_text") -> DataFrame:
    """``refs`` with the four forms in which a citation is searched, each less exact than the one before."""
    c = F.coalesce(F.col(text), F.lit(""))
    bare = c
    for pattern in (r"(?U)\b10\.\d{4,9}/\S+", r"(?U)\b\d+\(\d+\):\d+-\d+", r"(?U)\b\d+:\d+"):
        bare = F.regexp_replace(bare, pattern, "")
    return refs.withColumns({"raw": c, "cleaned": _plain(c), "simplified": _plain(bare), "key_terms": key_terms(c)})


def staged_candidates(refs: DataFrame, works: DataFrame, top: int = 5) -> DataFrame:
    """(ref_id, work_id, rank, stage) of the first stage whose search finds works.

    One blocking join serves all stages: a text becomes a row for each distinct form. Equal texts are brought to forms,
    searched and cut to their first stage once; references get the result at the end.
    """
    mine = refs.filter("input_text <> ''").select("ref_id", "input_text", F.unhex(F.md5("input_text")).alias("key"))
    forms = search_stages(spread(mine.select("key", "input_text"), "key").dropDuplicates(["key"]))
    stage = lambda s: F.array_position(F.array(*STAGES), s) - 1
    each = forms.select("key", F.explode(F.array_distinct(F.array(*[F.struct(stage(F.col(s)).alias("stage"), F.col(s).alias("title")) for s in STAGES]))).alias("f"))
    asked = each.filter("f.title <> ''").select(F.struct("key", "f.stage").alias("ref_id"), "f.title")
    found = block(asked, works, top)
    first = first_stage(found.select("ref_id.key", "ref_id.stage", "work_id", "rank"), "key")
    told = first.select("key", "work_id", "rank", F.element_at(F.array(*map(F.lit, STAGES)), F.col("stage").cast("int") + 1).alias("stage"))
    return mine.select("ref_id", "key").join(told, "key").drop("key")


def _record(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}.{c}").alias(c) for c in RECORD_COLUMNS])


#: Keys over which rows without DOI are dealt when DOIs are looked up.
NO_DOI = 4096


@dataclass
class DoiTables:
    """Where DOIs are looked up: records of Crossref and, by way of ``agencies`` (prefix, agency), those of DataCite and
    those that content negotiation gives. Without ``agencies`` all works of Crossref's table are found, under the agency
    that its column ``agency`` names, if it has one."""

    crossref: DataFrame
    agencies: DataFrame | None = None
    datacite: DataFrame | None = None
    negotiated: DataFrame | None = None
    strict: bool = True

    def lookup(self, rows: DataFrame, doi: str = "doi") -> DataFrame:
        """rows with the record ``w`` that their DOI names, null where it names none, and ``doi_method``. Each DOI is looked up once."""
        # rows without DOI have keys of their own, which name nothing: as nulls they would all meet in one task
        told = F.lower(doi)
        own = F.pmod(F.xxhash64(*[c.name for c in rows.schema if "map<" not in c.dataType.simpleString()]), F.lit(NO_DOI)).cast("string")
        keyed = rows.withColumns({"_doi": F.coalesce(told, own), "_none": told.isNull()})
        keys = keyed.filter("not _none").select("_doi").distinct()
        if self.agencies is None:
            agency = F.lower("agency") if "agency" in self.crossref.columns else F.lit("crossref")
            named = _one_record(self.crossref.withColumn("_agency", agency), "_doi", "_agency")
            found = keys.join(named, "_doi", "left").select("_doi", F.col("w"), F.concat(F.lit("doi-"), F.coalesce("_agency", F.lit("crossref"))).alias("doi_method"))
        else:
            datacite, negotiated = (self.crossref.filter("false") if t is None else t for t in (self.datacite, self.negotiated))
            chain = resolve(keys.select(F.col("_doi").alias("doi")), self.agencies, self.crossref, datacite, negotiated, self.strict)
            found = chain.select(F.col("doi").alias("_doi"), "w", "doi_method")
        return keyed.join(found.withColumn("_none", F.lit(False)), ["_doi", "_none"], "left").drop("_doi", "_none")


def _one_record(table: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, w, more): one record a DOI, the one with the smallest title if a table has several."""
    own = table.filter("doi is not null").select(F.lower("doi").alias(key), F.struct(*RECORD_COLUMNS).alias("w"), *more)
    least = F.coalesce("w.title", F.lit(""))
    return own.groupBy(key).agg(*[F.min_by(c, least).alias(c) for c in ("w", *more)])


def _tables(works: DataFrame | DoiTables) -> DoiTables:
    return works if isinstance(works, DoiTables) else DoiTables(works)


#: Works that a search by an arXiv title adds where its entry names no DOI.
ARXIV_ROWS = 3


def authored_titles(refs: DataFrame, entries: DataFrame, top: int = 5) -> DataFrame:
    """(ref_id, work_id, hits, weight, rank): entries that share title words with a reference and have its first author, or, for
    references without any such, entries that share title words. The author counts in the search, before places are cut: an
    author's entries are a realm of the index, in which a word weighs by the entries of this author that have it, among all.
    ``entries`` have source_id, title and authors."""
    first = F.try_element_at("authors", F.lit(1))
    plain = lambda rows: rows.withColumn("words", title_words(F.col("title")))
    asked = WordIndex.keyed(plain(refs.filter("title <> ''")).select("ref_id", "words", F.when(first != "", first).alias("realm")))
    told = plain(entries).select(F.col("source_id").alias("work_id"), "words", "authors")
    signed = told.filter("size(authors) > 0 and size(words) > 0")
    each = signed.select("work_id", "words", F.explode(F.array_distinct("authors")).alias("realm")).filter("realm is not null")
    both = WordIndex.build(each, total=signed.count()).answers(asked.filter("realm is not null"), top)
    rest = asked.join(both.select("aid"), "aid", "left_anti").select("ref_id", "words")
    return WordIndex.told(asked, both).unionByName(WordIndex.build(told.select("work_id", "words")).search(rest, top))


def arxiv_hits(refs: DataFrame, entries: DataFrame, top: int = 5) -> DataFrame:
    """(ref_id, source_id, method): the entry that a reference names by id, or the accepted one of a title search.

    ``refs`` is (ref_id, arxiv_id, title, authors). A title search looks at the first ``top`` entries of the reference's
    first author (see ``authored_titles``) and accepts the first whose title contains the reference's or is contained in
    it, or shares eight of ten words with it.
    """
    ids = entries.select("source_id", strip_version(F.col("source_id")).alias("_id"))
    named = refs.filter("arxiv_id is not null").select("ref_id", strip_version(F.col("arxiv_id")).alias("_id")).join(ids, "_id")
    named = named.select("ref_id", "source_id", F.lit("arxiv-id").alias("method"))
    asked = refs.filter("arxiv_id is null and title <> ''")
    found = authored_titles(asked, entries, top).withColumnRenamed("work_id", "source_id")
    mine = asked.select("ref_id", normalize_arxiv(F.col("title")).alias("_t"))
    theirs = entries.select("source_id", normalize_arxiv(F.col("title")).alias("_e"))
    both = found.join(mine, "ref_id").join(theirs, "source_id")
    words = lambda c: F.array_distinct(F.split(c, " "))
    near = F.contains("_e", "_t") | F.contains("_t", "_e") | (F.size(F.array_intersect(words("_t"), words("_e"))) / F.greatest(F.size(words("_t")), F.size(words("_e"))) >= 0.8)
    accepted = both.filter((F.col("_t") != "") & (F.col("_e") != "") & near).groupBy("ref_id").agg(F.min_by("source_id", "rank").alias("source_id"))
    return named.unionByName(accepted.withColumn("method", F.lit("arxiv-title-search")))


def arxiv_candidates(refs: DataFrame, entries: DataFrame, works: DataFrame | DoiTables, cited: WordIndex | None = None) -> DataFrame:
    """(ref_id, c, ordinal, method): the published version, where the entry's DOI names one, before the preprint; works
    with its title and the reference's first two authors after it, where it names none.

    ``refs`` is (ref_id, arxiv_id) and may have title and authors, by which those without id are searched;
    ``entries`` are records whose source_id is the arXiv id; versions do not count.
    """
    none = F.lit(None)
    asked = refs.select("ref_id", "arxiv_id", *[(F.col(c) if c in refs.columns else none.cast(t)).alias(c) for c, t in (("title", "string"), ("authors", "array<string>"))])
    records = entries.select("source_id", F.struct(*RECORD_COLUMNS).alias("c"))
    hits = arxiv_hits(asked, entries).join(records, "source_id")
    tables = _tables(works)
    works = tables.crossref
    both = tables.lookup(hits.select("ref_id", "c", "method"), "c.doi")
    published = F.struct(F.col("w").withField("source", F.lit("arxiv-published")).alias("c"), F.lit(0).alias("ordinal"), F.col("doi_method").alias("method"))
    own = F.struct(F.col("c"), F.lit(1).alias("ordinal"), F.col("method"))
    listed = F.when(F.col("w").isNotNull(), F.array(published, own)).otherwise(F.array(own))
    out = both.select("ref_id", F.explode(listed).alias("x")).select("ref_id", "x.*")
    if "work_id" not in works.columns:
        return out
    loose = hits.filter("c.doi is null and c.title is not null").join(asked.select("ref_id", F.array_join(F.slice("authors", 1, 2), " ").alias("_a")), "ref_id")
    query = loose.select("ref_id", title_words(F.concat_ws(" ", "c.title", "_a")).alias("words"))
    cited = cited or WordIndex.build(works.select("work_id", citation_words(works).alias("words")))
    more = cited.search(query, ARXIV_ROWS).join(works.select("work_id", F.struct(*RECORD_COLUMNS).alias("c")), "work_id")
    return out.unionByName(more.select("ref_id", F.col("c").withField("source", F.lit("arxiv-crossref")).alias("c"), (1 + F.col("rank")).alias("ordinal"), F.lit("arxiv-crossref").alias("method")))


def pubmed_candidates(refs: DataFrame, hits: DataFrame) -> DataFrame:
    """(ref_id, c, ordinal, method): works of the first stage that finds any for the whole citation, then those
    whose title contains the reference's; each (doi, title) of a reference once, in that order.

    ``refs`` is (ref_id, input_text, title), ``hits`` records whose source_id is their id.
    """
    records = hits.select(F.col("source_id").alias("work_id"), "title", F.struct(*RECORD_COLUMNS).alias("c"))
    staged = staged_candidates(refs, records.select("work_id", "title")).select("ref_id", "work_id", F.col("rank").alias("ordinal"), F.lit("pubmed-full-citation").alias("method"))
    phrase = title_phrase(refs, records).select("ref_id", "work_id", (100 + F.col("rank")).alias("ordinal"), F.lit("pubmed-title").alias("method"))
    found = staged.unionByName(phrase).join(records.select("work_id", "c"), "work_id")
    once = Window.partitionBy("ref_id", "c.doi", "c.title").orderBy("ordinal")
    return found.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("ref_id", "c", "ordinal", "method")


def title_phrase(refs: DataFrame, records: DataFrame, top: int = 5, index: PhraseIndex | None = None) -> DataFrame:
    """(ref_id, work_id, rank): the ``top`` works, by work_id, whose normalised title holds the reference's as a phrase."""
    index = index or PhraseIndex.build(records.select("work_id", phrase_words(F.col("title")).alias("words")))
    return index.search(refs.select("ref_id", phrase_words(F.col("title")).alias("words")), top)


def japanese_hits(refs: DataFrame, titles: DataFrame, top: int = 5) -> DataFrame:
    """(ref_id, title, doi, rank) of a search of (title, doi) for Japanese titles: with blanks between Japanese
    characters left out first, as it stands where that finds nothing; each DOI once."""
    asked = refs.filter(contains_japanese(F.col("title")) & (F.col("title") != ""))
    forms = asked.select("ref_id", F.posexplode(F.array(normalize_japanese_query(F.col("title")), squeeze(F.col("title")))).alias("stage", "title"))
    own = titles.filter("doi is not null").withColumn("_title", normalize_japanese_query(F.col("title")))
    found = block(forms.select(F.struct("ref_id", "stage").alias("ref_id"), "title"), own.select(F.col("doi").alias("work_id"), F.col("_title").alias("title")), top)
    first = first_stage(found.select("ref_id.ref_id", "ref_id.stage", F.col("work_id").alias("doi"), "rank"), "ref_id")
    names = own.groupBy("doi").agg(F.min("title").alias("title"))
    once = first.groupBy("ref_id", "doi").agg(F.min("rank").alias("rank"))
    return once.join(names, "doi").select("ref_id", "title", "doi", "rank")


def japanese_candidates(refs: DataFrame, hits: DataFrame, works: DataFrame | DoiTables) -> DataFrame:
    """(ref_id, c, ordinal, method) from hits (ref_id, title, doi, rank) for references with a Japanese title.

    A hit without DOI is dropped, one whose DOI names no work becomes a record of its title and DOI.
    """
    asked = hits.filter("doi is not null").join(refs.filter(contains_japanese(F.col("title"))).select("ref_id"), "ref_id", "left_semi")
    tables = _tables(works)
    works = tables.crossref
    found = tables.lookup(asked)
    own = {"title": F.col("title"), "doi": F.col("doi"), "source": F.lit("jalc-search"), "source_id": F.col("doi"), "aliases_resolved": F.lit(True), "is_preprint": F.lit(False)}
    types = {f.name: f.dataType for f in works.select(*RECORD_COLUMNS).schema}
    bare = F.struct(*[own.get(c, F.lit(None)).cast(types[c]).alias(c) for c in RECORD_COLUMNS])
    named = F.col("w").withField("source", F.lit("jalc")).withField("source_id", F.col("doi"))
    method = F.when(F.col("w").isNull(), "jalc-title").otherwise(F.concat(F.lit("jalc-title+"), F.col("doi_method")))
    return found.select("ref_id", F.when(F.col("w").isNull(), bare).otherwise(named).alias("c"), F.col("rank").alias("ordinal"), method.alias("method"))


def resolve(dois: DataFrame, agencies: DataFrame, crossref: DataFrame, datacite: DataFrame, negotiated: DataFrame, strict: bool = True) -> DataFrame:
    """dois with the record ``w`` and the ``doi_method`` of the chain: the registration agency's own table, or content negotiation.

    Crossref and DataCite answer for their own DOIs; all other agencies by negotiation; a DOI of an unknown
    agency by Crossref, else by negotiation. Without ``strict`` negotiation also stands in where the agency's
    own table has nothing. ``agencies`` is (prefix, agency), the tables are records. Each distinct DOI goes to
    the tables that may answer for it only, and to the last one only if it is still open.
    """
    routed = agency_of(dois.select(F.lower("doi").alias("doi")).filter("doi is not null").distinct(), agencies)
    routed, _ = write_table(routed.select(F.col("doi").alias("_key"), F.lower("agency").alias("_a")), "routed")
    own, by_agency = F.col("_a").isin("crossref", "datacite"), F.concat(F.lit("doi-"), F.coalesce("_a", F.lit("crossref")))
    first = routed.filter("_a is null or _a = 'crossref'").join(_one_record(crossref, "_key"), "_key")
    second = routed.filter("_a = 'datacite'").join(_one_record(datacite, "_key"), "_key")
    answered, _ = write_table(first.unionByName(second).select("_key", "w", by_agency.alias("doi_method")), "answered")
    open_ = routed.join(answered.select("_key"), "_key", "left_anti")
    may = F.col("_a").isNull() | ~own | F.lit(not strict)
    other = F.when(F.coalesce(~own, F.lit(False)), by_agency).otherwise("doi-content-negotiation")
    last = open_.filter(may).join(_one_record(negotiated, "_key"), "_key").select("_key", "w", other.alias("doi_method"))
    told = answered.unionByName(last)
    lost = F.when(may & F.coalesce(own, F.lit(True)), "doi-content-negotiation").otherwise(by_agency)
    every = routed.join(told, "_key", "left").select("_key", "w", F.coalesce("doi_method", lost).alias("doi_method"))
    return dois.withColumn("_key", F.lower("doi")).join(every, "_key", "left").drop("_key")


def enriched(pairs: DataFrame, works: DataFrame | DoiTables) -> DataFrame:
    """Candidates found by a PubMed method whose DOI names a work, merged with it; all others as they are.

    The fields of the candidate win; the method tells both sources. Scores are computed afterwards.
    """
    tables = _tables(works)
    works = tables.crossref
    found = tables.lookup(pairs, "c.doi")
    gate = F.startswith(F.col("method"), F.lit("pubmed")) & F.col("w").isNotNull()
    fields = merged("c", "w") | {"source": F.lit("pubmed-doi")}
    types = {f.name: f.dataType for f in works.select(*RECORD_COLUMNS).schema}
    both = F.struct(*[F.coalesce(fields[c], F.col(f"c.{c}")).cast(types[c]).alias(c) for c in RECORD_COLUMNS])
    told = F.when(gate, F.concat("method", F.lit("+"), "doi_method")).otherwise(F.col("method"))
    return found.withColumns({"c": F.when(gate, both).otherwise(_record("c")), "method": told}).drop("w", "doi_method")
