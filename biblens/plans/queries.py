"""Queries over the driver's tables and SQL with the same results.

The tables hold no bibliography, so one is derived from them: works from ``part``, references and
notices from ``orders``. Both engines run the same derivation text. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblens.functions import similarity as S
from biblens.functions import text as X
from biblens.operators import collect, decide, index, parse, report, retrieve, score
from biblens.plans.audit import audit, citation_index
from biblens.runtime import ship, spread
from biblens.sources import payloads
from biblens.sources import text as T

_A = "substr('abcdefghijklmnopqrstuvwxyz', CAST(1 + p_partkey % 26 AS INT), 1)"
_B = "substr('abcdefghijklmnopqrstuvwxyz', CAST(1 + floor(p_partkey / 26) % 26 AS INT), 1)"
WORKS = f"""
SELECT p_partkey AS work_id, concat('10.5555/p', CAST(p_partkey AS STRING)) AS doi,
  concat('Effects of ', p_name, ' on ', p_type, ' assembly by ', p_brand) AS title, concat('Ab', {_A}, {_B}, 'son') AS a1,
  concat('Mc', {_B}, {_A}, 'er') AS a2, concat('Journal of ', p_type, ' Studies') AS venue, p_type AS kind, CAST(1990 + p_size % 30 AS INT) AS year,
  CAST(1 + p_partkey % 40 AS STRING) AS volume, CAST(1 + p_partkey % 12 AS STRING) AS issue, concat('e', CAST(10000 + p_partkey AS STRING)) AS page
FROM {{part}}"""
REFS = f"""
SELECT o.o_orderkey AS ref_id, w.work_id, w.doi AS work_doi, w.title, w.a1, w.a2, w.venue, w.year, w.volume, w.issue, w.page,
  CASE WHEN o.o_orderkey % 5 = 0 THEN concat('Notes about ', substr(w.title, 12)) ELSE w.title END AS r_title,
  CAST(w.year + CASE WHEN o.o_orderkey % 7 = 0 THEN 1 WHEN o.o_orderkey % 11 = 0 THEN 4 ELSE 0 END AS INT) AS r_year,
  CASE WHEN o.o_orderkey % 13 = 0 THEN '' WHEN o.o_orderkey % 17 = 0 THEN '99' ELSE w.volume END AS r_volume,
  CASE WHEN o.o_orderkey % 13 = 0 THEN '' WHEN o.o_orderkey % 19 = 0 THEN '' ELSE w.issue END AS r_issue,
  CASE WHEN o.o_orderkey % 23 = 0 THEN concat(w.page, '-', w.page) WHEN o.o_orderkey % 29 = 0 THEN 'e1' WHEN o.o_orderkey % 31 = 0 THEN '' ELSE w.page END AS r_page
FROM (SELECT o_orderkey, o_orderkey % (SELECT count(*) FROM {{part}}) AS k FROM {{orders}}) o JOIN ({WORKS}) w ON w.work_id = o.k"""
LINES = f"""
SELECT *, concat(a1, ' A, ', a2, ' B. ', r_title, '. ', venue, '. ', CAST(r_year AS STRING), '; ', volume, '(', issue, '): ', page, '.',
  CASE WHEN ref_id % 3 = 0 THEN concat(' DOI: ', work_doi, ').') ELSE '' END) AS input_text FROM ({REFS}) r"""
NOTICES = """
SELECT concat('10.5555/p', CAST(o_orderkey % (SELECT count(*) FROM {part}) AS STRING)) AS target_doi, concat('10.5555/n', CAST(o_orderkey AS STRING)) AS notice_doi,
  CASE WHEN o_orderstatus = 'F' THEN 'retraction' WHEN o_orderstatus = 'P' THEN 'correction' ELSE 'Withdrawal' END AS update_type, 'publisher' AS source,
  'Notice' AS label, CAST(CAST(o_orderdate AS DATE) AS STRING) AS updated FROM {orders}"""
STATUSES = """
SELECT o_orderkey AS ref_id, CASE WHEN o_orderkey % 10 < 5 THEN 'found' WHEN o_orderkey % 10 < 7 THEN 'likely_wrong' WHEN o_orderkey % 10 < 9 THEN 'not_found' ELSE 'website' END AS status,
  o_orderkey % 10 < 5 AS found, CASE WHEN o_orderkey % 7 = 0 THEN 'year_warning' END AS note, o_orderstatus = 'F' AND o_orderkey % 10 < 7 AS retracted,
  CASE WHEN o_orderkey % 11 = 0 THEN 'partial' ELSE 'complete' END AS verification_status FROM {orders}"""
_DUCK = {n: n for n in ("part", "orders", "documents", "pages", "customer")}
_BIB = "concat('@article{k', CAST(work_id AS STRING), ', author = {', a1, ', A and ', a2, ', B}, title = {{', title, '}}, journal = \"', venue, '\", year = ', CAST(year AS STRING), ', doi = {', doi, '}}')"


def _sql(spark: SparkSession, sf_dir: str, text: str, deal: bool = False) -> DataFrame:
    """Run SQL whose tables are names in braces. With ``deal`` the keys of orders are dealt over all tasks before rows are made of them."""
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in _DUCK if f"{{{n}}}" in text}
    if deal:
        frames["orders"] = spread(frames["orders"], "o_orderkey")
    return spark.sql(text, **frames)


def _duck(text: str) -> str:
    return text.format(**_DUCK)


def works_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived works with the columns of a record."""
    empty = F.array().cast("array<string>")
    rows = _sql(spark, sf_dir, WORKS)
    return rows.withColumns(
        {
            "authors": F.array(F.lower("a1"), F.lower("a2")), "venue_aliases": empty, "issns": empty, "article_number": F.col("page"),
            "source": F.lit("crossref"), "source_id": F.lit(None).cast("string"), "is_preprint": F.lit(False), "aliases_resolved": F.lit(False),
        }
    )


def references_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LINES)


def known_pairs(spark: SparkSession, sf_dir: str, text: str = REFS, *more: str, deal: bool = False) -> DataFrame:
    """References beside the work that they were derived from, as records, with further columns of ``text``."""
    rows = _sql(spark, sf_dir, text, deal)
    none = F.lit(None).cast("string")
    names = F.array(F.lower("a1"), F.lower("a2"))
    empty = F.array().cast("array<string>")
    r = F.struct(F.col("r_title").alias("title"), names.alias("authors"), F.col("r_year").alias("year"), "venue", F.col("r_volume").alias("volume"), F.col("r_issue").alias("issue"), F.col("r_page").alias("page"), none.alias("article_number"))
    c = F.struct("title", names.alias("authors"), "year", "venue", empty.alias("venue_aliases"), "volume", "issue", "page", none.alias("article_number"), F.col("work_doi").alias("doi"), F.lit("crossref").alias("source"), none.alias("source_id"), F.lit(False).alias("is_preprint"), F.lit(False).alias("aliases_resolved"))
    return rows.select("ref_id", "work_id", r.alias("r"), c.alias("c"), *more)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    columns = ("ref_id", "status", "note", "method", "matched_doi", "retracted", "comparison_summary")
    return audit(references_table(spark, sf_dir).select("ref_id", "input_text"), works_table(spark, sf_dir), _sql(spark, sf_dir, NOTICES), columns=columns).select(*columns)


# -- queries ---------------------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_LABELS = ", ".join(f"'{x}'" for x in T.LABELS)
_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 1))"
_OVERLAP = "len(list_intersect({0}, {1})) / greatest(len({0}), len({1}))"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST(line_no AS INT) AS line_no, trim(regexp_replace(trim(line), '^(\\[\\d+\\]|\\d+[.)])\\s*', '')) AS input_text FROM l
WHERE trim(line) <> '' AND lower(trim(line)) NOT IN ({_LABELS})"""
)
def split_reference_lines(spark, sf_dir):
    return T.split_references(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


@query(f"""SELECT ref_id, nullif(rtrim(regexp_extract(input_text, '10\\.\\d{{4,9}}/[^\\s"<>]+'), ').,;'), '') AS doi FROM ({_duck(LINES)}) t""")
def extract_doi(spark, sf_dir):
    return references_table(spark, sf_dir).select("ref_id", parse.doi(F.col("input_text")).alias("doi"))


@query(f"""SELECT ref_id, CAST(list_filter(regexp_extract_all(input_text, '\\d+'), lambda x: regexp_full_match(x, '(19|20)\\d\\d'))[-1] AS INT) AS year FROM ({_duck(LINES)}) t""")
def extract_year(spark, sf_dir):
    return references_table(spark, sf_dir).select("ref_id", parse.year(F.col("input_text")).alias("year"))


_VIP = "'(\\d+)\\s*\\(([^)]+)\\)\\s*[:,]\\s*([A-Za-z]?\\d[\\w–-]*)'"
_ISSUES = f"SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN replace(input_text, concat('(', issue, ')'), concat('(Suppl ', issue, ')')) WHEN 1 THEN replace(input_text, concat('(', issue, '): '), concat('( ', issue, ' Pt 1 ) , S')) ELSE input_text END AS input_text FROM ({LINES}) l"


@query(
    f"""SELECT ref_id, regexp_extract(input_text, {_VIP}, 1) AS volume, trim(regexp_extract(input_text, {_VIP}, 2)) AS issue, regexp_extract(input_text, {_VIP}, 3) AS page,
CASE WHEN regexp_full_match(regexp_extract(input_text, {_VIP}, 3), '[A-Za-z]?\\d\\w*') THEN regexp_extract(input_text, {_VIP}, 3) END AS article_number
FROM ({_duck(_ISSUES)}) t WHERE regexp_matches(input_text, {_VIP})"""
)
def extract_volume_issue_page(spark, sf_dir):
    found = _sql(spark, sf_dir, _ISSUES).select("ref_id", parse.numbers(F.col("input_text")).alias("n")).select("ref_id", "n.*").filter("issue is not null")
    return found.withColumn("article_number", parse.article_number(F.col("page")))


_ARXIV = "concat(CAST(1000 + work_id % 9000 AS STRING), '.', CAST(10000 + work_id % 90000 AS STRING), 'v', CAST(1 + work_id % 3 AS STRING))"
_ARXIV_TEXT = f"""CASE work_id % 7 WHEN 0 THEN title WHEN 1 THEN concat(title, '. https://arxiv.org/abs/', {_ARXIV}) WHEN 2 THEN concat(title, '. ARXIV:Cond-Mat.Mes-Hall/', CAST(1000000 + work_id AS STRING))
WHEN 3 THEN concat(title, ', arXiv preprint ', {_ARXIV}, '.') WHEN 4 THEN concat(title, ', arXiv ', CAST(1000 + work_id % 9000 AS STRING), '.123456') WHEN 5 THEN concat(title, '. ', {_ARXIV}) ELSE concat(title, '. arXiv: ', {_ARXIV}, '.') END"""
_NAMED, _BARE = "'(?i)(?:arxiv:\\s*|arxiv\\.org/abs/)(\\d{4}\\.\\d{4,5}(?:v\\d+)?|[a-z][a-z.-]+/\\d{7}(?:v\\d+)?)'", "'\\b(\\d{4}\\.\\d{4,5}(?:v\\d+)?)\\b'"


@query(
    f"""SELECT work_id, arxiv_id, regexp_replace(arxiv_id, 'v\\d+$', '') AS base_id FROM (SELECT work_id,
coalesce(nullif(regexp_extract(t, {_NAMED}, 1), ''), CASE WHEN contains(lower(t), 'arxiv') THEN nullif(regexp_extract(t, {_BARE}, 1), '') END) AS arxiv_id FROM (SELECT work_id, {_ARXIV_TEXT} AS t FROM ({_duck(WORKS)}) w) x) y"""
)
def extract_arxiv_id(spark, sf_dir):
    found = _sql(spark, sf_dir, WORKS).withColumn("t", F.expr(_ARXIV_TEXT)).select("work_id", parse.arxiv_id(F.col("t")).alias("arxiv_id"))
    return found.withColumn("base_id", X.strip_version(F.col("arxiv_id")))


def _bibtex(spark, sf_dir):
    return _sql(spark, sf_dir, WORKS).select("work_id", F.expr(f"CASE WHEN work_id % 5 = 0 THEN concat(title, '. ', venue) ELSE {_BIB} END").alias("text"))


@query(f"SELECT work_id, work_id % 5 <> 0 AS bibtex FROM ({_duck(WORKS)}) w")
def bibtex_detect(spark, sf_dir):
    return _bibtex(spark, sf_dir).select("work_id", T.is_bibtex(F.col("text")).alias("bibtex"))


@query(f"""SELECT work_id, CASE WHEN work_id % 5 = 0 THEN concat(title, '. ', venue) ELSE concat_ws('. ', concat(a1, ', ', a2), CAST(year AS STRING), title, venue, concat('DOI: ', doi)) END AS input_text FROM ({_duck(WORKS)}) w""")
def bibtex_to_text(spark, sf_dir):
    return T.load_references(_bibtex(spark, sf_dir), "work_id", "text").select("work_id", "input_text")


@query(
    f"""WITH s AS (SELECT ref_id, list_filter(list_transform(string_split(input_text, '.'), lambda x: trim(x)), lambda x: x <> '') AS segs FROM ({_duck(LINES)}) t),
n AS (SELECT ref_id, unnest(segs[1:4]) AS seg, unnest(range(least(4, len(segs)))) AS i FROM s),
p AS (SELECT ref_id, seg, 10 * len(regexp_split_to_array(seg, '\\s+')) - 3 * length(regexp_replace(seg, '\\D', '', 'g'))
  - CASE WHEN len(list_filter(regexp_extract_all(seg, '\\d+'), lambda x: regexp_full_match(x, '(19|20)\\d\\d'))) > 0 THEN 80 ELSE 0 END
  - CASE WHEN regexp_matches(seg, '\\d+\\s*\\(\\d+\\)') THEN 60 ELSE 0 END AS points FROM n
  WHERE length(seg) >= 15 AND NOT (i = 0 AND (length(seg) - length(replace(seg, ',', '')) >= 2 OR contains(lower(seg), 'et al') OR (contains(seg, ',') AND regexp_matches(seg, '\\b[A-Z]{{1,3}}\\b'))))),
b AS (SELECT ref_id, seg FROM p QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY points DESC, seg DESC) = 1)
SELECT s.ref_id, coalesce(b.seg, s.segs[2], s.segs[1]) AS title FROM s LEFT JOIN b ON s.ref_id = b.ref_id"""
)
def title_candidate(spark, sf_dir):
    return references_table(spark, sf_dir).select("ref_id", parse.title(F.col("input_text")).alias("title"))


_SITE = "CASE page_id % 4 WHEN 0 THEN concat('Tool page at ', url, ' seen today') WHEN 1 THEN concat('One two three.four,five six:seven eight nine ', url, CASE WHEN page_id % 8 = 1 THEN ' x' ELSE ' more' END) WHEN 2 THEN concat('One two three four five six seven a.b. ', url) ELSE 'An AI-powered tool without an address' END"


@query(
    f"""SELECT page_id, (regexp_matches(t, 'https?://\\S+') AND len(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(t, 'https?://\\S+', ''), '[\\s.,;:]+', ' ', 'g')), '\\s+'), lambda w: length(w) > 1)) <= 8)
OR len(list_filter([{", ".join(f"'{p}'" for p in parse.WEBSITE_PHRASES)}], lambda p: contains(lower(t), p))) > 0 AS is_website FROM (SELECT page_id, {_SITE} AS t FROM pages) p"""
)
def website_filter(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", parse.is_website(F.expr(_SITE)).alias("is_website"))


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS normal FROM documents""")
def normalize_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(X.normalize_text(F.col("text")).cast("binary")).alias("normal"))


@query(f"SELECT work_id, lower(a1) AS key FROM ({_duck(WORKS)}) w")
def author_key(spark, sf_dir):
    name = "CASE WHEN work_id % 3 = 0 THEN concat(a1, ', A. B.') WHEN work_id % 3 = 1 THEN concat('B. ', a1) ELSE concat(a1, ' CD') END"
    return _sql(spark, sf_dir, WORKS).select("work_id", X.normalize_author(F.expr(name)).alias("key"))


@query(f"SELECT ref_id, round({_OVERLAP.format('x', 'y')}, 9) AS overlap FROM (SELECT ref_id, {_WORDS.format('r_title')} AS x, {_WORDS.format('title')} AS y FROM ({_duck(REFS)}) r) t")
def token_overlap(spark, sf_dir):
    pair = known_pairs(spark, sf_dir)
    return pair.select("ref_id", F.round(S.token_overlap(X.normalize_text(F.col("r.title")), X.normalize_text(F.col("c.title"))), 9).alias("overlap"))


@query(
    f"""SELECT ref_id, round_even(len(list_intersect(m, c)) / greatest(len(m), len(c)), 3)::DOUBLE AS overlap, CASE WHEN m[1] = c[1] THEN 1.0 ELSE 0.0 END::DOUBLE AS first_author
FROM (SELECT ref_id, [lower(a1), lower(a2)] AS c, CASE ref_id % 3 WHEN 0 THEN [lower(a1), lower(a2)] WHEN 1 THEN [lower(a2)] ELSE [lower(a2), 'other', lower(a1)] END AS m FROM ({_duck(REFS)}) r) t"""
)
def author_overlap(spark, sf_dir):
    a, b = F.col("r.authors")[0], F.col("r.authors")[1]
    mine = F.when(F.col("ref_id") % 3 == 0, F.array(a, b)).when(F.col("ref_id") % 3 == 1, F.array(b)).otherwise(F.array(b, F.lit("other"), a))
    return known_pairs(spark, sf_dir).select("ref_id", S.author_overlap(mine, F.col("c.authors")).alias("overlap"), S.first_author_match(mine, F.col("c.authors")).alias("first_author"))


_YEAR = "CASE abs(r_year - year) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.3 ELSE 0.0 END::DOUBLE"
_VI = """CASE WHEN r_volume = '' AND r_issue = '' THEN 0.0 WHEN (r_volume <> '' AND r_volume <> volume) OR (r_issue <> '' AND r_issue <> issue) THEN 0.0
ELSE round_even(CASE WHEN r_volume <> '' THEN 0.7 ELSE 0.2 END + CASE WHEN r_issue <> '' THEN 0.3 ELSE 0.1 END, 3) END::DOUBLE"""
_PAGES = "CASE WHEN r_page = '' THEN 0.0 WHEN r_page = page THEN 1.0 WHEN contains(replace(r_page, '-', ''), page) OR contains(page, replace(r_page, '-', '')) THEN 0.8 ELSE 0.0 END::DOUBLE"


@query(f"SELECT ref_id, {_YEAR} AS similarity FROM ({_duck(REFS)}) r")
def year_similarity(spark, sf_dir):
    return known_pairs(spark, sf_dir).select("ref_id", S.year_similarity(F.col("r.year"), F.col("c.year")).alias("similarity"))


@query(f"SELECT ref_id, {_VI} AS similarity FROM ({_duck(REFS)}) r")
def volume_issue_similarity(spark, sf_dir):
    mine, theirs = ([X.normalize_number(F.col(f"{side}.{f}")) for f in ("volume", "issue")] for side in "rc")
    return known_pairs(spark, sf_dir).select("ref_id", S.volume_issue_similarity(*mine, *theirs).alias("similarity"))


@query(f"SELECT ref_id, {_PAGES} AS similarity FROM ({_duck(REFS)}) r")
def page_similarity(spark, sf_dir):
    mine, theirs = ([X.normalize_number(F.col(f"{side}.{f}")) for f in ("page", "article_number")] for side in "rc")
    return known_pairs(spark, sf_dir).select("ref_id", S.page_similarity(*mine, *theirs).alias("similarity"))


@query()
def sequence_similarity(spark, sf_dir):
    pair = known_pairs(spark, sf_dir).select("ref_id", X.normalize_text(F.col("r.title")).alias("a"), X.normalize_text(F.col("c.title")).alias("b"))
    return pair.select("ref_id", S.sequence_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query(f"SELECT work_id, CAST(work_id % 2 = 0 AS BOOLEAN) AS abbreviates FROM ({_duck(WORKS)}) w")
def venue_abbrev_match(spark, sf_dir):
    short = F.expr("CASE WHEN work_id % 2 = 0 THEN concat('j ', lower(substr(kind, 1, 3)), ' stud') ELSE concat('stud ', lower(substr(kind, 1, 3))) END")
    # a Python UDF can not stand inside a higher-order function: its result is a column first
    named = _sql(spark, sf_dir, WORKS).select("work_id", short.alias("short"), X.normalize_venue(F.col("venue")).alias("long"))
    return named.select("work_id", S.looks_like_abbreviation(F.col("short"), F.col("long")).alias("abbreviates"))


@query(f"SELECT r.ref_id, w.work_id FROM ({_duck(LINES)}) r JOIN ({_duck(WORKS)}) w ON r.ref_id % 3 = 0 AND w.doi = r.work_doi")
def doi_lookup_join(spark, sf_dir):
    refs = references_table(spark, sf_dir).select("ref_id", parse.doi(F.col("input_text")).alias("doi"))
    return retrieve.by_doi(refs, works_table(spark, sf_dir).select("work_id", "doi")).select("ref_id", "work_id")


@query(f"SELECT agency, count(*) AS n FROM (SELECT CASE WHEN work_id % 3 = 0 THEN 'Crossref' WHEN work_id % 3 = 1 THEN 'JaLC' END AS agency FROM ({_duck(WORKS)}) w) t GROUP BY agency")
def registration_agency_join(spark, sf_dir):
    agencies = spark.createDataFrame([("10.5555", "Crossref"), ("10.1241", "JaLC")], "prefix string, agency string")
    dois = _sql(spark, sf_dir, WORKS).select(F.expr("CASE WHEN work_id % 3 = 0 THEN doi WHEN work_id % 3 = 1 THEN replace(doi, '10.5555', '10.1241') ELSE replace(doi, '10.5555', '10.9999') END").alias("doi"))
    return retrieve.agency_of(dois, agencies).groupBy("agency").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH w AS ({_duck(WORKS)}), n AS (SELECT count(*) AS n FROM w), ww AS (SELECT work_id, unnest({_WORDS.format('title')}) AS word FROM w),
d AS (SELECT word, count(*) AS df FROM ww GROUP BY word), i AS (SELECT word, CAST(round(ln(1 + n / df) * 1000) AS BIGINT) AS idf FROM d, n),
r AS ({_duck(REFS)}), t AS (SELECT DISTINCT r_title FROM r), tw AS (SELECT r_title, unnest({_WORDS.format('r_title')}) AS word FROM t),
p AS (SELECT r_title, ww.work_id, count(*) AS hits, CAST(sum(idf) AS BIGINT) AS weight FROM tw JOIN i USING (word) JOIN ww USING (word) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY r_title ORDER BY weight DESC, work_id) AS INT) AS rank FROM p QUALIFY rank <= 5)
SELECT r.ref_id, k.work_id, hits, weight, rank FROM r JOIN k USING (r_title)"""
)
def candidate_block_topk(spark, sf_dir):
    refs = _sql(spark, sf_dir, REFS).select("ref_id", F.col("r_title").alias("title"))
    return retrieve.block(refs, _sql(spark, sf_dir, WORKS).select("work_id", "title"))


_TITLE = f"round_even({_OVERLAP.format(_WORDS.format('r_title'), _WORDS.format('title'))}, 3)"
_SCORED = f"""SELECT *, round_even(0.0::DOUBLE + 0.3::DOUBLE * t + 0.2::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE * y + 0.1::DOUBLE + 0.08::DOUBLE * vi + 0.12::DOUBLE * pg, 3) AS total,
CAST(t >= 0.45 AS INT) + 1 + 1 + CAST(y >= 0.7 AS INT) + 1 + CAST(pg >= 0.8 AS INT) + CAST(vi >= 0.7 AS INT) AS support
FROM (SELECT *, {_TITLE} AS t, {_YEAR} AS y, {_VI} AS vi, {_PAGES} AS pg FROM ({_duck(REFS)}) r) s"""
_DECISION = "CASE WHEN total >= 0.74 AND t >= 0.72 AND y > 0 THEN 'accept' WHEN total >= 0.45 AND support >= 2 THEN 'suggest' ELSE 'reject' END"


@query(f"SELECT ref_id, work_id, total, support, {_DECISION} AS decision FROM ({_SCORED}) z")
def score_candidates_token(spark, sf_dir):
    return score.decide_pairs(known_pairs(spark, sf_dir), sequence=False).select("ref_id", "work_id", "total", "support", "decision")


@query()
def score_candidates_full(spark, sf_dir):
    return score.score(known_pairs(spark, sf_dir)).select("ref_id", "work_id", "total", "decision", "summary")


@query(
    f"""SELECT ref_id, CASE decision WHEN 'accept' THEN 'found' WHEN 'suggest' THEN 'likely_wrong' ELSE 'not_found' END AS status,
CASE WHEN decision = 'accept' AND y = 0.7 THEN 'year_warning' WHEN decision = 'suggest' THEN 'candidate_mismatch' WHEN decision = 'reject' THEN 'no_match' END AS note
FROM (SELECT *, {_DECISION} AS decision FROM ({_SCORED}) z) d"""
)
def decide_status_token(spark, sf_dir):
    pairs = known_pairs(spark, sf_dir)
    scored = score.decide_pairs(pairs.withColumns({"ordinal": F.lit(1), "method": F.lit("bibliographic")}), sequence=False)
    refs = pairs.select("ref_id", F.lit(None).cast("string").alias("doi"), F.lit(False).alias("is_website"))
    return decide.decide(refs, decide.rank(scored)).select("ref_id", "status", "note")


@query(f"SELECT ref_id, CAST(min(o) AS INT) AS ordinal FROM (SELECT ref_id, CASE WHEN ref_id % 2 = 0 THEN title ELSE 'x' END AS k, 2 AS o FROM ({_duck(REFS)}) a UNION ALL SELECT ref_id, title, 1 FROM ({_duck(REFS)}) b) u GROUP BY ref_id, k")
def candidate_dedup(spark, sf_dir):
    pairs = known_pairs(spark, sf_dir)
    other = pairs.withColumn("c", F.when(F.col("ref_id") % 2 == 0, F.col("c")).otherwise(F.col("c").withField("title", F.lit("x"))))
    return decide.dedup_candidates(other.withColumn("ordinal", F.lit(2)).unionByName(pairs.withColumn("ordinal", F.lit(1)))).select("ref_id", "ordinal")


_RANKED = "SELECT o_custkey AS ref_id, o_orderkey AS ordinal, CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'suggest' ELSE 'reject' END AS decision, o_totalprice AS total, o_orderpriority = '1-URGENT' AS is_preprint FROM {orders}"


@query(
    f"""SELECT ref_id, ordinal, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY CASE decision WHEN 'accept' THEN 2 WHEN 'suggest' THEN 1 ELSE 0 END DESC, total DESC, CAST(is_preprint AS INT), ordinal) AS INT) AS rank
FROM ({_duck(_RANKED)}) t"""
)
def rank_candidates(spark, sf_dir):
    return decide.rank(_sql(spark, sf_dir, _RANKED), preprint="is_preprint").select("ref_id", "ordinal", "rank")


@query(f"SELECT work_id, CASE WHEN work_id % 2 = 0 THEN title ELSE 'Other' END AS title, CASE WHEN work_id % 3 = 0 THEN venue ELSE 'Second' END AS venue, CASE WHEN work_id % 5 = 0 THEN 1999 ELSE year END AS year, work_id % 7 = 0 AS is_preprint, concat(venue, '|', 'J ', kind) AS aliases FROM ({_duck(WORKS)}) w")
def merge_records(spark, sf_dir):
    works = works_table(spark, sf_dir)
    a = works.withColumns({"title": F.expr("CASE WHEN work_id % 2 = 0 THEN title ELSE ' ' END"), "venue": F.expr("CASE WHEN work_id % 3 = 0 THEN venue END"), "year": F.expr("CASE WHEN work_id % 5 = 0 THEN 0 ELSE year END"), "venue_aliases": F.array("venue"), "is_preprint": F.lit(True)})
    b = works.withColumns({"title": F.lit("Other"), "venue": F.lit("Second"), "year": F.lit(1999), "venue_aliases": F.expr("array(venue, concat('J ', kind))"), "is_preprint": F.expr("work_id % 7 = 0")})
    fields = payloads.merged("a", "b")
    joined = a.alias("a").join(b.alias("b"), F.col("a.work_id") == F.col("b.work_id"))
    return joined.select(F.col("a.work_id").alias("work_id"), fields["title"].alias("title"), fields["venue"].alias("venue"), fields["year"].alias("year"), fields["is_preprint"].alias("is_preprint"), F.array_join(fields["venue_aliases"], "|").alias("aliases"))


@query(f"SELECT target_doi, count(*) AS n, min(updated) AS first_update FROM ({_duck(NOTICES)}) t WHERE lower(update_type) IN ('retraction', 'withdrawal', 'removal', 'partial_retraction') GROUP BY target_doi")
def retraction_join(spark, sf_dir):
    found = decide.retractions(_sql(spark, sf_dir, NOTICES))
    return found.select("target_doi", F.size("retraction_details").cast("long").alias("n"), F.array_min(F.transform("retraction_details", lambda d: d["updated"])).alias("first_update"))


@query(
    f"""SELECT work_id, CASE WHEN work_id % 3 <> 0 THEN coalesce(n, 0) > 0 ELSE false END AS retracted FROM ({_duck(WORKS)}) w
LEFT JOIN (SELECT target_doi, count(*) AS n FROM ({_duck(NOTICES)}) t WHERE lower(update_type) IN ('retraction', 'withdrawal') GROUP BY target_doi) x ON x.target_doi = w.doi"""
)
def retraction_flag(spark, sf_dir):
    results = _sql(spark, sf_dir, WORKS).select("work_id", F.col("doi").alias("matched_doi"), F.expr("CASE WHEN work_id % 3 = 0 THEN 'not_found' ELSE 'found' END").alias("status"))
    return decide.with_retractions(results, _sql(spark, sf_dir, NOTICES)).select("work_id", "retracted")


@query(f"SELECT work_id, CASE WHEN work_id % 4 <> 0 THEN concat('J ', kind, ' Stud') ELSE '' END AS aliases, work_id % 4 <> 0 AS aliases_resolved FROM ({_duck(WORKS)}) w")
def alias_enrich(spark, sf_dir):
    works = works_table(spark, sf_dir)
    title = F.expr("lower(concat('Journal of ', kind, ' Studies'))")
    aliases = works.select("kind").distinct().select(F.lit(None).cast("string").alias("issn"), title.alias("title_norm"), F.expr("array(concat('J ', kind, ' Stud'))").alias("aliases"))
    found = retrieve.with_aliases(works.withColumn("gate", F.expr("work_id % 4 <> 0")), aliases)
    return found.select("work_id", F.array_join("venue_aliases", "|").alias("aliases"), "aliases_resolved")


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (status = 'found' AND NOT bad) AS ok, count(*) FILTER (bad) AS bad, count(*) FILTER (status = 'website') AS website
FROM (SELECT *, status IN ('likely_wrong', 'not_found') OR retracted OR coalesce(note, '') = 'year_warning' OR verification_status = 'partial' AS bad FROM ({_duck(STATUSES)}) s) t"""
)
def status_counts(spark, sf_dir):
    return report.counts(_sql(spark, sf_dir, STATUSES))


_CLASS = """CASE WHEN retracted THEN 'retracted' WHEN status = 'likely_wrong' THEN 'likely_wrong' WHEN status = 'website' THEN 'website' WHEN status = 'not_found' THEN 'not_found'
WHEN status = 'found' AND coalesce(note, '') = 'year_warning' THEN 'year_warning' WHEN verification_status = 'partial' THEN 'partial' ELSE 'ok' END"""


@query(f"SELECT {_CLASS} AS kind, count(*) AS n FROM ({_duck(STATUSES)}) s GROUP BY 1")
def class_counts(spark, sf_dir):
    return _sql(spark, sf_dir, STATUSES).groupBy(report.browser_class().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_SECTION = """CASE WHEN retracted THEN 'retracted' WHEN status = 'website' THEN 'website' WHEN verification_status = 'partial' AND found THEN 'partial' WHEN coalesce(note, '') = 'year_warning' AND found THEN 'year_warning'
WHEN status = 'likely_wrong' THEN 'likely_wrong' WHEN status = 'found' THEN 'ok' ELSE 'not_found' END"""


@query(f"SELECT ref_id, {_SECTION} AS section FROM ({_duck(STATUSES)}) s WHERE status IN ('likely_wrong', 'not_found') OR retracted OR coalesce(note, '') = 'year_warning' OR verification_status = 'partial'")
def report_lines(spark, sf_dir):
    rows = _sql(spark, sf_dir, STATUSES).filter(report.is_problem())
    return rows.select("ref_id", report.section().alias("section"))


_REQUEST = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 5 = 1 THEN repeat('x', 2001) ELSE c_name END AS ref, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN 'no address' ELSE concat(c_name, '@example.org') END AS email FROM {customer}"


@query(
    f"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'reference text is required' WHEN c_custkey % 5 = 1 THEN 'reference text must be 2000 characters or fewer'
WHEN c_custkey % 7 = 0 THEN 'email is required' WHEN c_custkey % 7 = 1 THEN 'email format is invalid' END AS error FROM ({_duck(_REQUEST)}) r"""
)
def validate_requests(spark, sf_dir):
    return report.validate_requests(_sql(spark, sf_dir, _REQUEST)).select("c_custkey", "error")


_CITED = f"SELECT ref_id, concat(input_text, CASE WHEN ref_id % 2 = 0 THEN ' Early trial: a TRIAL of 12(3):45-67 in BMC  Medicine 4:5.' ELSE ' lancet & Review' END) AS input_text FROM ({LINES}) l"


def _sql_plain(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '[&;,.()\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g'))"


_SIMPLE = "regexp_replace(regexp_replace(regexp_replace(input_text, '\\b10\\.\\d{{4,9}}/\\S+', '', 'g'), '\\b\\d+\\(\\d+\\):\\d+-\\d+', '', 'g'), '\\b\\d+:\\d+', '', 'g')".replace("{{", "{").replace("}}", "}")
_JOURNAL = "coalesce(" + ", ".join(f"nullif(regexp_extract(input_text, '(?i)\\b{j}'), '')" for j in collect.JOURNALS) + ")"


@query(
    f"""WITH q AS ({_duck(_CITED)}),
w AS (SELECT *, regexp_extract_all(substr(input_text, strpos(input_text, '.') + 1), '(?i)\\b({"|".join(collect.TITLE_WORDS)})\\b') AS ws FROM q),
d AS (SELECT *, list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(y)), lower(x)) = i)[1:8] AS kept FROM w)
SELECT ref_id, {_sql_plain("input_text")} AS cleaned, {_sql_plain(_SIMPLE)} AS simplified,
array_to_string(list_filter(list_concat([nullif(regexp_extract(input_text, '\\b(?:19|20)\\d{{2}}\\b'), '')], regexp_extract_all(split_part(input_text, '.', 1), '\\b[A-Z][a-z]+\\b')[1:3], [{_JOURNAL}], kept), lambda x: x IS NOT NULL), ' ') AS key_terms FROM d"""
)
def search_stages(spark, sf_dir):
    return collect.search_stages(_sql(spark, sf_dir, _CITED)).select("ref_id", "cleaned", "simplified", "key_terms")


def _entries(spark, sf_dir):
    """Preprints of every third work, without a DOI for half of them."""
    works = works_table(spark, sf_dir).filter("work_id % 3 = 0")
    return works.withColumns({"source": F.lit("arxiv"), "source_id": F.expr(f"replace({_ARXIV}, 'v', concat('.', CAST(work_id AS STRING), 'v'))"), "is_preprint": F.lit(True), "venue": F.lit("arXiv"), "doi": F.expr("CASE WHEN work_id % 2 = 0 THEN doi END")})


_ENTRY = f"replace({_ARXIV}, 'v', concat('.', CAST(work_id AS STRING), 'v'))"


@query(
    f"""WITH w AS ({_duck(WORKS)}), e AS (SELECT {_ENTRY} AS id, CASE WHEN work_id % 2 = 0 THEN doi END AS doi FROM w WHERE work_id % 3 = 0),
r AS (SELECT ref_id, {_ENTRY} AS id FROM ({_duck(REFS)}) x WHERE ref_id % 2 = 0),
h AS (SELECT ref_id, e.doi FROM r JOIN e ON regexp_replace(r.id, 'v\\d+$', '') = regexp_replace(e.id, 'v\\d+$', ''))
SELECT ref_id, 1 AS ordinal, 'arxiv-id' AS method, doi FROM h UNION ALL SELECT ref_id, 0, 'doi-crossref', doi FROM h WHERE doi IS NOT NULL"""
)
def arxiv_candidates(spark, sf_dir):
    works = works_table(spark, sf_dir)
    refs = _sql(spark, sf_dir, REFS).filter("ref_id % 2 = 0").select("ref_id", F.expr(_ENTRY).alias("arxiv_id"))
    found = collect.arxiv_candidates(refs, _entries(spark, sf_dir), works.drop("work_id"))
    return found.select("ref_id", "ordinal", "method", F.col("c.doi").alias("doi"))


@query(
    f"""WITH w AS ({_duck(WORKS)}), r AS (SELECT ref_id, work_doi AS doi, CASE WHEN ref_id % 4 = 0 THEN NULL ELSE work_doi END AS asked, ref_id % 3 AS k FROM ({_duck(REFS)}) x)
SELECT ref_id, CASE WHEN k = 0 AND asked IS NOT NULL THEN concat('pubmed-title', '+doi-crossref') WHEN k = 0 THEN 'pubmed-title' ELSE 'bibliographic' END AS method,
CASE WHEN k = 0 AND asked IS NOT NULL THEN w.venue END AS venue, asked AS doi FROM r JOIN w ON w.doi = r.doi"""
)
def enriched(spark, sf_dir):
    pairs = known_pairs(spark, sf_dir)
    types = {f.name: f.dataType for f in works_table(spark, sf_dir).select(*payloads.RECORD_COLUMNS).schema}
    own = {"title": F.col("c.title"), "doi": F.expr("CASE WHEN ref_id % 4 <> 0 THEN c.doi END"), "aliases_resolved": F.lit(False), "is_preprint": F.lit(False), "venue_aliases": F.array(), "authors": F.array(), "issns": F.array()}
    c = F.struct(*[own.get(f, F.lit(None)).cast(types[f]).alias(f) for f in payloads.RECORD_COLUMNS])
    rows = pairs.select("ref_id", c.alias("c"), F.expr("CASE WHEN ref_id % 3 = 0 THEN 'pubmed-title' ELSE 'bibliographic' END").alias("method"))
    return collect.enriched(rows, works_table(spark, sf_dir)).select("ref_id", "method", F.col("c.venue").alias("venue"), F.col("c.doi").alias("doi"))


_STAGED = f"SELECT ref_id, r_title AS input_text FROM ({REFS}) r WHERE ref_id % 3 = 0"


@query(
    f"""WITH w AS ({_duck(WORKS)}), n AS (SELECT count(*) AS n FROM w), ww AS (SELECT work_id, unnest({_WORDS.format('title')}) AS word FROM w),
i AS (SELECT word, CAST(round(ln(1 + any_value(n) / count(*)) * 1000) AS BIGINT) AS idf FROM ww, n GROUP BY word),
r AS ({_duck(_STAGED)}), t AS (SELECT DISTINCT input_text FROM r), tw AS (SELECT input_text, unnest({_WORDS.format('input_text')}) AS word FROM t),
p AS (SELECT input_text, ww.work_id, CAST(sum(idf) AS BIGINT) AS weight FROM tw JOIN i USING (word) JOIN ww USING (word) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY input_text ORDER BY weight DESC, work_id) AS INT) AS rank FROM p QUALIFY rank <= 5)
SELECT r.ref_id, k.work_id, rank, 'raw' AS stage FROM r JOIN k USING (input_text)"""
)
def staged_candidates(spark, sf_dir):
    return collect.staged_candidates(_sql(spark, sf_dir, _STAGED), _sql(spark, sf_dir, WORKS).select("work_id", "title"))


@query(
    f"""WITH w AS ({_duck(WORKS)}), a AS (SELECT *, work_id % 5 AS k, CASE work_id % 5 WHEN 0 THEN 'crossref' WHEN 1 THEN 'datacite' WHEN 2 THEN 'jalc' WHEN 3 THEN 'medra' END AS agency FROM w)
SELECT work_id, CASE WHEN k = 0 AND work_id % 2 = 0 THEN 'x' WHEN k = 1 AND work_id % 2 = 0 THEN 'd' WHEN k IN (2, 3) THEN 'n' WHEN k = 4 AND work_id % 2 = 0 THEN 'x' WHEN k = 4 THEN 'n' END AS answered,
CASE WHEN k = 4 AND work_id % 2 = 1 THEN 'doi-content-negotiation' ELSE concat('doi-', coalesce(agency, 'crossref')) END AS doi_method FROM a"""
)
def resolver_chain(spark, sf_dir):
    agencies = spark.createDataFrame([("10.0", "Crossref"), ("10.1", "DataCite"), ("10.2", "JaLC"), ("10.3", "mEDRA")], "prefix string, agency string")
    works = works_table(spark, sf_dir).withColumn("doi", F.expr("concat('10.', CAST(work_id % 5 AS STRING), '/', CAST(work_id AS STRING))"))
    half = works.filter("work_id % 2 = 0")
    named = lambda rows, name: rows.withColumn("source", F.lit(name))
    found = collect.resolve(works.select("work_id", "doi"), agencies, named(half, "x"), named(half, "d"), named(works, "n"))
    return found.select("work_id", F.col("w.source").alias("answered"), "doi_method")


_GAPS = "SELECT o_orderkey % 1000 AS ref_id, CASE o_orderkey % 4 WHEN 0 THEN 'jalc' WHEN 1 THEN 'pubmed' WHEN 2 THEN 'crossref' ELSE 'arxiv' END AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'TimeoutError' END AS error FROM {orders}"


@query(
    f"""WITH g AS (SELECT ref_id, source, max(error) AS error FROM ({_duck(_GAPS)}) t GROUP BY ALL)
SELECT ref_id, coalesce(string_agg(source, ',' ORDER BY list_position(['crossref', 'pubmed', 'arxiv', 'jalc'], source)) FILTER (error IS NULL), '') AS unchecked, count(error) AS failed FROM g GROUP BY ref_id"""
)
def source_gaps(spark, sf_dir):
    gaps = _sql(spark, sf_dir, _GAPS)
    found = decide.source_gaps(gaps.select("ref_id").distinct(), gaps)
    return found.select("ref_id", F.array_join("unchecked_sources", ",").alias("unchecked"), F.size(F.map_keys("source_errors")).cast("long").alias("failed"))


# -- searches of kept indexes, and the audit as a whole: SQL joins everything, or takes the fields from which lines were made --------

_NAMES = "concat(lower(a1), ' ', lower(a2))"
_WORK_WORDS = "concat_ws(' ', title, venue, volume, issue, page, page, lower(a1), lower(a2), CAST(year AS VARCHAR))"


def _full_join(asked: str, named: str, top: int = 5) -> str:
    """SQL over (id, words) tables ``asked`` and ``named``: every word joined, weighed by its squared idf, the first places."""
    return f"""q AS (SELECT words, row_number() OVER (ORDER BY words) AS qid FROM (SELECT DISTINCT list_sort(words) AS words FROM {asked} WHERE len(words) > 0) d), n AS (SELECT count(*) AS n FROM {named} WHERE len(words) > 0),
ww AS (SELECT id AS work_id, unnest(words) AS word FROM {named}), i AS (SELECT word, row_number() OVER (ORDER BY word) AS wid, CAST(round(pow(ln(1 + any_value(n) / count(*)), 2) * 1000) AS BIGINT) AS idf FROM ww, n GROUP BY word),
qw AS (SELECT qid, wid, idf FROM (SELECT qid, unnest(words) AS word FROM q) x JOIN i USING (word)), wi AS (SELECT work_id, wid FROM ww JOIN i USING (word)),
p AS (SELECT qid, wi.work_id, count(*) AS hits, CAST(sum(idf) AS BIGINT) AS weight FROM qw JOIN wi USING (wid) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY weight DESC, work_id) AS INT) AS rank FROM p QUALIFY rank <= {top})
SELECT a.id AS ref_id, k.work_id, hits, weight, rank FROM {asked} a JOIN q ON list_sort(a.words) = q.words JOIN k USING (qid)"""


@query(f"WITH a AS (SELECT ref_id AS id, {_WORDS.format('input_text')} AS words FROM ({_duck(LINES)}) l), w AS (SELECT work_id AS id, {_WORDS.format(_WORK_WORDS)} AS words FROM ({_duck(WORKS)}) w), {_full_join('a', 'w')}")
def citation_search(spark, sf_dir):
    works = works_table(spark, sf_dir)
    asked = spread(references_table(spark, sf_dir).select("ref_id", "input_text"), "ref_id").select("ref_id", index.title_words(F.col("input_text")).alias("words"))
    return citation_index(works).search(asked)


_PHRASES = f"SELECT ref_id, CASE WHEN ref_id % 9 = 0 THEN 'Assembly, by' WHEN ref_id % 9 = 1 THEN split_part(lower(r_title), ' ', 4) ELSE concat_ws(' ', split_part(r_title, ' ', 2), split_part(r_title, ' ', 3), split_part(r_title, ' ', 4)) END AS title FROM ({REFS}) r"
_NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""WITH r AS ({_duck(_PHRASES)}), q AS (SELECT DISTINCT {_NORMAL.format('title')} AS phrase FROM r), w AS (SELECT work_id, concat(' ', {_NORMAL.format('title')}, ' ') AS t FROM ({_duck(WORKS)}) x),
k AS (SELECT phrase, work_id, CAST(row_number() OVER (PARTITION BY phrase ORDER BY work_id) AS INT) AS rank FROM q JOIN w ON contains(t, concat(' ', phrase, ' ')) QUALIFY rank <= 5)
SELECT ref_id, work_id, rank FROM r JOIN k ON {_NORMAL.format('title')} = phrase"""
)
def title_phrase(spark, sf_dir):
    works = _sql(spark, sf_dir, WORKS).select("work_id", "title")
    return collect.title_phrase(_sql(spark, sf_dir, _PHRASES), works)


_AUTHORED = f"SELECT ref_id, r_title AS title, CASE ref_id % 3 WHEN 0 THEN lower(a1) WHEN 1 THEN lower(a2) ELSE 'nobody' END AS first_author FROM ({REFS}) r"
_PAIRS = "list_transform({1}, lambda x: concat({0}, '|', x))"


@query(
    f"""WITH r AS (SELECT *, {_WORDS.format('title')} AS plain FROM ({_duck(_AUTHORED)}) x), e AS (SELECT work_id, {_WORDS.format('title')} AS plain, lower(a1) AS one, lower(a2) AS two FROM ({_duck(WORKS)}) w),
ra AS (SELECT ref_id AS id, {_PAIRS.format('first_author', 'plain')} AS words FROM r), ea AS (SELECT work_id AS id, list_concat({_PAIRS.format('one', 'plain')}, {_PAIRS.format('two', 'plain')}) AS words FROM e),
both_ AS (WITH {_full_join('ra', 'ea')}), rt AS (SELECT ref_id AS id, plain AS words FROM r WHERE ref_id NOT IN (SELECT ref_id FROM both_)), et AS (SELECT work_id AS id, plain AS words FROM e)
SELECT * FROM both_ UNION ALL (WITH {_full_join('rt', 'et')})"""
)
def authored_titles(spark, sf_dir):
    refs = _sql(spark, sf_dir, _AUTHORED).select("ref_id", "title", F.array("first_author").alias("authors"))
    entries = works_table(spark, sf_dir).select(F.col("work_id").alias("source_id"), "title", "authors")
    return collect.authored_titles(refs, entries)


_GAPPY = f"""SELECT *, CASE WHEN ref_id % 10 = 1 THEN NULL ELSE r_title END AS g_title, CASE WHEN ref_id % 12 = 5 THEN NULL ELSE r_year END AS g_year, CASE WHEN ref_id % 8 = 3 THEN NULL ELSE venue END AS g_venue, CASE WHEN ref_id % 7 = 2 THEN NULL ELSE venue END AS h_venue,
CASE WHEN ref_id % 6 = 4 THEN '' ELSE r_volume END AS g_volume, CASE WHEN ref_id % 6 = 4 THEN '' ELSE r_issue END AS g_issue, CASE WHEN ref_id % 6 = 4 THEN '' ELSE r_page END AS g_page, ref_id % 9 = 8 AS anonymous FROM ({REFS}) r"""
_SHORT = "CASE WHEN {0} >= 0.7 THEN 'ok' WHEN {0} >= 0.35 THEN '~' ELSE 'x' END"
_GVI, _GPG = (x.replace("r_volume", "g_volume").replace("r_issue", "g_issue").replace("r_page", "g_page") for x in (_VI, _PAGES))


@query(
    f"""WITH g AS (SELECT *, CASE WHEN g_title IS NULL THEN 0 ELSE round_even({_OVERLAP.format(_WORDS.format('g_title'), _WORDS.format('title'))}, 3) END AS t, {_YEAR.replace('r_year', 'g_year')} AS y, greatest({_GVI}, {_GPG}) AS pg,
  g_volume = '' AND g_issue = '' AND g_page = '' AS unplaced FROM ({_duck(_GAPPY)}) x)
SELECT ref_id, concat('title ', CASE WHEN g_title IS NULL THEN '?' ELSE {_SHORT.format('t')} END, ' / authors ', CASE WHEN anonymous THEN '?' ELSE 'ok' END, ' / year ', CASE WHEN g_year IS NULL THEN '?' ELSE {_SHORT.format('y')} END,
  ' / venue ', CASE WHEN g_venue IS NULL OR h_venue IS NULL THEN '?' ELSE 'ok' END, ' / pages ', CASE WHEN unplaced THEN '?' ELSE {_SHORT.format('pg')} END) AS summary,
concat_ws(',', CASE WHEN g_title IS NULL THEN 'missing_input' WHEN t >= 0.7 THEN 'ok' WHEN t >= 0.35 THEN 'near' ELSE 'mismatch' END, CASE WHEN anonymous THEN 'missing_input' ELSE 'ok' END,
  CASE WHEN g_year IS NULL THEN 'missing_input' WHEN y = 1 THEN 'ok' WHEN y >= 0.7 THEN 'near' ELSE 'mismatch' END,
  CASE WHEN g_venue IS NULL AND h_venue IS NULL THEN 'missing_both' WHEN g_venue IS NULL THEN 'missing_input' WHEN h_venue IS NULL THEN 'missing_candidate' ELSE 'ok' END,
  CASE WHEN unplaced THEN 'missing_input' WHEN pg >= 0.7 THEN 'ok' WHEN pg >= 0.35 THEN 'near' ELSE 'mismatch' END) AS states,
concat_ws(',', CASE WHEN g_title IS NULL THEN '{score.MISSING_IN_REFERENCE}' ELSE '-' END, CASE WHEN anonymous THEN '{score.MISSING_IN_REFERENCE}' ELSE '-' END,
  CASE WHEN g_year IS NULL THEN '{score.MISSING_IN_REFERENCE}' WHEN y = 0.7 THEN '{score.YEAR_APART}' ELSE '-' END,
  CASE WHEN g_venue IS NULL AND h_venue IS NULL THEN '-' WHEN g_venue IS NULL THEN '{score.MISSING_IN_REFERENCE}' WHEN h_venue IS NULL THEN '{score.MISSING_IN_CANDIDATE}' ELSE '-' END,
  CASE WHEN unplaced THEN '{score.MISSING_IN_REFERENCE}' ELSE '-' END) AS reasons FROM g"""
)
def field_states(spark, sf_dir):
    pairs = known_pairs(spark, sf_dir, _GAPPY, "g_title", "g_year", "g_venue", "h_venue", "g_volume", "g_issue", "g_page", "anonymous", deal=True)
    none = F.array().cast("array<string>")
    r = F.col("r")
    for f in ("title", "year", "venue", "volume", "issue", "page"):
        r = r.withField(f, F.col(f"g_{f}"))
    pairs = pairs.withColumns({"r": r.withField("authors", F.when(F.col("anonymous"), none).otherwise(F.col("r.authors"))), "c": F.col("c").withField("venue", F.col("h_venue"))})
    of = lambda f: F.array_join(F.transform("field_diffs", lambda d: F.coalesce(d[f], F.lit("-"))), ",").alias(f"{f}s")
    return score.score(pairs, sequence=False).select("ref_id", "summary", of("state"), of("reason"))


_ISSNS = "CASE work_id % 4 WHEN 0 THEN ['2', '1', '1', ' 3 '] WHEN 1 THEN ['', ' '] WHEN 2 THEN ['3', '3', '9'] ELSE [] END"


@query(
    f"""WITH w AS (SELECT *, list_sort(list_distinct(list_filter(list_transform({_ISSNS}, lambda x: trim(x)), lambda x: x <> '')))[1:2] AS issns FROM ({_duck(WORKS)}) w), a(issn, name) AS (VALUES ('2', 'Two'), ('3', 'Three'), ('9', 'Nine'))
SELECT work_id, CASE WHEN len(issns) = 0 THEN concat('J ', kind, ' Stud') ELSE coalesce((SELECT name FROM a WHERE a.issn = issns[1]), (SELECT name FROM a WHERE a.issn = issns[2]), '') END AS aliases FROM w"""
)
def alias_lookup(spark, sf_dir):
    works = works_table(spark, sf_dir).withColumns({"issns": F.expr(_ISSNS.replace("[", "array(").replace("]", ")")).cast("array<string>"), "gate": F.lit(True)})
    title = F.expr("lower(concat('Journal of ', kind, ' Studies'))")
    by_title = works.select("kind").distinct().select(F.lit(None).cast("string").alias("issn"), title.alias("title_norm"), F.expr("array(concat('J ', kind, ' Stud'))").alias("aliases"))
    by_issn = spark.createDataFrame([("2", None, ["Two"]), ("3", None, ["Three"]), ("9", None, ["Nine"])], "issn string, title_norm string, aliases array<string>")
    return retrieve.with_aliases(works, by_title.unionByName(by_issn)).select("work_id", F.array_join("venue_aliases", "|").alias("aliases"))


_TWICE = f"SELECT * FROM ({NOTICES}) a UNION ALL SELECT target_doi, CASE WHEN length(target_doi) % 2 = 0 THEN notice_doi ELSE concat(notice_doi, 'b') END, upper(update_type), source, label, updated FROM ({NOTICES}) b"


@query(
    f"""SELECT target_doi, count(DISTINCT (notice_doi, lower(update_type))) AS n FROM ({_duck(_TWICE)}) t WHERE lower(update_type) IN ('retraction', 'withdrawal', 'removal', 'partial_retraction') GROUP BY target_doi"""
)
def retraction_types(spark, sf_dir):
    return decide.retractions(_sql(spark, sf_dir, _TWICE)).select("target_doi", F.size("retraction_details").cast("long").alias("n"))


@query(
    f"""SELECT o_custkey AS ref_id, o_orderkey AS ordinal, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderpriority = '1-URGENT' AS INT), o_orderkey) AS INT) AS rank FROM orders"""
)
def rank_by_record(spark, sf_dir):
    """Candidates that only look like preprints by their source are ranked as published ones."""
    rows = _sql(spark, sf_dir, "SELECT o_custkey AS ref_id, o_orderkey AS ordinal, 'accept' AS decision, 1.0 AS total, named_struct('is_preprint', o_orderpriority = '1-URGENT', 'source', CASE WHEN o_orderkey % 2 = 0 THEN 'arxiv' ELSE 'crossref' END) AS c, o_orderkey % 2 = 0 AS preprint_like FROM {orders}")
    return decide.rank(rows).select("ref_id", "ordinal", "rank")


_LAST_YEAR = "CAST(list_filter(regexp_extract_all(input_text, '\\d+'), lambda x: regexp_full_match(x, '(19|20)\\d\\d'))[-1] AS INT)"


@query(
    f"""SELECT ref_id, CASE WHEN ref_id % 3 = 0 THEN work_doi END AS doi, false AS is_website, r_title AS title, concat(lower(a1), '|', lower(a2)) AS authors, {_LAST_YEAR} AS year, venue, volume, issue, page, page AS article_number FROM ({_duck(LINES)}) l"""
)
def record_fields(spark, sf_dir):
    parsed = parse.parse(references_table(spark, sf_dir).select("ref_id", "input_text"))
    return parsed.select("ref_id", "doi", "is_website", "title", F.array_join("authors", "|").alias("authors"), "year", "venue", "volume", "issue", "page", "article_number")


# works whose ids agree modulo 676 have the same authors; no others can be accepted, and each reference's own work is at least suggested
_OVERLAPS = lambda a, b: _OVERLAP.format(_WORDS.format(a), _WORDS.format(b))


@query(
    f"""WITH l AS (SELECT ref_id, work_id AS own, r_title, venue AS r_venue, volume AS r_volume, issue AS r_issue, page AS r_page, {_LAST_YEAR} AS r_year FROM ({_duck(LINES)}) x),
p AS (SELECT l.*, w.* FROM l JOIN ({_duck(WORKS)}) w ON own % 676 = w.work_id % 676 AND (ref_id % 3 <> 0 OR own = w.work_id)),
s AS (SELECT *, round_even({_OVERLAPS('r_title', 'title')}, 3) AS t, {_YEAR} AS y, CASE WHEN venue = r_venue THEN 1.0 ELSE round_even({_OVERLAPS('r_venue', 'venue')}, 3) END::DOUBLE AS v, {_VI} AS vi, {_PAGES} AS pg FROM p),
z AS (SELECT *, round_even(0.0::DOUBLE + 0.3::DOUBLE * t + 0.2::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE * y + 0.1::DOUBLE * v + 0.08::DOUBLE * vi + 0.12::DOUBLE * pg, 3) AS total,
  CAST(t >= 0.45 AS INT) + 2 + CAST(y >= 0.7 AS INT) + CAST(v >= 0.6 AS INT) + CAST(pg >= 0.8 AS INT) + CAST(vi >= 0.7 AS INT) AS support FROM s),
d AS (SELECT *, {_DECISION} AS decision FROM z QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY CASE {_DECISION} WHEN 'accept' THEN 2 WHEN 'suggest' THEN 1 ELSE 0 END DESC, total DESC) = 1)
SELECT ref_id, CASE decision WHEN 'accept' THEN 'found' WHEN 'suggest' THEN 'likely_wrong' END AS status, CASE WHEN decision = 'accept' AND y = 0.7 THEN 'year_warning' WHEN decision = 'suggest' THEN 'candidate_mismatch' END AS note,
CASE WHEN ref_id % 3 = 0 THEN 'doi-crossref' ELSE 'bibliographic' END AS method, doi AS matched_doi FROM d"""
)
def audit_statuses(spark, sf_dir):
    refs = references_table(spark, sf_dir).select("ref_id", "input_text")
    columns = ("ref_id", "status", "note", "method", "matched_doi")
    return audit(refs, works_table(spark, sf_dir), sequence=False, columns=columns).select(*columns)


_PAGE_BIB = "concat('@Article{k', CAST(work_id AS STRING), ', author = \"', a1, ', A and B. ', a2, '\", title = {{', title, '} of {', kind, '}}, note = {year = 1, x}, year = ', CAST(year AS STRING), ', journal = {', venue, '}, doi = {', doi, CASE WHEN work_id % 3 = 0 THEN '}, eprint = {2101.00001}, archivePrefix = {ARXIV' WHEN work_id % 3 = 1 THEN '}, eprint = {2101.00001}, archivePrefix = {arXiv e-print' ELSE '' END, '}}')"


@query(
    f"""SELECT work_id, 0 AS line_no, concat_ws('. ', concat(a1, ', ', a2), CAST(year AS VARCHAR), concat(title, ' of ', kind), venue, concat('DOI: ', doi), CASE WHEN work_id % 3 = 0 THEN 'arXiv:2101.00001' END) AS input_text FROM ({_duck(WORKS)}) w"""
)
def page_references(spark, sf_dir):
    """Entries in the dialect of the interactive page; a field inside the note comes before the entry's own."""
    return T.page_references(_sql(spark, sf_dir, WORKS).select("work_id", F.expr(_PAGE_BIB).alias("text")), "work_id", "text")


_PAGE_ROWS = f"SELECT *, concat('Line `', CAST(ref_id AS STRING), '` of ``` text') AS input_text FROM ({STATUSES}) s"
_BLANK = "array<struct<title:string,doi:string,field_summary:string>>"
_NL = "chr(10)"
_PAGE_CLASS = _CLASS
_PAGE_SECTIONS = {
    "partial": ("⏱ 検証未完了", []),
    "likely_wrong": ("⚠️ Likely Wrong Citation", []),
    "year_warning": ("△ 出版年注意", [f"'{report.YEAR_REMARK}'"]),
    "not_found": ("❌ 未発見", ["concat('- 理由: ', coalesce(note, '候補なし'))"]),
    "retracted": ("🚩 撤回・撤回相当（Crossref 更新通知）", ["'- マッチ: **(no title)**'", "'- DOI: `N/A`'", "''", "'#### 参照された更新（通知）'", "''"]),
}
_PAGE_TEXT = "CASE kind " + " ".join(f"WHEN '{k}' THEN array_to_string(['### {head}', '', concat('- 入力: ', code), {''.join(x + ', ' for x in more)}''], {_NL})" for k, (head, more) in _PAGE_SECTIONS.items()) + " END"
_PAGE_LABEL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{'🚩 ' * (k == 'retracted')}{v}'" for k, v in report.BROWSER_LABELS.items()) + " END"


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY ref_id) AS number, {_PAGE_CLASS} AS kind, concat('`', replace(input_text, '`', '\\`'), '`') AS code FROM ({_duck(_PAGE_ROWS)}) x)
SELECT '0' AS part, 0 AS number, array_to_string(['# Reference Audit Report', '', '## 入力', '', '```'], {_NL}) AS markdown UNION ALL SELECT '1', number, replace(input_text, '```', concat('``', chr(8203), '`')) FROM r
UNION ALL SELECT '2', 0, array_to_string(list_concat(['```', '', '## チェック結果', ''], [{", ".join(f"concat('- {report.BROWSER_LABELS[k]}: ', CAST(count(*) FILTER (kind = '{k}') AS VARCHAR))" for k in report.PAGE_COUNTS)}], ['']), {_NL}) FROM r
UNION ALL SELECT '3', number, concat(CAST(number AS VARCHAR), '. **[', {_PAGE_LABEL}, ']** ', code) FROM r UNION ALL SELECT '4', 0, array_to_string(['', '## 注意すべき候補', ''], {_NL})
UNION ALL SELECT '5', number, {_PAGE_TEXT} FROM r WHERE kind NOT IN ('ok', 'website')
UNION ALL SELECT '6', 0, array_to_string(['---', '', '## Diagnostics', '', '| # | elapsed (s) | budget (s) | skipped | error |', '|---|---|---|---|---|'], {_NL})
UNION ALL SELECT '7', number, concat('| ', CAST(number AS VARCHAR), CASE WHEN ref_id % 2 = 0 THEN ' | 1.5 | 55 | jalc, arxiv | pubmed:TimeoutError |' ELSE ' | - | - | - | - |' END) FROM r UNION ALL SELECT '8', 0, ''"""
)
def page_report(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = _sql(spark, sf_dir, _PAGE_ROWS).withColumns({c: none for c in ("matched_title", "matched_doi", "comparison_summary")})
    details = {"retraction_details": "array<struct<notice_doi:string,update_type:string,source:string,updated:string,label:string>>", "unchecked_sources": "array<string>", "source_errors": "map<string,string>", "candidates": _BLANK, "field_diffs": "array<struct<field:string,state:string,input_value:string,candidate_value:string,reason:string,score:double>>"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in details.items()})
    checks = rows.filter("ref_id % 2 = 0").select("ref_id", F.lit(1.5).alias("elapsed_sec"), F.lit(55.0).alias("budget_sec"), F.array(F.lit("jalc"), F.lit("arxiv")).alias("skipped"), F.create_map(F.lit("pubmed"), F.lit("TimeoutError")).alias("source_errors"), none.alias("error"))
    return report.page_report(rows, checks=checks)


_CSL = """concat('{"title":', CASE WHEN work_id % 2 = 0 THEN concat('"', title, '"') ELSE concat('["', title, '","Other"]') END, ',"author":[{"family":"', a1, '","given":"A"},{"family":"', a2, '"}],"issued":{"date-parts":[[', CASE WHEN work_id % 3 = 0 THEN concat('"', CAST(year AS STRING), '"') ELSE CAST(year AS STRING) END,
',5]]},"container-title":', CASE WHEN work_id % 5 = 0 THEN concat('["', venue, '"]') ELSE concat('"', venue, '"') END, ',"volume":', CASE WHEN work_id % 7 = 0 THEN volume ELSE concat('"', volume, '"') END, CASE WHEN work_id % 2 = 0 THEN ',"number":"' ELSE ',"issue":"' END, issue, '","page":"', page, '"}')"""


@query(f"SELECT doi, title, concat(lower(a1), '|', lower(a2)) AS authors, year, venue, volume, issue, page, page AS article_number, false AS is_preprint FROM ({_duck(WORKS)}) w")
def csl_records(spark, sf_dir):
    found = payloads.csl_records(_sql(spark, sf_dir, WORKS).select("doi", F.expr(_CSL).alias("json")))
    return found.select("doi", "title", F.array_join("authors", "|").alias("authors"), "year", "venue", "volume", "issue", "page", "article_number", "is_preprint")


_HITS = "SELECT o_custkey AS ref_id, CAST(o_orderkey % (SELECT count(*) FROM {part}) AS STRING) AS pmid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS place FROM {orders}"
_SUMMARY = """concat('{"title":"', title, '","authors":[{"name":"', a1, ' A"},{"name":""}],"pubdate":"', CASE WHEN work_id % 3 = 0 THEN '' ELSE concat(CAST(year AS STRING), ' Jan') END, '","sortpubdate":"', CAST(year + 1 AS STRING), '/01/01 00:00","source":"', venue,
'","articleids":[{"idtype":"pubmed","value":"', CAST(work_id AS STRING), '"}', CASE WHEN work_id % 4 = 0 THEN concat(',{"idtype":"DOI","value":"', doi, '"}') ELSE '' END, ']}')"""
_XML = "concat('<A><ArticleIdList><ArticleId IdType=\"pmc\">x</ArticleId><ArticleId IdType=\"doi\">', CASE WHEN work_id % 4 = 1 THEN concat(doi, 'x') ELSE '' END, '</ArticleId></ArticleIdList></A>')"


@query(
    f"""SELECT ref_id, pmid, place, title, year + CASE WHEN work_id % 3 = 0 THEN 1 ELSE 0 END AS year, venue AS journal,
CASE WHEN work_id % 4 = 0 THEN doi WHEN place <= 3 AND work_id % 4 = 1 THEN concat(doi, 'x') WHEN place <= 3 THEN '' END AS doi FROM ({_duck(_HITS)}) h JOIN ({_duck(WORKS)}) w ON pmid = CAST(work_id AS VARCHAR)"""
)
def pubmed_details(spark, sf_dir):
    works = _sql(spark, sf_dir, WORKS).select(F.col("work_id").cast("string").alias("pmid"), F.expr(_SUMMARY).alias("json"), F.expr(_XML).alias("xml"))
    return payloads.pubmed_details(_sql(spark, sf_dir, _HITS), works.select("pmid", "json"), works.select("pmid", "xml")).select("ref_id", "pmid", "place", "title", "year", "journal", "doi")


@query()
def browser_report(spark, sf_dir):
    return report.browser_lines(audit(references_table(spark, sf_dir).select("ref_id", "input_text"), works_table(spark, sf_dir), _sql(spark, sf_dir, NOTICES)))


@query()
def report_full(spark, sf_dir):
    return report.report_rows(audit(references_table(spark, sf_dir).select("ref_id", "input_text"), works_table(spark, sf_dir), _sql(spark, sf_dir, NOTICES)), full=True)


@query()
def record_parse(spark, sf_dir):
    return parse.parse(spread(references_table(spark, sf_dir).select("ref_id", "input_text"), "ref_id"))


@query()
def audit_references(spark, sf_dir):
    return flagship(spark, sf_dir)


@query()
def report_markdown(spark, sf_dir):
    results = audit(references_table(spark, sf_dir).select("ref_id", "input_text"), works_table(spark, sf_dir), _sql(spark, sf_dir, NOTICES))
    return report.report_rows(results)


@query()
def json_payload(spark, sf_dir):
    return report.as_json(audit(references_table(spark, sf_dir).select("ref_id", "input_text"), works_table(spark, sf_dir), _sql(spark, sf_dir, NOTICES)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
