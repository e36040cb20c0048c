"""Citation lines to records (P2 to P13, F1), as narrow projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblens.functions.text import JAPANESE, nullif_blank, reference_line

# Phrases that mark a software or website reference.
WEBSITE_PHRASES = (
    "systematic review software", "ai-powered tool", "ai research assistant", "evidence partners", "installation documentation",
)
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
ARXIV = r"(\d{4}\.\d{4,5}(?:v\d+)?|[a-z][a-z.-]+/\d{7}(?:v\d+)?)"
EDGE = " .,:;"


def doi(c: Column) -> Column:
    """The first DOI without trailing punctuation, or null."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"""(10\.\d{4,9}/[^\s"<>]+)""", 1)
    return nullif_blank(F.regexp_replace(found, r"[).,;]+$", ""))


def arxiv_id(c: Column) -> Column:
    """An arXiv id of either style and any case with its prefix or address, or a bare new one, standing
    alone, in a text that says arXiv."""
    named = nullif_blank(F.regexp_extract(c, rf"(?i)(?:arxiv:\s*|arxiv\.org/abs/){ARXIV}", 1))
    bare = F.when(c.rlike("(?i)arxiv"), nullif_blank(F.regexp_extract(c, r"(?U)\b(\d{4}\.\d{4,5}(?:v\d+)?)\b", 1)))
    return F.coalesce(named, bare)


def year(c: Column) -> Column:
    """The last year-like number, wherever it stands."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(YEAR), 1), F.lit(-1)).cast("int")


def is_website(c: Column) -> Column:
    """An address with at most eight words beside it, or a phrase of software references. Points, commas and colons part words."""
    rest = F.regexp_replace(F.regexp_replace(c, r"(?sU)^(.*?)https?://\S+", "$1"), r"(?U)[\s.,;:]+", " ")
    words = F.size(F.filter(F.split(F.trim(rest), r"\s+"), lambda w: F.length(w) > 1))
    phrase = F.lit(False)
    for p in WEBSITE_PHRASES:
        phrase = phrase | F.contains(F.lower(c), F.lit(p))
    return F.coalesce((c.rlike(r"https?://\S+") & (words <= 8)) | phrase, F.lit(False))


def title(c: Column) -> Column:
    """The likeliest of the first four sentences; ties go to the greater text. Authors' sentences are
    left out, digits and years count against, words count for."""
    segments = F.filter(F.transform(F.split(c, r"\."), lambda s: F.trim(s)), lambda s: s != "")
    commas = lambda s: F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    authors = lambda s: (commas(s) >= 2) | F.contains(F.lower(s), F.lit("et al")) | ((commas(s) >= 1) & s.rlike(r"\b[A-Z]{1,3}\b"))

    def scored(s: Column) -> Column:
        words = F.size(F.split(s, r"\s+"))
        digits = F.length(F.regexp_replace(s, r"\D", ""))
        points = 10 * words - 3 * digits - F.when(s.rlike(YEAR), 80).otherwise(0) - F.when(s.rlike(r"\d+\s*\(\d+\)"), 60).otherwise(0)
        return F.struct(points.alias("points"), s.alias("text"))

    numbered = F.transform(F.slice(segments, 1, 4), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    fit = F.filter(numbered, lambda x: (F.length(x["s"]) >= 15) & ~((x["i"] == 0) & authors(x["s"])))
    best = F.array_max(F.transform(fit, lambda x: scored(x["s"])))
    return F.coalesce(best["text"], F.try_element_at(segments, F.lit(2)), F.try_element_at(segments, F.lit(1)))


def trim_title(c: Column) -> Column:
    return nullif_blank(F.regexp_replace(F.regexp_replace(c, r"(?i),\s*arxiv.*$", ""), r"^[ ,.;:]+|[ ,.;:]+$", ""))


def _edges(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ .,:;]+|[ .,:;]+$", "")


def _until_year(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?s){YEAR}.*$", "")


def author_segment(c: Column, title_: Column) -> Column:
    at = F.coalesce(F.position(title_, c), F.lit(0))
    head = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(F.substring_index(c, ".", 1))
    return _edges(F.regexp_replace(_until_year(head), r"(?is)\bDOI:.*$", ""))


def authors(segment: Column) -> Column:
    """Author keys in order, each once; initials are dropped."""
    s = F.regexp_replace(segment, r"(?i)\bet al\b\.?", "")
    s = F.regexp_replace(s, r"(?i)\s+and\s+|\s*&\s*|\s*・\s*|;", ",")
    names = F.transform(F.split(s, ","), lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, r"\b[A-Z]{1,3}\b", " "), r"\.", " ")))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def numbers(c: Column) -> Column:
    """struct(volume, issue, page): v(i):p or v(i),p first, whatever the issue says, else v:p or v,p."""
    page = r"([A-Za-z]?\d[\w–-]*)"
    full, short = rf"(?U)(\d+)\s*\(([^)]+)\)\s*[:,]\s*{page}", rf"(?U)(\d+)\s*[:,]\s*{page}"
    one = lambda p, g: nullif_blank(F.trim(F.regexp_extract(c, p, g)))
    has = c.rlike(full)
    pick = lambda a, b: F.when(has, a).otherwise(b)
    return F.struct(pick(one(full, 1), one(short, 1)).alias("volume"), F.when(has, one(full, 2)).alias("issue"), pick(one(full, 3), one(short, 2)).alias("page"))


def article_number(page: Column) -> Column:
    return F.when(page.rlike(r"(?U)^[A-Za-z]?\d\w*$"), page)


def venue(c: Column, title_: Column) -> Column:
    """What follows the title up to a year, without DOI; the whole line is looked at where it holds no title."""
    at = F.coalesce(F.when(title_ != "", F.position(title_, c)), F.lit(0))
    after = F.when(at > 0, F.substring(c, at + F.length(title_), F.length(c))).otherwise(c)
    found = nullif_blank(_edges(_until_year(F.regexp_replace(after, r"(?iU)\bDOI:\s*10\.\S+", ""))))
    return F.when((found == "Available from") & c.rlike("(?i)arxiv"), F.lit("arXiv")).otherwise(found)


def parse(refs: DataFrame, text_col: str = "input_text") -> DataFrame:
    """The columns of a record beside those of ``refs``. Identifiers and the website test see the raw line,
    the other fields the normalised one."""
    raw = F.col(text_col)
    step = refs.withColumn("_line", reference_line(raw))
    step = step.withColumns({"doi": doi(raw), "arxiv_id": arxiv_id(raw), "is_website": is_website(raw), "_title": title(F.col("_line"))})
    line, t = F.col("_line"), F.col("_title")
    step = step.withColumns({"_names": authors(author_segment(line, t)), "_n": numbers(line), "year": year(line), "title": trim_title(t)})
    step = step.withColumn("venue", venue(line, F.col("title")))
    step = step.withColumns({"volume": F.col("_n.volume"), "issue": F.col("_n.issue"), "page": F.col("_n.page")})
    step = step.withColumn("article_number", article_number(F.col("page")))
    return step.withColumn("authors", author_keys(F.col("_names"))).drop("_line", "_title", "_names", "_n")


def author_keys(names: Column) -> Column:
    """normalize_author of each name, without folding (names come from folded text), distinct in order."""

    def key(n: Column) -> Column:
        words = F.filter(F.split(n, r"\s+"), lambda w: F.length(w) > 1)
        plain = lambda x: F.regexp_replace(F.lower(x), rf"(?U)[^\w\u3040-\u30ff\u3400-\u9fff-]", "")
        joined = F.regexp_replace(n, r"\s+", "")
        return F.when(joined.rlike(rf"^{JAPANESE}+$"), F.substring(joined, 1, 2)).otherwise(plain(F.coalesce(F.try_element_at(words, F.lit(1)), n)))

    return F.array_distinct(F.filter(F.transform(names, key), lambda k: k != ""))

