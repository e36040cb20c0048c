"""Text and BibTeX sources: pasted text to one citation a row."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Link labels that are no references, and entry types that mark BibTeX.
LABELS = ("article", "pubmed", "pubmed central", "google scholar", "cas", "references")
ENTRY_TYPES = (
    "article", "book", "inproceedings", "incollection", "conference", "phdthesis", "mastersthesis",
    "techreport", "misc", "unpublished", "proceedings", "inbook", "manual", "booklet",
)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (source_doc, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_doc"), F.col("value").alias("text"))


def from_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("inline", text)], "source_doc string, text string")


def from_stdin(spark: SparkSession) -> DataFrame:
    """Text from standard input; exit code 2 with a usage line if nothing is piped in."""
    if sys.stdin.isatty():
        print("usage: give --input-file, --text, or text on standard input", file=sys.stderr)
        raise SystemExit(2)
    return from_text(spark, sys.stdin.read())


def is_bibtex(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)@\s*(" + "|".join(ENTRY_TYPES) + r")\s*\{"), F.lit(False))


def split_references(docs: DataFrame, id_col: str = "source_doc", text_col: str = "text") -> DataFrame:
    """(id, line_no, input_text): lines trimmed, blanks and link labels dropped, one leading marker stripped.

    ``line_no`` is the place of the line in the text. A line that was only a marker stays as empty text.
    """
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"\R|[\x1c-\x1e]")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).filter("line <> ''")
    lines = lines.filter(~F.lower("line").isin(*LABELS))
    return lines.select(id_col, "line_no", F.trim(F.regexp_replace("line", r"^(\[\d+\]|\d+[.)])\s*", "")).alias("input_text"))


def bibtex_entries(text: str) -> Iterator[dict[str, str]]:
    """Entries with lower-cased field names; brace counting, so that values may nest. @comment, @string
    and @preamble are skipped; an entry that never closes ends with the text."""
    at = 0
    while (m := re.compile(r"@\s*([A-Za-z]+)\s*([{(])").search(text, at)) is not None:
        kind, i, depth = m[1].lower(), m.end(), 1
        while i < len(text) and depth:
            depth += {"{": 1, "(": m[2] == "(", "}": -1, ")": -(m[2] == "(")}.get(text[i], 0)
            i += 1
        body, at = text[m.end() : i - 1 if not depth else i], i
        if kind in ("comment", "string", "preamble"):
            continue
        entry, parts, depth, quoted, start = {"entrytype": kind}, [], 0, False, 0
        for k, c in enumerate(body):
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            elif c == '"' and not depth:
                quoted = not quoted
            elif c == "," and not depth and not quoted:
                parts.append(body[start:k])
                start = k + 1
        parts.append(body[start:])
        entry["id"] = parts[0].strip()
        for part in parts[1:]:
            name, eq, value = part.partition("=")
            if eq:
                value = value.strip()
                if len(value) > 1 and (value[0], value[-1]) in (("{", "}"), ('"', '"')):
                    value = value[1:-1]
                entry[name.strip().lower()] = re.sub(r"\s+", " ", value).strip()
        yield entry


def bibtex_table(docs: DataFrame, id_col: str = "source_doc", text_col: str = "text") -> DataFrame:
    """(id, line_no, fields): one row an entry, fields as a map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, list(e.items())) for i, t in zip(b[id_col], b[text_col], strict=True) for n, e in enumerate(bibtex_entries(t or ""))]
            yield pd.DataFrame(rows, columns=[id_col, "line_no", "fields"]).assign(fields=lambda d: d["fields"].map(dict))

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, line_no int, fields map<string,string>")


def short_authors(c: Column) -> Column:
    """Family names of "A and B", joined by commas."""
    parts = F.filter(F.transform(F.split(c, " and "), lambda x: F.trim(x)), lambda x: x != "")
    last = F.transform(parts, lambda x: F.when(F.contains(x, F.lit(",")), F.trim(F.substring_index(x, ",", 1))).otherwise(F.element_at(F.split(x, r"\s+"), -1)))
    return F.array_join(last, ", ")


def entry_text(fields: Column) -> Column:
    """A citation line: authors, year, title, journal or book title, DOI, arXiv id; what is absent is left out."""
    get = lambda k: F.when(F.trim(fields[k]) != "", F.trim(fields[k]))
    doi = F.concat(F.lit("DOI: "), get("doi"))
    arxiv = F.when(F.contains(F.lower(fields["archiveprefix"]), F.lit("arxiv")), F.concat(F.lit("arXiv:"), get("eprint")))
    authors = short_authors(get("author"))
    return F.concat_ws(". ", F.when(authors != "", authors), get("year"), F.regexp_replace(get("title"), "[{}]", ""), F.coalesce(get("journal"), get("booktitle")), doi, arxiv)


def load_references(docs: DataFrame, id_col: str = "source_doc", text_col: str = "text") -> DataFrame:
    """(id, line_no, input_text) of texts that are either BibTeX or plain lines."""
    bib = is_bibtex(F.col(text_col))
    entries = bibtex_table(docs.filter(bib), id_col, text_col)
    cited = entries.select(id_col, "line_no", entry_text(F.col("fields")).alias("input_text")).filter("trim(input_text) <> ''")
    return split_references(docs.filter(~bib), id_col, text_col).unionByName(cited)


# -- the dialect of the interactive page: its own braces, fields and authors -----------------------

#: What the page counts as white space around a value.
PAGE_SPACE = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_PAGE_ENTRY = re.compile(r"@[{0}]*(?:{1})[{0}]*\{{".format(PAGE_SPACE, "|".join(ENTRY_TYPES)), re.I)
_PAGE_FIELD = re.compile(rf"([A-Za-z0-9_]+)[{PAGE_SPACE}]*=[{PAGE_SPACE}]*")
_PAGE_AND = re.compile(rf"[{PAGE_SPACE}]+and[{PAGE_SPACE}]+", re.I)


def _partners(text: str) -> dict[int, int]:
    """The place of the closing brace of each opening one that has one."""
    open_, out = [], {}
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def page_entries(text: str) -> Iterator[dict[str, str]]:
    """The fields of each entry of a listed type, as the interactive page reads them.

    It differs from ``bibtex_entries``: braces count inside quotes, a quoted value ends at the next quote, what looks like a field
    inside a value is one too (the last of a name holds), an entry inside an entry is one more, blanks inside values
    stay, all braces go, and what is never closed loses its last character.
    """
    closing = _partners(text)

    def inside(opening: int, limit: int) -> int:
        end = closing.get(opening, limit)
        return max(opening + 1, end if end < limit else limit - 1)

    for entry in _PAGE_ENTRY.finditer(text):
        end, fields = inside(entry.end() - 1, len(text)), {}
        for field in _PAGE_FIELD.finditer(text, entry.end(), end):
            at = field.end()
            first = text[at] if at < end else ""
            if first == "{":
                value = text[at + 1 : inside(at, end)]
            elif first == '"':
                value = text[at + 1 : max(at + 1, text.find('"', at + 1, end))]
            else:
                value = re.compile("[^,}]*").match(text, at, end)[0]
            fields[field[1].lower()] = value.replace("{", "").replace("}", "").strip(PAGE_SPACE)
        yield fields


def page_line(fields: dict[str, str]) -> str:
    """The citation that the page makes of an entry: like ``entry_text``, but with its authors, and arXiv ids only of that very prefix."""
    said = lambda k: fields.get(k, "")
    names = [n.strip(PAGE_SPACE) for n in _PAGE_AND.split(said("author"))]
    last = [n.split(",")[0].strip(PAGE_SPACE) if "," in n else re.split(f"[{PAGE_SPACE}]+", n)[-1] for n in names]
    arxiv = said("eprint") and said("archiveprefix").lower() == "arxiv"
    parts = [said("author") and ", ".join(last), said("year"), said("title"), said("journal") or said("booktitle"), said("doi") and f"DOI: {said('doi')}", arxiv and f"arXiv:{said('eprint')}"]
    # authors count where the field says anything, even if no name is left of it
    return ". ".join(p for i, p in enumerate(parts) if p or (i == 0 and said("author")))


@F.udtf(returnType="line_no int, fields map<string,string>, input_text string")
class PageBibtex:
    """A table function: the entries of a BibTeX text in the page's dialect."""

    def eval(self, text: str):
        for n, fields in enumerate(page_entries(text or "")):
            yield n, fields, page_line(fields)


def page_references(docs: DataFrame, id_col: str = "source_doc", text_col: str = "text") -> DataFrame:
    """(id, line_no, input_text) of texts as the interactive page splits them: BibTeX in its dialect, or lines, which end only at line feeds."""
    bib = is_bibtex(F.col(text_col))
    entries = docs.filter(bib).select(id_col, text_col).lateralJoin(PageBibtex(F.col(text_col).outer()))
    cited = entries.select(id_col, "line_no", "input_text").filter("input_text <> ''")
    trim = lambda c: F.regexp_replace(c, rf"^[{PAGE_SPACE}]+|[{PAGE_SPACE}]+$", "")
    lines = docs.filter(~bib).select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"\r?\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", trim(F.col("line"))).filter((F.col("line") != "") & ~F.lower("line").isin(*LABELS))
    return lines.select(id_col, "line_no", trim(F.regexp_replace("line", r"^(\[\d+\]|\d+[.)])", "")).alias("input_text")).unionByName(cited)
