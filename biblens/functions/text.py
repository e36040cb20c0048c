"""Normalisation of names, titles and venues as Column functions.

Only NFKC folding needs Python: Spark has no function for it. It is one Arrow-batched UDF that passes
ASCII through; everything else stays in generated code.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

JAPANESE = "[\\u3040-\\u30ff\\u3400-\\u9fff]"
_udfs: dict[str, object] = {}


def nfkc(c: Column) -> Column:
    """NFKC form; null stays null."""
    if "nfkc" not in _udfs:

        def fold(s: pd.Series) -> pd.Series:
            return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

        _udfs["nfkc"] = F.pandas_udf(fold, T.StringType())
    return _udfs["nfkc"](c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def plain_text(c: Column) -> Column:
    """normalize_text of text that is folded already."""
    return squeeze(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "))


def normalize_text(c: Column) -> Column:
    """NFKC, lower case, punctuation to blanks, blanks squeezed; word characters are Unicode ones."""
    return plain_text(nfkc(F.coalesce(c, F.lit(""))))


def folded(*columns: Column) -> list[Column]:
    """NFKC forms of several columns by one call, null as empty: they are folded as one joined text."""
    joined = nfkc(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in columns]))
    return [F.split(joined, "\x1f")[i] for i in range(len(columns))]


def normalize_venue(c: Column) -> Column:
    """normalize_text without the words of electronic editions; a bare "print" stays."""
    return plain_venue(nfkc(F.coalesce(c, F.lit(""))))


def plain_venue(c: Column) -> Column:
    """normalize_venue of text that is folded already."""
    bare = F.regexp_replace(F.lower(c), r"\[\s*(internet|online|electronic resource|print)\s*\]", " ")
    words = squeeze(F.regexp_replace(bare, r"(?U)[^\w\s]", " "))
    return squeeze(F.regexp_replace(words, r"(?U)\b(internet|online|electronic resource)\b", " "))


def normalize_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(nfkc(c))), rf"(?U)[^\w\u3040-\u30ff\u3400-\u9fff-]", "")


def normalize_author(c: Column) -> Column:
    """Family key: the first two characters of a Japanese name, "Last" of "Last, First", else the first
    word longer than one character, else the whole token."""
    whole = F.trim(nfkc(F.coalesce(c, F.lit(""))))
    words = F.filter(F.split(F.trim(F.regexp_replace(whole, r"\.", " ")), r"\s+"), lambda w: F.length(w) > 1)
    first = F.coalesce(F.try_element_at(words, F.lit(1)), whole)
    japanese = F.regexp_replace(whole, r"\s+", "")
    return (
        F.when(japanese.rlike(rf"^{JAPANESE}+$"), F.substring(japanese, 1, 2))
        .when(F.locate(",", whole) > 0, normalize_token(F.substring_index(whole, ",", 1)))
        .otherwise(F.when(normalize_token(first) != "", normalize_token(first)).otherwise(normalize_token(whole)))
    )


def plain_number(c: Column) -> Column:
    """normalize_number of text that is folded already."""
    return F.regexp_replace(plain_text(c), r"(?U)\W", "")


def normalize_number(c: Column) -> Column:
    """Letters and digits only: 361-76 is 36176."""
    return plain_number(nfkc(F.coalesce(c, F.lit(""))))


def path_quote(c: Column) -> Column:
    """Percent-encoding for a path: a blank is %20, slashes and tildes stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(c), r"\+", "%20"), "%2F", "/"), "%7E", "~"), r"\*", "%2A")


def query_quote(c: Column) -> Column:
    """Percent-encoding for a query: a blank is a plus."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(c), "%7E", "~"), r"\*", "%2A")


def escape_ticks(c: Column) -> Column:
    """Back ticks with a back slash before them, for inline code; null is empty."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("`"), F.lit("\\`"))


def lower_squeezed(c: Column) -> Column:
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def normalize_arxiv(c: Column) -> Column:
    """Title text without TeX: formulas dropped, commands unwrapped, punctuation dropped."""
    t = F.lower(nfkc(F.coalesce(c, F.lit(""))))
    t = F.regexp_replace(t, r"\$[^$]*\$", " ")
    t = F.regexp_replace(t, r"\\[a-z]+\{([^}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\[a-z]+", " ")
    return squeeze(F.regexp_replace(t, r"(?U)[^\w\s]", ""))


def normalize_japanese_query(c: Column) -> Column:
    """Blanks squeezed, and removed between two Japanese characters."""
    return F.regexp_replace(squeeze(c), rf"(?<={JAPANESE}) (?={JAPANESE})", "")


def strip_version(c: Column) -> Column:
    """An arXiv id without its version."""
    return F.regexp_replace(c, r"v\d+$", "")


def contains_japanese(c: Column) -> Column:
    return F.coalesce(c.rlike(JAPANESE), F.lit(False))


def reference_line(c: Column) -> Column:
    """A line before parsing: NFKC, full-width punctuation to ASCII, blanks between Japanese characters out."""
    t = F.translate(nfkc(F.coalesce(c, F.lit(""))), "．，：；（）", ".,:;()")
    t = F.regexp_replace(t, "・", " ・ ")
    t = F.regexp_replace(t, rf"(?<={JAPANESE})\s+(?={JAPANESE})", "")
    return squeeze(t)


def tokens(c: Column) -> Column:
    """Distinct words of normalised text longer than one character."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 1))


def nullif_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)
