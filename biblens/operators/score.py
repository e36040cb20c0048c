"""Scores, field states and decisions of (reference, candidate) pairs.

Pairs carry a record in each of the struct columns ``r`` and ``c``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblens.functions import similarity as S
from biblens.functions.text import folded, nullif_blank, plain_number, plain_text, plain_venue

# Weights of the signals, thresholds and marks of preprints.
WEIGHTS = {"title": 0.30, "authors": 0.20, "first_author": 0.10, "year": 0.10, "venue": 0.10, "volume_issue": 0.08, "pages": 0.12}
ACCEPT, SUGGEST, LOOSE_ACCEPT = 0.74, 0.45, 0.68
AUTHOR_ACCEPT, AUTHOR_SUGGEST, TITLE_ACCEPT, TITLE_SUGGEST = 0.5, 0.25, 0.72, 0.45
PREPRINT_PENALTY = 0.1
PREPRINT_MARKS = ("arxiv", "preprints", "biorxiv", "medrxiv")
# What field diffs give as reasons.
MISSING_IN_REFERENCE, MISSING_IN_CANDIDATE = "入力に記載なし", "Crossref から取得できず"
YEAR_APART = "1年ずれ（オンライン公開／印刷年の差の可能性）"
VENUE_SHORT, VENUE_OTHER, VENUE_MAYBE_SHORT = "正式誌名・略誌名の差として許容", "論文自体は一致。掲載誌名だけ別表記の可能性", "略記の可能性。許容するか確認"


def preprint_like(c: str = "c") -> Column:
    out = F.coalesce(F.col(f"{c}.is_preprint"), F.lit(False))
    for f in ("source", "venue", "title"):
        for mark in PREPRINT_MARKS:
            out = out | F.contains(F.lower(F.coalesce(F.col(f"{c}.{f}"), F.lit(""))), F.lit(mark))
    return out


def short_state(score: Column, known: Column) -> Column:
    """ok, ~ or x by the thresholds .7 and .35, or ? where a side says nothing."""
    return F.when(~known, "?").when(score >= 0.7, "ok").when(score >= 0.35, "~").otherwise("x")


#: Fields whose normal forms pairs are compared by.
NORMAL = ("title", "venue", "volume", "issue", "page", "article_number")
SIGNALS = tuple(WEIGHTS)


def with_normal(rows: DataFrame, side: str) -> DataFrame:
    """The record in column ``side`` with a field ``n``: normal forms of its texts, folded by one call.

    Done on references and works before they are paired, it is done once for each of them.
    """
    if "n" in rows.schema[side].dataType.names:
        return rows
    title, venue, *numbers = folded(*[F.col(f"{side}.{f}") for f in NORMAL])
    forms = [plain_text(title), plain_venue(venue), *[plain_number(x) for x in numbers]]
    return rows.withColumn("_n", F.struct(*[v.alias(f) for f, v in zip(NORMAL, forms, strict=True)])).withColumn(side, F.col(side).withField("n", F.col("_n"))).drop("_n")


def _plain_signals() -> dict[str, Column]:
    """The signals of pairs with normal forms that take no sequence ratio."""
    r, c = (lambda f: F.col(f"r.{f}")), (lambda f: F.col(f"c.{f}"))
    mine, theirs = (lambda f: F.col(f"r.n.{f}")), (lambda f: F.col(f"c.n.{f}"))
    return {
        "authors": S.author_overlap(r("authors"), c("authors")),
        "first_author": S.first_author_match(r("authors"), c("authors")),
        "year": S.year_similarity(r("year"), c("year")),
        "volume_issue": S.volume_issue_similarity(mine("volume"), mine("issue"), theirs("volume"), theirs("issue")),
        "pages": S.page_similarity(mine("page"), mine("article_number"), theirs("page"), theirs("article_number")),
    }


def signals(pairs: DataFrame, sequence: bool = True) -> DataFrame:
    """The seven signals as columns s_<name>, and venue_kind. Without ``sequence`` the Ratcliff-Obershelp
    ratio is left out of title and venue.

    They are columns of their own, not a struct: the planner writes the fields of a struct out again
    wherever they are used.
    """
    step = with_normal(with_normal(pairs, "r"), "c")
    r, c = (lambda f: F.col(f"r.{f}")), (lambda f: F.col(f"c.{f}"))
    mine, theirs = (lambda f: F.col(f"r.n.{f}")), (lambda f: F.col(f"c.n.{f}"))
    words = S.token_overlap(mine("title"), theirs("title"))
    if sequence:
        title = S.round3(F.greatest(words, S.sequence_similarity(mine("title"), theirs("title"))))
        venue = S.venue_analysis(F.array(r("venue")), F.concat(F.array(c("venue")), F.coalesce("c.venue_aliases", F.array().cast("array<string>"))))
    else:
        title = S.round3(words)
        a, b = mine("venue"), theirs("venue")
        same = (a != "") & (a == b)
        short = S.looks_like_abbreviation(a, b) | S.looks_like_abbreviation(b, a)
        value = F.when(same, 1.0).when(short, S.ABBREVIATED).otherwise(S.round3(S.token_overlap(a, b)))
        venue = F.struct(value.alias("score"), F.when(same, "exact").when(short, "abbrev").otherwise("similar").alias("kind"))
    step = step.withColumns(
        {
            "s_title": F.when((mine("title") != "") & (theirs("title") != ""), title).otherwise(F.lit(0.0)),
            "_venue": venue,
        }
        | {f"s_{f}": v for f, v in _plain_signals().items()}
    )
    return step.withColumns({"s_venue": F.col("_venue.score"), "venue_kind": F.col("_venue.kind")}).drop("_venue")


def _total(preprint: Column, value: Callable[[str], Column]) -> Column:
    raw = sum((F.lit(w) * value(f) for f, w in WEIGHTS.items()), F.lit(0.0))
    return S.round3(F.greatest(raw - F.when(preprint, PREPRINT_PENALTY).otherwise(0.0), F.lit(0.0)))


def _accepted(total: Column, preprint: Column, value: Callable[[str], Column], strict: bool) -> Column:
    accept, title, author = (ACCEPT, TITLE_ACCEPT, AUTHOR_ACCEPT) if strict else (LOOSE_ACCEPT, TITLE_SUGGEST, AUTHOR_SUGGEST)
    years = F.col("r.year").isNotNull() & F.col("c.year").isNotNull() & (value("year") == 0)
    return (total >= accept) & (value("title") >= title) & ((value("first_author") == 1) | (value("authors") >= author)) & ~years & ~preprint


def contenders(pairs: DataFrame, key: str = "ref_id", strict: bool = True) -> DataFrame:
    """pairs without those that another one of their reference surely comes before, and is surely accepted: of such a reference
    nothing is told but its first pair.

    Titles and venues take the sequence ratio, which costs most of a score. Their words, equal names and the other signals bound the total
    from both sides without it: a total grows with each signal, and rounding keeps the order. Only pairs whose most is less than the least
    of a sure one go, so the first pair, its total and all of a reference without a sure one stay as they are.
    """
    step = with_normal(with_normal(pairs, "r"), "c")
    step = step.withColumns({f"_{f}": v for f, v in _plain_signals().items()} | {"_words": S.round3(S.token_overlap(F.col("r.n.title"), F.col("c.n.title"))), "_preprint": preprint_like()})
    same = F.coalesce((F.col("r.venue") == F.col("c.venue")) & F.col("c.n.venue").rlike("[a-z0-9]"), F.lit(False))
    least = {"title": F.col("_words"), "venue": F.when(same, F.lit(1.0)).otherwise(F.lit(0.0))}
    low, high = (lambda f: least.get(f, F.col(f"_{f}"))), (lambda f: F.lit(1.0) if f in least else F.col(f"_{f}"))
    step = step.withColumns({"_low": _total(F.col("_preprint"), low), "_high": _total(F.col("_preprint"), high)})
    sure = F.when(_accepted(F.col("_low"), F.col("_preprint"), low, strict), F.col("_low"))
    step = step.withColumn("_sure", F.max(sure).over(Window.partitionBy(key)))
    return step.filter(F.col("_sure").isNull() | (F.col("_high") >= F.col("_sure"))).select(*pairs.columns)


def decide_pairs(pairs: DataFrame, sequence: bool = True, strict: bool = True) -> DataFrame:
    """pairs with signals, total, support, decision and note: all that ranks them and decides."""
    s = lambda f: F.col(f"s_{f}")
    step = signals(pairs, sequence).withColumn("preprint_like", preprint_like())
    thresholds = (("title", TITLE_SUGGEST), ("authors", AUTHOR_SUGGEST), ("first_author", 1.0), ("year", 0.7), ("venue", 0.6), ("pages", 0.8), ("volume_issue", 0.7))
    support = sum(((s(f) >= t).cast("int") for f, t in thresholds), F.lit(0))
    step = step.withColumns({"total": _total(F.col("preprint_like"), s), "support": support})
    accepted = _accepted(F.col("total"), F.col("preprint_like"), s, strict)
    suggested = (F.col("total") >= SUGGEST) & (F.col("support") >= 2)
    step = step.withColumn("decision", F.when(accepted, "accept").when(suggested, "suggest").otherwise("reject"))
    note = F.when(F.col("preprint_like"), "preprint_only").when(F.col("decision") == "suggest", "candidate_mismatch")
    return step.withColumn("note", note)


def score(pairs: DataFrame, sequence: bool = True, strict: bool = True) -> DataFrame:
    """pairs with signals, total, decision, note, field_diffs and summary."""
    return with_diffs(decide_pairs(pairs, sequence, strict))


def strong_identity() -> Column:
    s = lambda f: F.col(f"s_{f}")
    unknown = F.col("r.year").isNull() | F.col("c.year").isNull()
    return (s("title") >= TITLE_ACCEPT) & (s("authors") >= AUTHOR_ACCEPT) & (unknown | (s("year") >= 0.7))


def alias_gate() -> Column:
    """Whether a candidate's venue aliases are worth looking up."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return has(F.col("r.venue")) & has(F.col("c.venue")) & ~F.coalesce("c.aliases_resolved", F.lit(False)) & (F.col("total") >= 0.35) & (F.col("s_venue") < 1)


def display_authors(a: Column) -> Column:
    return nullif_blank(F.concat(F.array_join(F.slice(a, 1, 3), ", "), F.when(F.size(a) > 3, ", et al.").otherwise("")))


def display_pages(rec: str) -> Column:
    v, i, p = (nullif_blank(F.col(f"{rec}.{f}")) for f in ("volume", "issue", "page"))
    head = F.concat(F.coalesce(v, F.lit("")), F.coalesce(F.concat(F.lit("("), i, F.lit(")")), F.lit("")))
    return nullif_blank(F.concat(head, F.when((head != "") & p.isNotNull(), ": ").otherwise(""), F.coalesce(p, F.coalesce(F.col(f"{rec}.article_number"), F.lit("")))))


def _diff(name: str, mine: Column, theirs: Column, value: Column) -> Column:
    missing = F.when(mine.isNull() & theirs.isNull(), "missing_both").when(mine.isNull(), "missing_input").when(theirs.isNull(), "missing_candidate")
    reason = F.when(mine.isNull() & theirs.isNotNull(), MISSING_IN_REFERENCE).when(mine.isNotNull() & theirs.isNull(), MISSING_IN_CANDIDATE)
    high, both = value >= 0.7, mine.isNotNull() & theirs.isNotNull()
    state = F.when(high, "ok")
    if name == "year":
        state = F.when(high & (mine != theirs), "near").when(high, "ok")
        reason = reason.when(both & high & (mine != theirs), YEAR_APART)
    elif name == "venue":
        # below the threshold the shown names may abbreviate each other, though some variants are nearer
        told, strong = F.col("venue_kind") == "abbrev", strong_identity()
        a, b = F.col("r.n.venue"), F.col("c.n.venue")
        short = told | S.looks_like_abbreviation(a, b) | S.looks_like_abbreviation(b, a)
        other = strong & (a != b) & ~F.col("venue_kind").isin("alias", "exact")
        state = F.when(high & told, "ok").when(high & other, "unverified").when(high, "ok").when(short, "abbrev").when(strong, "unverified")
        why = F.when(high & told, VENUE_SHORT).when(high & other, VENUE_OTHER).when(high, None).when(short, VENUE_MAYBE_SHORT).when(strong, VENUE_OTHER)
        reason = reason.when(both, why)
    state = F.coalesce(missing, state, F.when(value >= 0.35, "near"), F.lit("mismatch"))
    return F.struct(F.lit(name).alias("field"), state.alias("state"), mine.alias("input_value"), theirs.alias("candidate_value"), reason.alias("reason"), value.alias("score"))


#: The fields of a summary, in order.
FIELDS = ("title", "authors", "year", "venue", "pages")


def field_states() -> dict[str, Column]:
    """The short state of each field: ? unless both sides say something."""
    s = lambda f: F.col(f"s_{f}")
    said = lambda *names: reduce(or_, [F.coalesce(F.col(n).cast("string") != "", F.lit(False)) for n in names])
    some = lambda n: F.coalesce(F.size(n) > 0, F.lit(False))
    place = lambda side: said(*[f"{side}.{f}" for f in ("volume", "issue", "page", "article_number")])
    values = {"title": s("title"), "authors": F.greatest(s("authors"), s("first_author")), "year": s("year"), "venue": s("venue"), "pages": F.greatest(s("volume_issue"), s("pages"))}
    known = {f: said(f"r.{f}") & said(f"c.{f}") for f in ("title", "year", "venue")} | {"authors": some("r.authors") & some("c.authors"), "pages": place("r") & place("c")}
    return {f: short_state(values[f], known[f]) for f in FIELDS}


def summary() -> Column:
    """ "title s / authors s / ..." in short states."""
    return F.concat_ws(" / ", *[F.concat(F.lit(f"{f} "), state) for f, state in field_states().items()])


def with_diffs(scored: DataFrame) -> DataFrame:
    """field_diffs (array of struct, fixed order), field_states, the summary, and the signals as a struct."""
    s = lambda f: F.col(f"s_{f}")
    author, pages = F.greatest(s("authors"), s("first_author")), F.greatest(s("volume_issue"), s("pages"))
    diffs = F.array(
        _diff("title", nullif_blank(F.col("r.title")), nullif_blank(F.col("c.title")), s("title")),
        _diff("authors", display_authors(F.col("r.authors")), display_authors(F.col("c.authors")), author),
        _diff("year", F.col("r.year").cast("string"), F.col("c.year").cast("string"), s("year")),
        _diff("venue", nullif_blank(F.col("r.venue")), nullif_blank(F.col("c.venue")), s("venue")),
        _diff("pages", display_pages("r"), display_pages("c"), pages),
    )
    states = F.create_map(*[x for f, state in field_states().items() for x in (F.lit(f), state)])
    return scored.withColumns({"field_diffs": diffs, "field_states": states, "summary": summary(), "signals": F.struct(*[s(f).alias(f) for f in SIGNALS])})
