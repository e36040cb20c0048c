"""Main text against Python's own HTML parser, on the given pages; names of classes inside an article."""

import random
import re
from html.parser import HTMLParser

import pytest

from biblens.llm import html_extract as H

SKIP = {"head", "nav", "aside", "footer", "form", "script", "style", "button"}
BREAKS = {"p", "h1", "h2", "h3", "h4", "br", "li", "ul", "ol", "div", "section", "blockquote", "pre", "table", "tr", "td", "article", "header"}


class Plain(HTMLParser):
    """Text of the blocks inside article elements, without parts that are no content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.part, self.inside, self.skipped = [], [], 0, []

    def flush(self):
        text = " ".join("".join(self.part).split())
        if text:
            self.blocks.append(text)
        self.part = []

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            self.skipped.append(tag) if tag == self.skipped[0] else None
        elif tag in SKIP or dict(attrs).get("class") in ("ad", "comments", "comment"):
            self.flush()
            self.skipped.append(tag)
        elif tag in BREAKS:
            self.flush()
            self.inside += tag == "article"

    def handle_endtag(self, tag):
        if self.skipped:
            if tag == self.skipped[0]:
                self.skipped.pop()
        elif tag in BREAKS:
            self.flush()
            self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.part.append(data)


def plain(page):
    parser = Plain()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return " ".join(parser.blocks)


def test_equals_a_plain_reading_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()} and all(want.values())


@pytest.mark.parametrize("name", ["post-comment-policy", "comments-on-policy", "section-search-results", "ad-hoc", "lead", "share-prices"])
def test_no_part_of_a_class_name_deletes_a_paragraph_of_the_article(name):
    text = "A paragraph of some length that belongs to the article."
    page = f"<nav>Menu</nav><article><h1>Title</h1><p>{text}</p><p class='{name}'>{text}</p><p id='{name}'>Short one.</p><p>{text}</p></article>"
    assert H.main_text(page) == f"Title {text} {text} Short one. {text}"


@pytest.mark.parametrize("name", ["comment", "ad", "comments reader"])
def test_whole_names_still_do(name):
    page = f"<article><p>{'word ' * 40}</p><p class='{name}'>Not part of it.</p><div class='post-comments'><p>Nor this.</p></div></article>"
    assert H.main_text(page) == ("word " * 40).strip()


def stripped(page):
    """The page without articles, classes and ids."""
    return re.sub(r"<(/?)article\b", r"<\1div", re.sub(r'\s(?:class|id)="[^"]*"', "", page))


def test_distribution_decides_without_marks(spark):
    """Without any article, class or id the text is the same on nine pages of ten at least; other windows and thresholds change it."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    want = [plain(p) for p in pages]
    bare = [stripped(p) for p in pages]
    equal = {x: sum(H.main_text(p, *x) == w for p, w in zip(bare, want, strict=True)) for x in [(H.WINDOW, H.SURGE), (H.WINDOW, 0), (H.WINDOW, 50), (1, H.SURGE), (20, H.SURGE)]}
    best = equal.pop((H.WINDOW, H.SURGE))
    assert best >= 0.9 * len(pages) and all(n < 0.6 * len(pages) for n in equal.values())
    assert sum(H.main_text(p, 1) != w for p, w in zip(pages, want, strict=True)) > 0


def test_kept_lines_by_plain_sums():
    """Pages of unmarked paragraphs in any arrangement: kept are the stretches whose windowed sum passes, and what lies between."""
    r = random.Random(8)
    for _ in range(300):
        lines = [H.Line("x" * n, n, False, 1.0, False) for n in (r.choice([0, 0, 0, 10, 60, 400]) for _ in range(r.randint(1, 40)))]
        w = [n.plain for n in lines]
        level = max(H.SURGE, H.PEAK * max(sum(w[max(0, i - 1) : i + 1]) for i in range(len(w))))
        runs, now = [], []  # with a window of two, one empty line joins and two part
        for i, x in enumerate(w):
            if x and now and i - now[-1] > 2:
                runs.append(now)
                now = []
            now += [i] if x else []
        runs += [now] if now else []
        passes = [max(sum(w[max(run[0], i - 1) : i + 1]) for i in range(run[0], run[-1] + 1)) > level for run in runs]
        if runs and not any(passes):
            totals = [sum(w[i] for i in run) for run in runs]
            passes[totals.index(max(totals))] = True
        at = [k for k, p in enumerate(passes) if p]
        want = {i for k, run in enumerate(runs) if at and at[0] <= k <= at[-1] for i in run}
        assert {i for i, k in enumerate(H.kept_lines(lines)) if k and w[i]} == want


def test_parts_that_names_tell_against():
    """They weigh less but not nothing; where nothing else is left they are no text, and an open paragraph under a name ends at the next."""
    text = "word " * 40
    assert H.main_text("<div class=ad>Buy this</div>") == "" and H.main_text("<nav>Menu</nav><div id=comments><p>Nice</p></div>") == ""
    page = f"<article><p>{text}</p><p class=comment>Not this.<p>But this.</p><ul><li class=ad>Nor this<li>And this</ul></article>"
    assert H.main_text(page) == f"{text.strip()} But this. And this"
    long = "an essay that a careless class hides " * 100
    assert H.main_text(f"<div class=comments><p>{long}</p></div><div><p>{text}</p></div>") == f"{long.strip()} {text.strip()}"


def test_parts_of_an_article_are_one_text():
    """Containers inside a marked article do not part its short lines from the long ones."""
    text = "word " * 40
    page = f"<article><div><div><p>Lead.</p></div></div><section><div><p>{text}</p></div></section><div class=ad>Buy</div><section><div><p>End.</p></div></section></article>"
    assert H.main_text(page) == f"Lead. {text.strip()} End."
