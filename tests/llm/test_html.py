"""Main text of pages whose truth is known, by the distribution of text over lines; broken, odd and long pages."""

import html
import random
import time

import pytest

from biblens.llm import html_extract as H
from biblens.llm.queries import op1_html_extract

WORDS = "river stone quiet market window letter garden morning traveller bridge harvest lantern".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f"<li><a href='/{i}'>{prose(r, 3)}</a></li>" for i in range(n)) + "</ul>"


def test_marked_page():
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies on this page</div><article><h1>Head &amp; more</h1><p><b>One<br>two\n  three<p>A<i>b</i>c.</p><aside>side</aside></article><div id="comments"><p>Nice!</p></div><form>Mail <input></form><footer>end</footer>'
    assert H.main_text(page) == "Head & more One two three Abc."


def test_lengths_decide_without_article():
    """A closing paragraph after an advert stays, a block of short lines and links goes."""
    body, close = "long text of the page " * 240, "closing words of it " * 10
    page = f"<div><p>{body}</p></div><div class=ad>Buy</div><div><p>{close}</p></div><div><div><ul><li><a href=x>{'more of this site ' * 9}</a><li>Imprint</ul></div></div>"
    assert H.main_text(page) == f"{body.strip()} {close.strip()}"
    plain = "<div id='top-menu'>Home</div><div><p>" + "long text " * 30 + "</p><p>tail</p></div><div class=sidebar>Links</div>"
    assert H.main_text(plain) == ("long text " * 30).strip() + " tail"
    assert H.main_text("<p>few words") == "few words" and H.main_text("<a href=x>one link</a>") == "one link"


@pytest.mark.parametrize("marked", [True, False])
def test_pages_without_telling_names(marked):
    """Random pages of plain containers: link lists, a short site line and a short closing line around the text."""
    decided = 0
    for seed in range(200):
        r = random.Random(seed)
        head, paragraphs = prose(r, 5), [prose(r, r.randint(15, 80)) for _ in range(r.randint(1, 9))]
        short = prose(r, 4)
        paragraphs.insert(r.randint(1, len(paragraphs)), short)
        body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
        if r.random() < 0.5:
            body += f"</div><div><div>{links(r, 8)}</div>"
        middle = f"<div><h1>{head}</h1></div><div><div>{body}</div></div>"
        page = f"<body><div><div>{prose(r, 3)}</div></div><div><div>{links(r, 6)}</div></div>{'<article>' if marked else '<div>'}{middle}{'</article>' if marked else '</div>'}<div><div>{links(r, 5)}</div></div><div><div><p>&copy; {prose(r, 4)}</p></div></div></body>"
        lines = H.page_lines(page)
        decided += sum(n.text != "" for n in lines) > sum(H.kept_lines(lines))
        assert H.main_text(page) == " ".join([head, *paragraphs]), seed
    assert decided == 200


def test_teasers_do_not_pass_for_the_article():
    r = random.Random(3)
    text = [prose(r, 60) for _ in range(6)]
    teaser = "".join(f"<article><a href=x>{prose(r, 4)}</a></article>" for _ in range(4))
    page = f"<body><div>{teaser}</div><div><div>{''.join(f'<p>{t}</p>' for t in text)}</div></div>"
    assert H.main_text(page) == " ".join(text)


def test_link_lists_inside_the_article_go():
    r = random.Random(4)
    a, b = prose(r, 40), prose(r, 40)
    page = f"<article><p>{a}</p>{links(r, 6)}<p>{b} <a href=x>see</a></p></article>"
    assert H.main_text(page) == f"{a} {b} see"


def test_weak_hints():
    """Names that only hint: short text under them goes, long prose stays. Clear names go whatever their length."""
    r = random.Random(5)
    text, long, note = prose(r, 60), prose(r, 90), prose(r, 8)
    page = "<article><p>{}</p><div class='{}'><p>{}</p></div><p>{}</p></article>"
    assert H.main_text(page.format(text, "notice", note, text)) == f"{text} {text}"
    assert H.main_text(page.format(text, "shared-search tags", long, text)) == f"{text} {long} {text}"
    assert H.main_text(page.format(text, "reader-comments", long, text)) == f"{text} {text}"
    assert H.main_text(page.format(text, "post-body", note, text)) == f"{text} {note} {text}"


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>x") == H.main_text("<!-- <p>x") == ""
    assert H.main_text("<p>a<b>b<i>c</b>d</i>e") == "abcde"
    assert H.main_text("<div><p>one</div>two</p><article>x</div></article>") in ("one two x", "x", "one two")
    assert H.main_text("x < y & z &lt;b&gt; &#233;") == "x < y & z <b> é"
    assert H.main_text("<<>>") == "<<>>" and H.main_text("plain text without any tag") == "plain text without any tag"
    assert H.main_text("<p>text <a") == "text" and H.main_text("<p>text <a href='") == "text"


@pytest.mark.parametrize("unit", ["<noscript>", "<a '", "<p>word ", "<div class=share>", "<article>", "<ul><li><a href=x>y</a>", "<", "&", "<!--"])
def test_time_is_linear(unit):
    took = []
    for n in (20_000, 160_000):
        page = unit * n
        began = time.perf_counter()
        H.main_text(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * max(took[0], 0.02)


def test_windowed_sums():
    r = random.Random(6)
    for _ in range(200):
        w = [float(r.choice([0, 0, 0, 0, 5, 40])) for _ in range(r.randint(0, 30))]
        got = H.stretches(w, 3)
        zero = [sum(w[max(0, i - 2) : i + 1]) == 0 for i in range(len(w))]
        for a, b, high in got:
            assert w[a] > 0 < w[b - 1] and not any(zero[a:b])
            assert high == max(sum(w[max(0, i - 2) : i + 1]) for i in range(a, b))
        assert sum(sum(w[a:b]) for a, b, _ in got) == sum(w)
        assert all(any(zero[x[1] : y[0]]) or y[0] - x[1] >= 3 for x, y in zip(got, got[1:], strict=False))


def test_registered_query(spark, tmp_path):
    rows = [(1, "u", None, "t"), (1, "u", "<p>x", "t"), (1, "u", "<p>x", "t"), (None, None, "<p>" + "long words " * 40_000, "t"), (2, "v", "", "t")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    out = op1_html_extract(spark, str(tmp_path))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r["page_id"] or 0, r["n_chars"], r["text"]) for r in out.collect())
    assert [(i, n) for i, n, _ in got] == [(0, 439_999), (1, 0), (1, 1), (1, 1), (2, 0)] and all(len(t) == n for _, n, t in got)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
