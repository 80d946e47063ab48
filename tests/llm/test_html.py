from __future__ import annotations

import html as entities
import re

import pytest
from pyspark.sql import functions as F

from lumenlake.llm import html
from lumenlake.llm.queries import op7_html
from tests.conftest import SF
from tests.llm.brute import rows_of


def article(page: str) -> str:
    """The pages of the test tables have one article element each."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(entities.unescape(re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner).replace("<b>", "")).split())


def test_query_against_the_articles(spark):
    rows = {r["page_id"]: r for r in op7_html(spark, SF).collect()}
    for page_id, url, page in rows_of("pages", SF, "page_id, url, html"):
        assert rows[page_id]["text"] == article(page)
        assert rows[page_id]["n_chars"] == len(article(page)) and rows[page_id]["url"] == url


BODY = "<p>" + "word " * 60 + "</p>"
CLEAN = ("word " * 60).strip()


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("a &amp; b&nbsp;&#233;", "a & b é"), ("x<b>y</b>z<br>w", "xyz w"),
    (f"<nav>n</nav><div class='post-12'>{BODY}</div><aside>s</aside><footer>f</footer>", CLEAN),
    (f"<div id=sidebar><p>s</div><main>{BODY}<form>f</form></main><div class=comments>c</div>", CLEAN),
    (f"<script>var a='</p><p>x'</script><style>p{{}}</style><!-- <p>c</p> -->{BODY}", CLEAN),
    (f"<div class='cookie-notice'>c</div><article>{BODY}<div class='share'>s</div></article>", CLEAN),
    (f"<header>h</header><article><header><h1>T</h1></header>{BODY}</article>", "T " + CLEAN),
    (f"<table><tr><td>{BODY}<td>x</table>", CLEAN + " x"), ("<ul><li>a<li>b</ul>c", "a b c"),
    ("a < b > c", "a < b > c"), ("<p title='a>b'>t", "t"), ("<p title='open>t", "t"), ("<![CDATA[a<b]]>", "a<b"), ("</p></div>x", "x"),
])
def test_own_choice(page, text):
    assert html.extract(page, [])[0] == text


def test_hostile_pages_are_linear():
    for page in ("<" * 200_000, "<p title='" * 50_000, "<div>" * 30_000 + "x", "<!--" * 100_000, "&" * 200_000, "<p " + "a=" * 100_000):
        html.extract(page, [])


def texts(spark, pages):
    rows = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in rows}


def test_host_paths_decide(spark):
    """Where a host keeps its articles in what looks like a widget, a short one is found too."""
    usual = "<div class='widget'>" + "<p>real text of some length {0}</p>" * 9 + "</div><div class='extra'>z</div>"
    note = "<div class='widget'><p>real text {0}</p></div><div class='extra'>" + "<p>more words</p>" * 8 + "</div>"
    pages = [(i, "http://h.example/p", usual.format(i)) for i in range(12)] + [(99, "http://H.example:80/q", note.format(99))]
    pages += [(100, "http://other.example/", note.format(100)), (101, None, None)]
    pages += [(i, "http://w.example/", usual.replace("z<", "<").format(i)) for i in (200, 201)]
    pages += [(202, "http://w.example/", note.format(202))]
    text = texts(spark, pages)
    usual_text = " ".join(["real text of some length 3"] * 9)
    assert text[3] == usual_text + " z" and text[101] == ""
    assert text[202] == "real text 202" + " more words" * 8
    assert text[100] == " ".join(["more words"] * 8)


LOSSLESS = [
    f"<div class=content><p>Brief 3.</p><div class=body>{BODY}</div></div>",
    f"<div class=content><div class=body>{BODY}</div><p>The end.</p></div>",
    f"<div class=content><div class=body>{BODY}</div><p><a href=x>{'linked words ' * 6}</a></p></div>",
    f"<div class=content><div class=body>{BODY}</div><ul>{'<li><a href=x>reference</a></li>' * 8}</ul></div>",
    f"<article>{BODY}<section id='search'>a</section><section id='navigation'>b</section><section class=related>c</section>"
    "<p id=reply>d</p><div class=login>e</div><p class='alert'>f</p><math><mi>x</mi></math></article>",
    f"<div class=story>{BODY}</div><div class=card>teaser</div>", f"<div class=card>teaser</div><article>{BODY}</article>",
]


@pytest.mark.parametrize("page", LOSSLESS)
def test_all_text_of_an_article_stays(page):
    assert html.extract(page, [])[0] == " ".join(re.sub("<[^>]*>", " ", page).split())


def test_all_text_stays_whatever_the_host_agrees_on(spark):
    body, card = f"<div class=content><div class=body>{BODY}</div></div>", f"<div class=card>{BODY}</div>"
    pages = [(i, f"http://h{k}.example/", body if i % 2 else card) for k in range(len(LOSSLESS)) for i in range(100 * k, 100 * k + 9)]
    pages += [(10_000 + k, f"http://h{k}.example/", page) for k, page in enumerate(LOSSLESS)]
    pages += [(20_000 + 10 * k + i, f"http://own{k}.example/", page) for k, page in enumerate(LOSSLESS) for i in range(5)]
    text = texts(spark, pages)
    for k, page in enumerate(LOSSLESS):
        wanted = " ".join(re.sub("<[^>]*>", " ", page).split())
        assert text[10_000 + k] == wanted and all(text[20_000 + 10 * k + i] == wanted for i in range(5))


def test_edges(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "c"), (1, "http://a/", "", "c"), (None, "x", "<p>t", "c")],
        "page_id long, url string, html string, host string",
    ).withColumn("paths", F.lit("clash"))
    rows = html.main_text(pages).collect()
    assert sorted(r["text"] for r in rows) == ["", "", "t"] and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html.main_text(pages.limit(0)).count() == 0


def test_deep_nesting_takes_linear_time():
    deep = "<b>" * 50_000
    assert html.extract(f"{deep}x{'</b>' * 50_000}", [])[0] == "x"
    assert html.extract(deep + "<div>y</div>" * 50_000, [])[0].count("y") == 50_000


def test_siblings_of_the_largest_container_stay():
    def p(n: int) -> str:
        return f"<p>{'word ' * n}</p>"

    for inner in (
        f"<h1>T</h1>{p(9) * 5}<div class=body>{p(90)}</div>",
        f"<h1>T</h1><div class=body>{p(90)}</div>",
        f"<div class=lead>{p(9)}</div><div class=body>{p(90)}</div><div class=more>{p(9)}</div>",
        f"<section class=a>{p(65)}</section><section class=b>{p(35)}</section>",
        f"<div class=x>{p(9)}<div class=y>{p(20)}<div class=z>{p(90)}</div></div></div>",
    ):
        page = f"<nav>n</nav><div class=content>{inner}</div><footer>f</footer>"
        text, path = html.extract(page, [])
        assert text == " ".join(re.sub("<[^>]*>", " ", inner).split())
        assert html.extract(page, [path])[0] == text


def test_siblings_stay_when_the_host_votes(spark):
    page = "<div class=content><h1>T{0}</h1><p>the lead of page {0}</p><div class=body>" + "<p>some words of it</p>" * 9 + "</div></div>"
    pages = [(i, "http://h.example/p", page.format(i)) for i in range(5)]
    rows = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith(f"T{r['page_id']} the lead of page") for r in rows)


@pytest.mark.parametrize("page,text", [
    (f"<div class='layout has-sidebar'>{BODY}</div>", CLEAN), (f"<div class='no-sidebar'><article>{BODY}</article></div>", CLEAN),
    (f"<div id='top'>{BODY}</div><div>z</div>", CLEAN + " z"), (f"<div class='header-and-content'>{BODY}</div>", CLEAN),
    (f"<form id=aspnetForm><div>{BODY}</div><input><button>b</button></form>", CLEAN),
    (f"<div id=top><article>{BODY}</article></div><div class=comments>{BODY * 3}</div>", CLEAN),
    (f"<article>{BODY}<section id='related-work'><p>r</p></section><h2 id='social-history'>s</h2><h2 id=search>h</h2>"
     "<p class='notice-of-intent'>i</p></article>", CLEAN + " r s h i"),
    ("<div class='comments'><p>c</p></div>", "c"), (f"<div>{BODY}</div><div class=comments>{BODY * 3}</div>", CLEAN),
    (f"<article>{BODY}</article><div class='related'><article>r</article></div>", CLEAN),
    (f"<div>{BODY}</div><div class='site-footer'>f</div><form>q</form><div id='cookie_notice'>c</div><div class='nav-bar'>n</div>", CLEAN),
])
def test_marked_elements_are_dropped_unless_they_hold_the_article(page, text):
    assert html.extract(page, [])[0] == text
