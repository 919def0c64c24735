"""Main text of pages: written-out cases, the given pages, and the site style tree."""

import html
import math
import re

import pytest

from pairlens.llm.html_text import extract, importance, main_text

CASES = {
    "": "",
    "plain text": "plain text",
    "<p>a<p>b &amp; c<br>d": "a\n\nb & c d",
    "<body><nav>menu</nav><article><h1>T</h1><p><b>x<br><p>y</p></article><footer>f</footer>": "T\n\nx\n\ny",
    "<article>a<b>b</b>c <i> d</i></article>": "abc d",
    "<div class='ad'>buy</div><p>text</p><div id=comments><p>reader</p></div>": "text",
    "<main><div class=\"cookie-notice\">ok?</div><p>m</p></main><p>outside</p>": "m",
    "<article><p>one</p><aside>side</aside><form><p>f</p></form><p>two</p></article>": "one\n\ntwo",
    "<script>var t='</p><p>no</p>';</script><style>p{}</style><p>x</p>": "x",
    "<!-- <p>no</p> --><p title='a>b'>y</p><!-- open": "y",
    "<p>a &lt;b&gt; &#233; &eacute; &nbsp; &bogus; &amp": "a <b> é é &bogus; &",
    "<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>": "1\n\n2\n\n3\n\n4",
    "<form><p>all in a form</p></form>": "",
    "<form><div><article><p>all in a form</p></article></div></form>": "all in a form",
    "<article><select><option>one</select><p>k</p></article>": "k",
    "<article><p>a</p><button><p>b</button><p>c</p></article>": "a\n\nc",
    '<article><p class="notice">Important finding</p></article>': "Important finding",
    "<article><p>t</p><div class='comments'><p>a comment that is longer than the article</p></div></article>": "t",
    "<article><p>t</p><div class='social-share'>share this with all of your many friends</div></article>": "t",
    "<div class='cookie-notice'>We use cookies and more words than the page has</div><p>text</p>": "text",
    "</div></b><p>stray</p></i> end": "stray\n\nend",
    "<header>site</header><article><header><h1>H</h1></header>t</article>": "H\n\nt",
    "a < b and <3": "a < b and <3",
    "<div class=header>top</div><h2 class='ad'>kept heading</h2>": "kept heading",
}


@pytest.mark.parametrize("source", CASES)
def test_written_out_pages(source):
    assert main_text(source) == CASES[source]


def test_the_given_pages(spark, sf_dir):
    from pairlens.llm.queries import op6_html_text

    got = {r.page_id: r for r in op6_html_text(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in parts]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def site(n, host="h"):
    return [
        (i, f"http://{host}/{i}", f"<div class=x><p>Same words on every page</p></div><div class=story><p>story {i} words</p></div>", "q")
        for i in range(n)
    ]


def test_repeated_branches_are_cut(spark):
    schema = "page_id long, url string, html string, host string"
    texts = lambda rows: {r.page_id: r.text for r in extract(spark.createDataFrame(rows, schema)).collect()}
    assert texts(site(12)) == {i: f"story {i} words" for i in range(12)}
    for n in (2, 5, 7, 8):  # no number of pages switches it on
        assert texts(site(n)) == {i: f"story {i} words" for i in range(n)}
    # Few pages weigh less than what all hosts show at that place.
    lively = [(100 + i, f"http://{i}.net/", f"<div class=x><p>own words {i}</p></div>", "q") for i in range(40)]
    few = texts(site(2) + lively)
    assert few[0] == "Same words on every page\n\nstory 0 words" and few[100] == "own words 0"
    assert texts([r for n in range(30) for r in site(2, f"s{n}")])[0] == "story 0 words"
    other = texts([(i, f"http://{i}.org/", h, "q") for i, _, h, _ in site(12)])
    assert all(t.startswith("Same words") for t in other.values())


def test_importance_is_entropy(spark):
    rows = [(i, "http://h/", f"<div class=x>{'a' if i < 6 else 'b'}</div>") for i in range(8)]
    (only,) = importance(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    h = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25)) / math.log(8)
    assert only.pages == 8 and abs(only.importance - 0.9 * h) < 1e-9


def test_nulls_repeats_long_pages_and_empty_table(spark):
    schema = "page_id long, url string, html string, cut string"
    rows = [(None, None, None, "c"), (1, None, "<p>x", "c"), (1, None, "<p>x", "c"), (2, "odd url", "<p>" + "w " * 300_000, "c")]
    got = sorted((r.page_id or 0, r.text[:5], r.n_chars) for r in extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "w w w", 599_999)]
    assert extract(spark.createDataFrame([], schema)).collect() == []


def texts_of(spark, pages, host="h"):
    rows = [(i, f"http://{host}/{i}", page) for i, page in enumerate(pages)]
    return [r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


STORY = "<div class=x><p>{0}</p></div><div class=story><p>story {0}</p></div>"


def test_copies_of_a_page_are_one_page(spark):
    copy = STORY.format("same")
    assert texts_of(spark, [copy] * 12) == ["same\n\nstory same"] * 12
    assert texts_of(spark, [copy] * 60 + [STORY.format(i) for i in range(3)])[60:] == [f"{i}\n\nstory {i}" for i in range(3)]
    # Copies do not keep a repeated branch either, and they lose it with the rest.
    pages = [STORY.replace("{0}", "notice", 1).format(i) for i in range(12)]
    assert texts_of(spark, pages + pages[:1] * 30) == [f"story {i}" for i in [*range(12), *[0] * 30]]


def test_only_the_repeated_look_is_cut(spark):
    body = "<div class=note>{}</div><div class=story><p>story {}</p></div>"
    notes = ["<p>the notice</p>"] * 97 + ["<p>real words</p>", "<p>other words</p>", ""]
    got = texts_of(spark, [body.format(note, i) for i, note in enumerate(notes)])
    assert got[0] == "story 0" and got[97:] == ["real words\n\nstory 97", "other words\n\nstory 98", "story 99"]
    notes = [""] * 97 + ["<p>real words</p>"] * 3
    got = texts_of(spark, [body.format(note, i) for i, note in enumerate(notes)])
    assert got[0] == "story 0" and got[97:] == [f"real words\n\nstory {i}" for i in range(97, 100)]


def test_inline_elements_are_judged_by_their_own_words(spark):
    body = "<p>by <span class=who>author {0}</span> <span class=tag>read more</span> today {0}</p>"
    assert texts_of(spark, [body.format(i) for i in range(12)]) == [f"by author {i} today {i}" for i in range(12)]


def test_a_page_of_repeated_looks_alone_stays(spark):
    pages = [*(STORY.replace("{0}", "notice", 1).format(i) for i in range(30)), "<div class=x><p>notice</p></div>"]
    assert texts_of(spark, pages) == [*(f"story {i}" for i in range(30)), "notice"]


def test_pages_inside_forms_are_judged_alike(spark):
    pages = [f"<form><main><div class=x>notice</div><p>words {i}</p></main></form>" for i in range(12)]
    assert texts_of(spark, pages) == [f"words {i}" for i in range(12)]
    # Only the style tree can tell here: no tag and no name says what the branch is.
    pages = [f"<div><div class=kx><b>Hot line</b> 0800</div><div class=ky><p>report {i}</p></div></div>" for i in range(40)]
    assert texts_of(spark, pages) == [f"report {i}" for i in range(40)]


NAMED = {
    '<div class="layout no-sidebar"><article><p>a</p></article></div>': "a",
    '<div class="post comments-open"><p>a</p></div>': "a",
    '<div class="ad-free content"><p>a</p></div><p>b</p>': "a\n\nb",
    '<article><p>a</p><section id="search-results-study"><p>b</p></section></article>': "a\n\nb",
    '<div class="sidebar"><article><p>a</p></article></div><p>longer outside</p>': "a",
    '<div class="widget"><main><p>a</p></main></div><p>longer outside</p>': "a",
    '<div class="search"><p>most of the words</p></div><p>few</p>': "few",
    '<div class="ad">x</div><div class="menu">y</div>': "",
    '<article><p>long text</p></article><div class="related-posts"><article><p>other</p></article></div>': "long text",
    '<p>long text</p><div class="left-sidebar">s</div><div class="share-buttons"><b>t</b></div>': "long text",
    '<div class="ad">buy</div><form><p>all in a form</p></form>': "",
}


@pytest.mark.parametrize("source", NAMED)
def test_names_cut_no_wrapper_of_the_text(source):
    assert main_text(source) == NAMED[source]
