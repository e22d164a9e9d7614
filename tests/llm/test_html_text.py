"""Tree scoring: whole synthetic pages by their known template, and small pages by hand."""

import html
import re

from medialake.llm import html_text
from medialake.llm.common import table
from tests.oracle import SF


def expected(page):
    """The synthetic pages hold one article, whose blocks are h1 and p."""
    body = page.partition("<article>")[2].partition("</article>")[0].partition("<footer>")[0]
    blocks = re.split(r"</?(?:h1|p)>", re.sub(r"<[^>]*\Z", "", body))
    lines = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_template_pages(spark):
    rows = html_text.extract(table(spark, SF.replace("0.001", "0.01"), "pages"), keep=["page_id"]).collect()
    pages = {r["page_id"]: r["html"] for r in table(spark, SF.replace("0.001", "0.01"), "pages").collect()}
    bad = [(r["page_id"], r["text"], expected(pages[r["page_id"]])) for r in rows if r["text"] != expected(pages[r["page_id"]])]
    assert len(rows) == len(pages) and not bad, (len(bad), bad[:2])


def test_parts_that_are_no_article():
    page = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <div id=cookie-notice>We use cookies, many, many of them, all the time.</div><div class="menu"><a href=a>One</a></div>
    <div class="layout"><div class="post-content"><h2>Head &amp; shoulders</h2><p>First, long   paragraph<br>with a <a href=x>link</a>, and commas, &lt;tags&gt; and caf&eacute;.
    <ul><li>one<li>two</ul><form><input name=q><label>Mail</label></form><script>var x = "</p>";</script>
    <table><tr><td>a<td>b</table><blockquote>said, so</blockquote><p hidden>no</p></div>
    <div class="sidebar"><p>Side, side, side, side, side, side, side.</p></div></div>
    <section id="comments"><p>Great, great, great, great, great text, I like, really.</p></section><footer>&copy; me</footer>"""
    assert html_text.main_text(page).split("\n") == ["Head & shoulders", "First, long paragraph with a link, and commas, <tags> and café.", "one", "two", "a", "b", "said, so"]


def test_edge_cases(spark):
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<!-- x --><script>") == ""
    assert html_text.main_text("<p>a &am") == "a &am" and html_text.main_text("<p>a &amp b<p") == "a & b"
    assert html_text.main_text("<div>" * 5000 + "<p>deep, text") == "deep, text"
    assert html_text.main_text("plain < text") == "plain < text"
    df = spark.createDataFrame([(1, None, "u", "own"), (1, None, "u", "own"), (2, "<p>x</p>", None, "own")], "page_id long, html string, url string, text string")
    rows = html_text.extraction_report(df).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in rows) == [(1, "", 0), (1, "", 0), (2, "x", 1)]
    assert html_text.extraction_report(df.limit(0)).count() == 0


def test_article_text_stays():
    """Names and attributes that only look like those of other parts, the article's header, and references."""
    long = "a long paragraph, with commas, and words enough to be the text of an article on its own."
    body = f"""<nav><a href=a>Home</a></nav><div class="site-wrap"><article class="story"><header><h1>Headline</h1></header><p title="the hidden valley" data-style="display:none">First, {long}</p>
    <div id="related-work"><p>Second, {long}</p></div><div class="market share-prices"><p>Third, {long}</p></div><p data-hidden="1" style="margin:0">Fourth, {long}</p>
    <ul><li><a href=1>A study of long titles in lists of references</a><li><a href=2>Another study of even longer titles of papers</a><li><a href=3>The third of the studies that the article cites</a></ul>
    <ul class=x><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><div class="share-buttons"><p>Share it, now, with all, of them.</p></div><p style="color:red; display: none">no</p>
    <div class="ad-slot">buy</div><footer>me</footer></article><div class="related-posts"><p>More, more, more, more, more.</p></div></div>"""
    got = html_text.main_text(body).split("\n")
    assert got[:5] == ["Headline"] + [f"{k}, {long}" for k in ("First", "Second", "Third", "Fourth")]
    assert [x.split()[0] for x in got[5:]] == ["A", "Another", "The"]


def test_short_parts_lists_and_boxes_of_an_article():
    ten = "".join(f"<p>Paragraph {i}, of words, enough to be an article.</p>" for i in range(10))
    first = [f"Paragraph {i}, of words, enough to be an article." for i in range(10)]
    for wrap in ("div", "section"):
        page = f"<div class=wrap><{wrap}>{ten}</{wrap}><{wrap}><h2>Sub</h2><p>Brief.</p></{wrap}><div><a href=a>More</a> <a href=b>Links</a></div></div>"
        assert html_text.main_text(page).split("\n") == [*first, "Sub", "Brief."]
    cities = "<ul><li><a href=1>Paris</a><li><a href=2>Lyon</a><li><a href=3>Nice</a></ul>"
    assert html_text.main_text(f"<article>{cities}{ten}{cities}<p>After.</p>{cities}</article>").split("\n") == [*first, "Paris", "Lyon", "Nice", "After."]
    assert html_text.main_text(f"<article>{ten}<p>See:</p>{cities}</article>").split("\n") == [*first, "See:", "Paris", "Lyon", "Nice"]
    assert html_text.main_text(f'<article>{ten}<blockquote class="sidebar">Said.</blockquote><div class="sidebar"><p>Box.</p></div></article>').split("\n") == [*first, "Said."]
    for name in ("reactions", "discussion", "comments"):
        assert html_text.main_text(f'<div><div>{ten}</div><div class="{name}"><h3>Readers</h3><p>Great, great, great, I like it.</p></div></div>').split("\n") == first


def test_depth_costs_no_more_than_length():
    import time

    began = time.time()
    assert html_text.main_text("<p>one, two" + "<div>" * 40_000 + "<p>deep, text" + "<td><p>" * 20_000)
    assert html_text.main_text("<ul>" + "<li><b>" * 20_000 + "<p>deep, text") == "deep, text"
    assert time.time() - began < 20


def test_against_plain_trees():
    """The scores and the container by a plain recursive reading of the definition."""
    import random

    def size(e):
        own = sum(len(p.strip()) for p in e.parts if isinstance(p, str))
        return own + sum(size(p) for p in e.parts if not isinstance(p, str))

    def commas(e):
        return sum(p.count(",") if isinstance(p, str) else commas(p) for p in e.parts)

    def links(e):
        return size(e) if e.tag == "a" else sum(links(p) for p in e.parts if not isinstance(p, str))

    rng = random.Random(5)
    for _ in range(60):
        page = "".join(rng.choice(["<div>", "</div>", "<p>some words, with commas", "</p>", "<section>", "</section>", "<a href=x>a link</a>", "<ul><li>item", "</ul>", "loose text, here " * 9]) for _ in range(60))
        elements = html_text._walk(html_text.parse(page))
        html_text._score(elements)
        points = {id(e): html_text.BASE.get(e.tag, 0) for e in elements}
        points[id(elements[0])] = 0
        for e in elements:
            assert (e.chars, e.links) == (size(e), links(e))
            if e.chars and (e.tag in html_text.PARAGRAPHS or e.tag in ("div", "section", "article", "main") and any(isinstance(p, str) and p.strip() for p in e.parts)):
                own = 1 + commas(e) + min(size(e) // 100, 3)
                up = [e.parent]
                while up[-1] is not None and len(up) < 6:
                    up.append(up[-1].parent)
                if e.tag not in html_text.PARAGRAPHS:
                    points[id(e)] += own
                for depth, x in enumerate(y for y in up[:5] if y is not None):
                    points[id(x)] += own / (1 if depth == 0 else 2 if depth == 1 else 3 * depth)
        assert all(abs(e.points - points[id(e)]) < 1e-9 for e in elements)
