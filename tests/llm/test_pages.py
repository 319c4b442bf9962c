import html
import re

import numpy as np

from cardwarden.llm import pages
from cardwarden.llm.queries import op6_pages

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a> The Daily Site</header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div id="cookie-notice">We use cookies to make this site better for all of our readers every day.</div><!-- <p>hidden</p> -->
<article class="post tag-comments"><header class="entry-header"><h1>A&nbsp;title &amp; more</h1></header>
<p><b>First   words &lt;b&gt; of\nthe <a href="/x">article</a> are here, long enough to read.<br><p>Second one<br>goes on
<div class="advert">Buy this thing now, it is the best thing of all things and cheap.</div>
<p>Short.</p><ul><li>Item one of the list</li><li>Item two of the list</ul>
<section id="comments"><h2>Comments</h2><p>Nice article, I have read it twice and will tell my friends about it at once.</p></section></article>
<aside><h3>Related</h3><p>Some other text that stands at the side of the page and is long.</p></aside>
<form><label>Your mail</label><p>Write to us at any time of the day and night, we are here.</p></form>
<footer>&copy; 2024 The Site. All rights reserved by the owners of the site.</footer></body></html>"""


def test_a_page_with_all_kinds_of_frame():
    assert pages.main_text(PAGE).split("\n\n") == [
        "A title & more", "First words <b> of the article are here, long enough to read.", "Second one goes on", "Short.",
        "Item one of the list", "Item two of the list",
    ]


def test_names_of_elements():
    frame = ["main-header", "site-header", "AdSlot", "side-bar", "reader-comments", "cookie_notice", "mainNav"]
    for name in frame:
        assert pages.main_text(f'<div class="{name}"><p>{"word " * 40}</p></div>') == "", name
    for name in ("entry-header", "article-body", "content", "headline", "addition", "shipping"):
        assert pages.main_text(f'<div class="{name}"><p>{"word " * 40}</p></div>'), name
    assert pages.main_text(f'<div role="contentinfo">{"word " * 40}</div><p hidden>{"word " * 40}</p>') == ""


def test_class_words_of_a_layout_are_no_frame():
    long = ("word " * 40).strip()
    for name in ("content has-sidebar", "content-sidebar-wrap", "overflow-hidden", "page with-sidebar", "no-sidebar", "hasSidebar"):
        assert pages.main_text(f'<div class="{name}"><p>{long}</p></div>') == long, name
    assert pages.main_text(f'<div id="search-results"><p>{long}</p></div>') == long
    for name in ("sidebar no-padding", "nav-no-border", "footer-wrap", "sidebar-wrap", "search", "hidden"):
        assert pages.main_text(f'<div class="{name}"><p>{long}</p></div>') == "", name


def test_an_article_ends_an_outer_frame_of_class_words():
    long = ("word " * 40).strip()
    for name in ("right-sidebar", "sidebar-wrap", "search", "hidden", "sticky-footer"):
        for element in ("main", "article", 'div role="main"'):
            page = f'<div class="{name}"><{element}><p>{long}</p><nav><p>{long}</p></nav><div class="share"><p>{long}</p></div></{element.split()[0]}><p>{long}</p></div>'
            assert pages.main_text(page) == long, (name, element)
    for element in ("nav", "aside", "footer", "div hidden"):
        assert pages.main_text(f"<{element}><article><p>{long}</p></article></{element.split()[0]}>") == "", element
    # Articles that are comments or teasers stay in the frame.
    assert pages.main_text(f'<div><p>{long}</p></div><div id="comments"><article><p>{long} more</p></article></div>') == long
    assert pages.main_text(f'<article><p>{long}</p></article><div class="sidebar"><article><p>Teaser of one more article.</p></article></div>') == long
    assert pages.main_text(f'<div class="has-comments sidebar"><main><p>{long}</p><div class="comments"><article><p>{long}</p></article></div></main></div>') == long


def test_a_form_round_the_page_is_no_frame():
    long = ("word " * 40).strip()
    form = '<form id="form1" action="page.aspx">'
    assert pages.main_text(f"{form}<nav>{long}</nav><article><p>{long}</p></article></form><p>{long} x</p>") == f"{long}\n\n{long} x"
    assert pages.main_text(f'{form}<header>A site</header><div><p>{long}</p></div><form><p>Your mail</p></form><div class="footer">{long}</div></form>') == long
    assert pages.main_text(f"<p>{long}</p>{form}<p>{long}</p></form>") == long


def test_a_page_without_article_element():
    long = "word " * 40
    page = f"<div><a>x</a> <a>y</a></div><div><p>{long}</p><p>then this</p><p>{long}</p></div><div><a>more of this</a></div><div>fine print</div>"
    assert pages.main_text(page).split("\n\n") == [long.strip(), "then this", long.strip()]


def test_broken_markup():
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<p>") == pages.main_text("<script>x") == ""
    assert pages.main_text("<article><p>a < b and c > d <i>e") == "a < b and c > d e"
    assert pages.main_text("<article><p>kept<!-- open <p>gone") == "kept"
    assert pages.main_text('<article><p title="a>b">in</p><p title="open>out</p></article>') == "in\n\nout"
    assert pages.main_text("</div></p><main><h2>T</h2><p>x</main><nav>y") == "T\n\nx"
    assert len(pages.main_text("<article><p>" + "long " * 200_000)) == 999_999


def test_raw_elements():
    long = ("word " * 40).strip()
    for tag in ('<svg viewBox="0 0 9 9"/>', '<svg aria-label="a>b" />', "<math/>", "<title-bar>", "<object-view>", "<script-view>", "<iframe>", "<noscript>", "<canvas>", "<svg>"):
        assert pages.main_text(f"<article><p>{long}</p>{tag}<p>{long} x</p></article>") == f"{long}\n\n{long} x", tag
    for name in ("script", "style", "svg", "object", "NoScript"):
        assert pages.main_text(f"<article><p>a {long}</p><{name} a='>'><p>gone</{name}-x></{name} ><p>{long}</article>") == f"a {long}\n\n{long}", name
    assert pages.main_text(f"<article><p>{long} <math><mi>x</mi></math> is so</p><select><option>One<option>Two</select></article>") == f"{long} x is so\n\nOne\n\nTwo"
    # Each element that nothing ends is looked for once.
    assert pages.main_text("<article><p>" + "<svg>x " * 50_000).count("x") == 50_000


def test_tree_learns_its_table():
    table = np.array([line.split() for line in pages.LABELLED.strip().splitlines()], float)
    assert (pages.tree().predict(table[:, :-1]) == (table[:, -1] > 0)).all()


def test_rows(spark):
    rows = [(1, "u", None, 5), (1, "u", "", 6), (None, None, PAGE, 7), (2, "v", PAGE, 8), (2, "v", PAGE, 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").withColumnsRenamed({"text": "row"})
    got = pages.extract(df).collect()
    want = [(i, u, pages.main_text(h), len(pages.main_text(h))) for i, u, h, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pages.extract(df.limit(0)).count() == 0


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op6_pages(spark, sf).collect()
    assert len(got) == len(source)
    for r in got:
        # In these pages the article element holds the article and nothing else.
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


HELD = (
    "share-price legal-text menu-recipes notice-board side-by-side modal-open hidden-gems search-engine-guide comment-on-the-budget elementor-widget elementor-widget-container "
    "fl-widget wp-block-widget"
).split()


def test_a_word_inside_a_name_is_no_frame():
    long = ("word " * 40).strip()
    for name in HELD:
        assert pages.main_text(f'<div class="{name}"><p>{long}</p></div>') == long, name
        assert pages.main_text(f'<div id="{name}"><h1>News today</h1><p>The mayor resigned on Monday.</p></div>') == "News today\n\nThe mayor resigned on Monday.", name
        for element in ("main", "article"):
            page = f'<{element}><p>{long} x</p><section class="{name}"><p>{long}</p><p>Short.</p></section></{element}>'
            assert pages.main_text(page) == f"{long} x\n\n{long}\n\nShort.", (element, name)


def test_what_a_name_names_is_a_frame():
    long = ("word " * 40).strip()
    for name in ("sidebar-widget", "widget", "widget-area", "footer-widgets", "side-bar", "ad-slot-top", "share-buttons", "comments-section", "cookie-bar", "nav_bar", "newsletter-signup-box", "menu-list"):
        for page in ("<div class='{0}'><p>{1}</p></div>", "<main><p>x {1}</p><div class='{0}'><p>{1}</p></div></main>", "<article><p>x {1}</p><div id={0}><p>{1}</p></div></article>"):
            assert pages.main_text(page.format(name, long)) in ("", f"x {long}"), name


def test_short_pages_keep_their_blocks():
    want = "News today\n\nThe mayor resigned on Monday.\n\nHe gave no reason."
    body = "<h1>News today</h1><p>The mayor resigned on Monday.</p><p>He gave no reason.</p>"
    assert pages.main_text(body) == pages.main_text(f"<html><body><div>{body}</div></body></html>") == want
    framed = f"<header>A site</header><nav><a href=x>Home</a></nav><div>{body}</div><div class=sidebar><p>Some more.</p></div><footer>2024.</footer>"
    assert pages.main_text(framed) == want
    assert pages.main_text("<div><a href=x>Home</a> <a>About</a></div><p>Short text here.</p><p><a>Read more here</a></p>") == "Short text here."
    assert pages.main_text("<h2>Soup</h2><ul><li>two onions</li><li>one carrot</li></ul>") == "Soup\n\ntwo onions\n\none carrot"
    assert pages.main_text("hello world") == pages.main_text("<div>hello world</div>") == "hello world"
    # Where the page has an article, what is beside it is none of it.
    assert pages.main_text("<article><h1>T</h1><p>x y z.</p></article><p>Follow us on the net.</p><div>All rights reserved.</div>") == "T\n\nx y z."


def test_a_long_page():
    long = "word " * 40
    page = "<nav><a>Home</a></nav><main>" + f"<p>{long}<a href='/x'>link</a></p><script>var x = '<p>';</script>" * 120_000 + "</main>"
    assert len(page) > 30_000_000
    text = pages.main_text(page)
    assert text.count("\n\n") == 119_999 and len(text) == 120_000 * (205 - 1) + 119_999 * 2
