"""Main text of pages: made pages of several makes, and every given page against its article read plainly."""

import html
import re

import pytest

from attesta.llm.main_text import main_text, main_texts
from attesta.llm.queries import op11_tag_path_text

PARAGRAPHS = [
    "The harbour froze twice that winter, and nobody could say why: the water, after all, was salt.",
    "Ships waited outside. Their crews played cards, mended sails, and wrote letters that no one would carry.",
    "Short.",
    "In March the ice broke; by April the first barge came in, loaded with oranges, lamp oil and news.",
]
COMMENTS = "".join(f'<div class="{{c}}"><p>I was there, and I must say, it was colder than that; my uncle, too, remembers it well. Number {i}.</p></div>' for i in range(9))
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/b">News, sport, weather</a></li><li><a href="/c">About us</a></li></ul>'


def article(*tags, heading="A cold winter"):
    return f"<h1>{heading}</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


def wanted(heading="A cold winter"):
    return "\n\n".join([heading, *PARAGRAPHS])


PAGES = {
    "semantic": f"<body><header><a href=/>Site</a><nav>{MENU}</nav></header><main><article>{article()}</article></main><aside><p>Most read, today. And yesterday, too.</p></aside><footer>&copy; Site.</footer></body>",
    "divs that say what they are": f'<body><div id="site-header"><p>Site, since 1990.</p></div><div class="topNav">{MENU}</div><div class="cookie-notice"><p>We use cookies, as all do. Accept, please.</p></div>'
    f'<div class="content">{article()}</div><div class="right_sidebar"><p>Most read, today.</p></div><div id="comments">{COMMENTS.replace("{c}", "comment")}</div><div class="footer-legal"><p>All rights reserved, everywhere.</p></div></body>',
    "opaque names": f'<body><div class="x1">{MENU}</div><div class="x2"><div class="x3">{article()}</div></div><div class="x4">{MENU}</div><div class="x5"><span>Imprint</span></div></body>',
    "comments as articles": f'<body><article class="post">{article()}</article><section class="responses">'
    + "".join(f'<article class="comment"><h4>Reader {i}</h4><p>I was there, and it was colder, far colder, than you say. {i}</p></article>' for i in range(12))
    + "</section></body>",
    "within the article": f'<article>{article()}<div class="ad-slot"><p>Buy now, pay later, or never.</p></div><form><p>Your mail, please.</p><input><button>Send</button></form><aside>Read this, too.</aside><footer>By A. Writer.</footer></article>',
    "class tells what lies beside": f'<body class="has-sidebar cookies"><div class="layout with-sidebar"><main class="no-comments">{article()}</main><div class="sidebar">Elsewhere, today.</div></div></body>',
    "a header that holds the heading": f'<body><div class="page-header"><h1>A cold winter</h1></div><div class="text">{article().split("</h1>")[1]}</div><div class="share-buttons">Tell others, now.</div></body>',
    "upper case and open tags": "<BODY><NAV>" + MENU.upper() + "</NAV><ARTICLE><H1>A cold winter<P>" + "<P>".join(PARAGRAPHS) + "</ARTICLE><FOOTER>Site, 1990.",
    "notice with a role": f'<body><div role="alert">Storm, tonight, in the north. Stay in.</div><main>{article()}</main><div role="contentinfo">Site.</div></body>',
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_article_without_the_rest(name):
    assert main_text(PAGES[name]) == wanted()


def test_blocks_space_and_references():
    page = "<article><p>a&nbsp;&amp;\n b<b>c</b> &eacute;&#233;&#x41; 1 < 2, &lt;p&gt;</p>\n<!-- no </p> --><div>d<br>e<p></p>f</div><ul><li>one<li>two</ul><pre> x\n\n y </pre></article>"
    assert main_text(page) == "a & bc ééA 1 < 2, <p>\n\nd e\n\nf\n\none\n\ntwo\n\nx y"


def test_scripts_styles_and_quoted_brackets():
    page = """<article><script>if (a < b) { "</p>" }</script><style>p > a {}</style><p title="a > b" data-x='<p>'>One, two.</p><noscript><p>No, no.</p></noscript><svg><text>logo</text></svg><p>Three.</p></article>"""
    assert main_text(page) == "One, two.\n\nThree."


@pytest.mark.parametrize("page", [None, "", "   ", "<p", "<!-- open <p>x", "<script>x", "<nav>only, a menu.</nav>", "</p></div>", "<p class='x"])
def test_nothing(page):
    assert main_text(page) == ""


def test_unmarked_text_is_kept():
    assert main_text("Just text, and no tag.") == "Just text, and no tag."


def test_very_long_and_deep_pages():
    assert len(main_text("<article><p>" + "word, " * 200_000 + "</p></article>")) == 1_199_999
    assert main_text("<div>" * 20_000 + "<p>Deep, but there.</p>") == "Deep, but there."
    assert main_text("<article>" + "<p>Hm.</p>" * 20_000 + "</article>").count("Hm.") == 20_000


def test_tables(spark):
    rows = [(1, "u", PAGES["semantic"], 1), (1, "u", PAGES["semantic"], 2), (None, None, None, 3), (2, "v", "", 4)]
    got = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in got if r.page_id) == [(1, "u", wanted(), len(wanted()))] * 2 + [(2, "v", "", 0)]
    assert [(r.text, r.n_chars) for r in got if r.page_id is None] == [("", 0)]
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain(source):
    """The article of a given page: its only parts are h1, p, b and br."""
    inner = source[source.index("<article>") + 9 : source.rindex("</article>")]
    blocks = (" ".join(html.unescape(re.sub("</?b>|<br>", " ", p)).split()) for p in re.split("</?p>|</?h1>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op11_tag_path_text(spark, sf).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got} == {i: (r.url, plain(r.html), len(plain(r.html))) for i, r in pages.items()} and len(got) == len(pages)
