import html
import re
from collections import Counter

import duckdb

from clickloom.llm import page_text
from clickloom.llm.page_text import main_text
from tests.conftest import DATA


def test_article_of_every_page(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    got = {r.page_id: r for r in page_text.extracted(pages).collect()}
    for page_id, url, page in duckdb.sql(f"select page_id, url, html from '{DATA}/sf0.01/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = re.split(r"</?(?:p|br|h1)>", article)
        want = " ".join(x for b in blocks if (x := re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip()))
        assert got[page_id].text == want and got[page_id].n_chars == len(want) and got[page_id].url == url


def test_parts_that_are_left_out():
    body = "A first paragraph of the article that is long enough to be a surge by itself, as articles are."
    page = f"""<html><head><title>T</title><script>var a="</p><b>";</script></head><body><!-- <p>no</p> --><header><p>Site</p></header><nav><a href=x>Menu</a></nav>
    <div class='cookie-notice'>We use <b>cookies</b></div><main><article><header><h1>Title &eacute;</h1></header><p>{body}<p>Short.<br>Next &amp; last
    line<div class="ad-box"><div>Buy</div> now</div><form><label>Mail</label><input name=x></form><p>After <i>it</i>all.<section id="comments"><p>First!</p></section></article></main>
    <aside>Side</aside><footer>&copy; us</footer></body></html>"""
    assert main_text(page) == f"Title é {body} Short. Next & last line After itall."


def test_without_article_element():
    text = "Words of an article that runs over many characters, so that its lines surge above menus and notes."
    page = f"<body><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About us</a></ul><div>{text}</div><div>Short one.</div><div>{text}</div><div class=sidebar>x</div><ul><li><a>Older posts</a></ul></body>"
    assert main_text(page) == f"{text} Short one. {text}"


def test_parts_within_a_page_without_article_element():
    text = "Words of an article that runs over many characters, so that its lines surge above menus and notes."
    page = f"""<body><div>My site</div><nav><a href=1>Home</a></nav><p>{text}</p><div class="advert">Buy</div><p>Short one.</p><aside>Aside</aside><h2><a href=2>A linked heading</a></h2>
    <form><p>Mail</p></form><p>{text}</p><div class=related><p>See</p></div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><p>{text}</p><div class="cookie-notice">Ok</div><p>The end.</p><div class=comments>First!</div><div>Made by us</div></body>"""
    assert main_text(page) == f"{text} Short one. A linked heading {text} {text} The end."
    parted = f"<p>{text}</p><nav>x</nav><p>Short one.</p><div id=footer>x</div><p>{text}</p>"
    assert main_text(parted) == f"{text} Short one. {text}"


def test_linked_lines_in_an_article_once():
    assert main_text("<article><p>text</p><p><a>1</a></p><p><a>2</a></p><p><a>3</a></p><p>more</p></article>") == "text 1 2 3 more"


def test_odd_pages():
    assert [main_text(x) for x in (None, "", "   ", "<p>", "<!-- x", "<script>x", "a < b")] == ["", "", "", "", "", "", "a < b"]
    assert main_text("<article><p>x</article>") == "x" and main_text("<article>" + "<b>" * 5000 + "deep" + "</b>" * 5000 + "</article>") == "deep"
    assert main_text("<article><p>&am</p><p>&#x41;&nbsp;B  c</p></article>") == "&am A B c"


def test_the_same_text_without_the_element():
    for (page,) in duckdb.sql(f"select html from '{DATA}/sf0.1/pages.parquet'").fetchall():
        assert main_text(re.sub("</?article>", "", page)) == main_text(page) != ""


TEXT = "Words of an article that runs over many characters, so that its lines surge above menus and notes."


def test_names_are_weights():
    for page in (
        f'<div class="content no-sidebar"><p>{TEXT}</p></div>', f'<div class="post has-sidebar"><p>{TEXT}</p></div>', f'<form id="aspnetForm"><div>Search</div><p>{TEXT}</p></form>',
        f'<div class="ad-free page-with-comments"><p>{TEXT}</p><div class="comments"><p>First!</p></div></div>', f"<div class=sidebar-left><h1>Title</h1><p>Short.</p><p>{TEXT}</p></div><div class=ad>Buy</div>",
    ):
        got = main_text(page)
        assert got.endswith(TEXT) and "First" not in got and "Buy" not in got
    legal = f'<article><p>{TEXT}</p><section class="legal"><p>{TEXT}</p><p>{TEXT}</p></section><p>{TEXT}</p><div class="notice">Mind this.</div></article>'
    assert main_text(legal) == " ".join([TEXT] * 4)
    assert main_text(f"<form><label>Name</label><br><label>Mail</label></form><p>{TEXT}</p>") == TEXT


def test_sums_decide_beside_a_named_article():
    teaser = f"<div>Top</div><article><p>{TEXT}</p></article><div>Made by us</div>"
    assert main_text(teaser) == TEXT
    assert main_text("<article><p>Hi</p></article>" + f"<p>{TEXT}</p>" * 20) == " ".join(["Hi"] * 0 + [TEXT] * 20)


def test_odd_quotes():
    assert main_text("<p data-x=it's>one</p><p title=\"a > b\">two</p><p class='x' data-y=\"it's\">three</p>") == "one two three"


def test_precision_and_recall_on_varied_pages():
    """Words of hand-made layouts around the table's articles: at least 0.99 of both."""
    layouts = [
        "<div id=wrap><div class=header-wrap><div class=site-header>My site</div></div><div class=content>{}</div><div class=sidebar><p>Popular: one, two, three and more of them</p></div></div>",
        "<ul class=menu><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About</a></ul><div>{}</div><div id=comments><p>A long comment of a reader who has much to say about it all.</p></div>",
        "<table><tr><td class=nav><a>a</a><br><a>b</a></td><td>{}</td></tr></table><div class=copyright>All rights</div>",
        "<main><form action=x>{}</form></main><div class='cookie-consent'>We use cookies to make this site better for you and for us.</div>",
    ]
    pages = duckdb.sql(f"select html from '{DATA}/sf0.01/pages.parquet'").fetchall()
    hit = got_all = want_all = 0
    for k, (page,) in enumerate(pages):
        body = re.search(r"<article>(.*)</article>", page, re.S)[1]
        want, got = main_text(f"<article>{body}</article>").split(), main_text(layouts[k % 4].format(body)).split()
        want_all, got_all = want_all + len(want), got_all + len(got)
        hit += sum((Counter(want) & Counter(got)).values())
    assert hit >= 0.99 * want_all and hit >= 0.99 * got_all


def test_empty_table_and_long_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert page_text.extracted(empty).columns == ["page_id", "url", "text", "n_chars"] and page_text.extracted(empty).count() == 0
    assert main_text("<p>" + "word " * 200_000 + "</p>") == " ".join(["word"] * 200_000)
    assert main_text("<div>" * 20_000 + TEXT) == TEXT and main_text("<p>x <b a='" * 5_000).startswith("x")
