import time

import pytest

from gridloom.llm.html import extract_pages, main_text

LONG = "The fox and the dog are in the house with all of their friends and they do not want to go out for it is as cold as it can be. " * 2


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("<div></div>", ""),
    ("<article><h1>T&eacute;</h1><p>One<br>t<b>w</b>o\n <p>&amp;&amp; &lt;3 &am x</article><footer>no</footer>", "Té One two && <3 &am x"),
    ("<article>a<script>var x='</p><p>';</script><style>p{}</style><!-- <p>no</p> -->b</article>", "ab"),
    ("<header>site</header><nav><a href=x>m</a></nav><article><header><h1>T</h1></header><p>body</p><aside>no</aside></article>", "T body"),
    ("<article><p>yes</p><section class='user-comments'><article><p>no</p></article></section></article>", "yes"),
    ("<main><div class=ad>no</div><form><p>no</p></form><p>a < b and c > d</p><div hidden>no</div></main>", "a < b and c > d"),
    ("<article><p><a href=1>only a link</a></p><p>see <a href=2>this</a> and more</p></article>", "see this and more"),
    ("<article><p>cut off in a tag <b", "cut off in a tag"),
    ('<article><p title="a > b">x</p><p class="unclosed>y</p><p>z</p></article>', "x y z"),
    ("<article><p>x</p></article><p>Cookie text stands outside.</p>", "x"),
])
def test_pages(page, text):
    assert main_text(page) == text


def test_rules_without_an_article():
    page = (f"<body><div>Home</div><div><a href=1>one</a> <a href=2>two</a></div><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
            "<p>xk zr qq pl mm nn oo ww rr tt yy uu ii pp aa ss dd ff gg hh jj kk ll zz xx cc vv bb</p><div>All rights reserved</div></body>")
    assert main_text(page) == f"Title {LONG.strip()} Short. {LONG.strip()}"


RUSSIAN = "Лиса и собака живут в доме вместе со всеми своими друзьями и не хотят выходить на улицу, потому что там очень холодно и темно. " * 2
LINKS = "<p><a href=1>One of many other pages of the site</a></p>"


def test_neighbours_decide_in_articles_too():
    page = f"<article><h1>Title</h1><p>{LONG}</p>{LINKS}<p>More</p>{LINKS}<p>{LONG}</p><p>Short end</p></article>"
    assert main_text(page) == f"Title {LONG.strip()} {LONG.strip()} Short end"
    apart = f"<article><aside>no</aside><p>Short</p><div class=ad>no</div><p>{RUSSIAN}</p></article>"
    assert main_text(apart) == f"Short {RUSSIAN.strip()}"


def test_low_density_alone_does_not_lose_text():
    assert main_text(f"<div>{RUSSIAN}</div><p>Коротко.</p><div>{RUSSIAN}</div>") == f"{RUSSIAN.strip()} Коротко. {RUSSIAN.strip()}"
    code = "x1 = f(y1); z1 = g(x1, y1); print(z1) " * 4
    assert main_text(f"<p>{LONG}</p><p>{code}</p><p>{LONG}</p>") == f"{LONG.strip()} {code.strip()} {LONG.strip()}"


def test_teaser_cards_do_not_hide_the_page():
    cards = "".join(f"<article><a href={k}>Card {k}</a></article>" for k in range(3)) + "<article>Read on.</article>"
    assert main_text(f"<h1>Title</h1><div>{LONG}</div><div>{LONG}</div>{cards}") == f"Title {LONG.strip()} {LONG.strip()}"


@pytest.mark.parametrize("page", [
    f"<article class='post comments-open'><p>{LONG}</p></article>",
    f"<main class='has-sidebar'><p>{LONG}</p></main>",
    f"<article class='widget'><p>{LONG}</p></article><article class=promo>no</article>",
    f"<div id='search-result'><div>{LONG}</div></div>",
    f"<body><div class='with-header'><p>{LONG}</p></div><footer>no</footer>",
    f"<div class='page sidebar'><nav>no</nav><p>{LONG}</p><div class=comments>no</div></div>",
    f"<div class=header><div class=widget><article><p>{LONG}</p></article></div></div>",
    f"<article><div class='ad-free no-comments'>{LONG}</div><div class='cookie-banner'>no</div></article>",
])
def test_names_alone_do_not_lose_the_page(page):
    assert main_text(page) == LONG.strip()


def test_names_hold_where_an_article_stands_elsewhere():
    comments = "<div class=comments-list><div class='user comments'>" + f"<article><p>{LONG[:131]}</p></article>" * 5 + "</div></div>"
    assert main_text(f"<article><p>{LONG}</p></article>{comments}") == LONG.strip()
    assert main_text(f"<main><p>{LONG}</p><div id=comments>{f'<p>{LONG}</p>' * 3}</div></main>") == LONG.strip()
    assert main_text(f"<div class=ad>{LONG[:131]}</div><article><h1>Title</h1>A short note.</article>") == "Title A short note."


def test_many_undecided_blocks_take_linear_time():
    begun = time.monotonic()
    assert main_text("<p>short</p>" * 30000) == ""
    assert time.monotonic() - begun < 10


def test_long_pages_are_whole():
    many = "".join(f"<p>word{i}</p>" for i in range(20000))
    assert main_text(f"<article>{many}</article>").split() == [f"word{i}" for i in range(20000)]
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert main_text("<article>x" + "<a '" * 500).startswith("x")


def test_query_shape(spark):
    rows = [(1, "u", "<article>é x</article>", 5), (1, "u", "<article>é x</article>", 5), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = extract_pages(pages).collect()
    assert sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in got) == [(0, None, "", 0), (1, "u", "é x", 3), (1, "u", "é x", 3)]
    assert extract_pages(pages.limit(0)).count() == 0


def test_unclosed_and_stray_tags_take_linear_time():
    pages = ["<b>" * 20000 + "</i>" * 20000 + "Said.", "<div>" * 20000 + "</p>" * 20000 + "Said.", "<b>" * 20000 + "<p>Said.</p>" * 20000,
             "<ul>" + "<li><i>" * 20000 + "Said.", "<p><i>Said. " * 20000]
    for page in pages:
        begun = time.monotonic()
        assert "Said." in main_text(page)
        assert time.monotonic() - begun < 3


@pytest.mark.parametrize("page, text", [
    (f"<article><div class='article-header'>{LONG}</div><p>{LONG}</p></article>", f"{LONG.strip()} {LONG.strip()}"),
    (f"<article><p>{LONG}</p><div class='comment-header'>no</div><div class='subscribe-header'>no</div></article>", LONG.strip()),
    (f"<div class=header>{LONG[:131]}</div><article><p>{LONG}</p></article>", LONG.strip()),
    (f"<article><p>{LONG}</p><p>Copyright 2020 All rights reserved</p></article>", LONG.strip()),
    (f"<article><p>{LONG}</p><p>Share this with friends</p><p>© 2020 A. B.</p></article>", LONG.strip()),
    (f"<article><p>{LONG}</p><p>Copyright law is dull.</p><p>The end</p></article>", f"{LONG.strip()} Copyright law is dull. The end"),
    (f"<article><p>{LONG}</p><p>All rights reserved.</p></article>", f"{LONG.strip()} All rights reserved."),
    ("<p>Hi there.</p>", "Hi there."),
    ("<h1>Title</h1><p>Hi there.</p><p><a href=1>menu</a></p><p>© 2020 A. B.</p>", "Title Hi there."),
    ("<div><a href=1>menu</a></div><p>Hi there.</p><nav>No text.</nav>", "Hi there."),
    ("text without tags", "text without tags"), ("a &lt; b\n c", "a < b c"), ("<nav>Home.</nav><footer>No.</footer>", ""),
])
def test_names_notices_and_short_pages(page, text):
    assert main_text(page) == text
