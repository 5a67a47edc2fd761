import time

import pytest
from evalspark.llm.html_text import extract_pages, furniture_name, main_text

BODY = "<p>The article's first paragraph is long enough to read &amp; has <b>bold</b> words.</p><p>Short.</p><p>Another   long\n paragraph of the article with many words in it.</p>"
TEXT = "The article's first paragraph is long enough to read & has bold words.\n\nShort.\n\nAnother long paragraph of the article with many words in it."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{BODY}</article><footer>&copy; site</footer></body></html>",
        f"<body><header><h2>Site</h2></header><div class='sidebar'><p>Read these other pages of ours</p></div><main>{BODY}</main><div id='comments'><p>I liked this article very much indeed, thanks.</p></div>",
        f"<div class='ad'>Buy now</div><article>{BODY}<aside>Related</aside><form><input><label>Mail</label></form></article><div class='cookie-notice'>We use cookies on this site</div>",
        f"<div id=menu><a href=a>A</a> <a href=b>B</a></div><div class=content>{BODY}</div><div class='footer'>All rights</div>",
    ],
)
def test_articles(page):
    assert main_text(page) == TEXT


SIDE = "<nav><a href=/>Home</a></nav><div class=sidebar><p>Read these other pages of ours</p></div>"
COMMENTS = "<div id=comments>" + "<p>I liked this article very much indeed, thanks to all who wrote it for us.</p>" * 9 + "</div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div id='content-sidebar-wrap'><div class=content>{BODY}</div>{SIDE}</div></body>",
        f"<body><div id='content-sidebar-wrap'><main>{BODY}</main>{SIDE}</div><footer>x</footer></body>",
        f"<body><p>Skip</p><div class='page has-sidebar'>{SIDE}<article>{BODY}</article>{COMMENTS}</div></body>",
        f"<body>{SIDE}<article class='post category-social comments-open'>{BODY}</article>{COMMENTS}</body>",
        f"<body>{SIDE}<div class=content>{BODY}</div>{COMMENTS}</body>",
        "<body>" + SIDE + "<div class=content>" + "".join(f"<div class='x-widget'>{p}</p></div>" for p in BODY.split("</p>")[:-1]) + "</div></body>",
    ],
)
def test_furniture_words_on_what_holds_the_article(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize("name", ["layout no-sidebar", "post comments-open", "hasSidebar", "category-social", "page share-price"])
@pytest.mark.parametrize("where", ["<div class='{}'><article>{}</article></div>", "<article class='{}'>{}</article>", "<div class='{}'><div class=content>{}</div></div>"])
def test_names_that_only_contain_a_furniture_word(name, where):
    assert main_text(f"<body>{SIDE}{where.format(name, BODY)}{COMMENTS}<div class='siteFooter'>About us</div></body>") == TEXT


def test_only_whole_names_speak():
    assert all(map(furniture_name, ["sidebar", "site-footer", "cookie_notice", "navBar", "related-posts", "ad1"]))
    assert not any(map(furniture_name, ["no-sidebar", "share-price", "comments-open", "content-sidebar-wrap", "header", "post", "", "x-widget"]))
    page = f"<article>{BODY}<p class='share-price'>Up 3 percent</p><div class='share-buttons'>Post it</div></article>"
    assert main_text(page) == TEXT + "\n\nUp 3 percent"


@pytest.mark.parametrize("head", ["<div>", "<b>", "<div class=sidebar>", "<table><td><ul><div>", "<ul><li>"])
def test_deep_nesting_costs_no_more_than_its_length(head):
    start = time.process_time()
    assert main_text(head * 50_000 + "<p>text here</p><td>x" * 2_000).startswith("text here\n\n")
    assert time.process_time() - start < 20


def test_short_lines_of_a_container_stay():
    long = "<p>" + "A long paragraph of the article with many words in it. " * 12 + "</p>"
    page = f"<body><ul><li><a href=a>A</a></ul><div class=content><h1>Head</h1><p><i>By</i> <b>me</b></p><p>1 May</p><p>Hm.</p><p>So.</p>{long * 3}<p>Yes.</p><p>No.</p><p>Ah.</p><p>Well.</p><p>The end.</p></div><p>Foot</p></body>"
    got = main_text(page).split("\n\n")
    assert got[:5] == ["Head", "By me", "1 May", "Hm.", "So."] and got[8:] == ["Yes.", "No.", "Ah.", "Well.", "The end."]
    one = f"<body><div class=content><h1>Head</h1>{long}<p>The end.</p></div></body>"
    assert main_text(one).split("\n\n")[::2] == ["Head", "The end."]


def test_broken_markup_and_references():
    assert main_text("<article><h1>Head</h1><p><b>One open &lt;tag&gt;<br><p>Two&nbsp;&eacute;&#233; end") == "Head\n\nOne open <tag>\n\nTwo éé end"


def test_every_page_of_the_table(spark):
    out = extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    import re
    from html import unescape

    for r in out:
        article = html[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_hard_pages_and_empty_table(spark):
    rows = [(1, None, None, "x"), (2, "u", "", None), (3, "u", "<p>", "x"), (4, "u", "no tags at all", "x"), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000, "x"), (6, "u", "<article>" + "<p>word </p>" * 30_000 + "</article>", "x"), (6, "u", "<nav>only menu</nav>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in extract_pages(df).collect()]
    assert got[:5] == [(1, ""), (2, ""), (3, ""), (4, "no tags at all"), (5, "deep")]
    assert got[5][1].count("word") == 30_000 and got[6][1] == ""
    assert extract_pages(df.limit(0)).count() == 0


LONG = "text and more " * 30


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>Some text here <script>var a = 1;</script> goes on.</p></article>", "Some text here goes on."),
        (f"<article><p>{LONG}</p><script>var a = 1;</script><p>{LONG}</p></article>", f"{LONG.strip()}\n\n{LONG.strip()}"),
        *[(f"<article><p>{LONG}{x}</p></article>", LONG.strip()) for x in ("<style>p{color:red}</style>", "<button>Go</button>", "<select><option>x</option></select>", "<textarea>t</textarea>", "<noscript>n</noscript>", "<iframe>f</iframe>", "<svg><text>s</text></svg>", "<span hidden>H</span>", "<span class='ad'>BUY</span>", "<b style='color:red; display : none'>no</b>")],
        *[(f"<main><p>{LONG}</p><div class='{x}'><p>read this as well</p></div></main>", LONG.strip()) for x in ("comment-body", "ad-slot", "cookie-law-info", "gdpr-overlay")],
        (f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>", f"{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<div class='left-col'><p>{LONG}</p></div><article><p>Short news.</p></article>", "Short news."),
        (f"<article><p>{LONG}</p></article><!-- {LONG}", LONG.strip()),
        (f'<article><p>{LONG}</p></article><a href="{LONG}', LONG.strip()),
        (f"<article><p>{LONG}</p></article><script>{LONG}", LONG.strip()),
        (f"<article><p>{LONG}</p><script>a = '<!--';</script><p>{LONG}</p></article>", f"{LONG.strip()}\n\n{LONG.strip()}"),
        ("<article><p>a &lt; b <c</p></article>", "a < b"),
    ],
)
def test_nothing_skipped_speaks_and_no_article_is_lost(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("begin", ["<!-- ", '<a href="', "<div ", "<script>", "<p>", "&", "<![CDATA["])
def test_what_is_never_closed_costs_its_length(begin):
    def seconds(n):
        start = time.perf_counter()
        main_text(f"<article><p>{LONG}</p></article>{begin}" + "x y " * n)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(400_000) < 12 * max(0.05, seconds(100_000))
