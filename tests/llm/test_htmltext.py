import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm.htmltext import Page, extract, host_of


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""), ("<", "<"), ("a < b &copy &amp;lt; &#233;&nbsp;x", "a < b © &lt; é x"), ("<p title=\"a>b\">q", "q"),
        ("<body><nav>m</nav><p>One<p>Two <b>th</b>ree\n\n four<br>five<table><tr><td>a<td>b</table><ul><li>q<ul><li>r</ul></ul></body>", "One Two three four five a b q r"),
        ("<article><h1>T</h1><p>x<script>if(a<b)\"</p>\"</script>y</p></article><aside>s</aside>", "T xy"),
        ("<div class='site-header'>h</div><div id=cookieNotice>c</div><main><p>t</p><form>f</form></main><footer>z</footer>", "t"),
        ("<article>a<section class=\"comments\">c</section></article><article class=comment>d</article><div class=ad>e</div>", "a"),
        ("<body class='no-sidebar'><p class='has-sidebar'>k<!-- no --><p hidden>h<p style='display: none'>n<div role=navigation>v", "k"),
        ("<style>p{}</style><title>t</title><p>a</p><textarea><p>x</textarea><noscript>n</noscript>", "a"), ("<![CDATA[x]]><?php y ?>z", "xz"), ("<b>" * 3000 + "deep", "deep"),
        ("<p>A</p>tail<h2>B</h2>", "A tail B"), ("<ul><li>a<li>b</ul>", "a b"), ("x<p a=\"unclosed>y <i>z", "x y z"),
    ],
)
def test_pages(source, text):
    assert Page(source).text() == text


@given(st.text(alphabet="<>/!-ab \"'=&;pdiv", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text_is_read(source):
    assert isinstance(Page(source).text(), str)


def site(i, host, template):
    body = f"<div><span>{template}</span> bar</div><p>article {host} {i} of its own</p><div>bottom line of {host}</div>"
    return (i, f"https://User@{host.upper()}:80/{i}?q", f"<html><body>{body}</body></html>")


def test_site_templates_are_deleted(spark):
    rows = [site(i, "a.example", "welcome") for i in range(8)] + [site(i, "b.example", "hello") for i in range(8, 11)]
    # copies of one page are one page, so their article is no template
    rows += [(100 + i, f"http://c.example/{i}", "<p>the same article</p><p>twice</p>") for i in range(30)]
    rows += [(200, None, "<p>no host</p>"), (201, "not a url", None), (None, "http://a.example/x", ""), (0, *site(0, "a.example", "welcome")[1:])]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, subtrees int, text string")
    got = extract(pages)
    assert sorted(got.columns) == ["page_id", "subtrees", "text", "url"]
    text = sorted((str(r.page_id), r.text) for r in got.collect())
    want = [(i, f"article a.example {i} of its own") for i in range(8)] + [(0, "article a.example 0 of its own")]
    want += [(i, f"hello bar article b.example {i} of its own bottom line of b.example") for i in range(8, 11)]
    want += [(100 + i, "the same article twice") for i in range(30)] + [(200, "no host"), (201, ""), (None, "")]
    assert text == sorted((str(i), t) for i, t in want)


def test_hosts(spark):
    urls = spark.createDataFrame([("https://U:p@Host.Example:8080/x",), (None,), ("//x",), ("ftp://h",)], "url string")
    assert [r.h for r in urls.select(host_of("url").alias("h")).collect()] == ["host.example", "", "", "h"]


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_closing_tags_find_their_element_at_any_depth():
    for n in (10, 255, 256, 5000):
        page = Page("<div class=nav>menu " + "<b>" * n + "</div><article>the text</article>")
        assert page.text() == "the text", n
        page = Page("<ul><li class=ad>advert" + "<b>" * n + "<li>the item</ul>")
        assert page.text() == "the item", n


@pytest.mark.parametrize(
    "source,text",
    [
        ("<main><div>the story of the day, told at length</div><article>first reader says hi</article></main>", "the story of the day, told at length"),
        ("<article><header><h1>Headline</h1><p>by someone</p></header><p>body</p></article>", "Headline body"),
        ("<header><h1>Site</h1></header><article><p>body</p></article>", "body"),
        ("<article><p>a long enough story</p><article>a reader</article></article>", "a long enough story"),
        ("<article>one teaser</article><article>another teaser</article>", "one teaser another teaser"),
        ("<main><p>intro</p><article>the article is the larger part</article></main>", "the article is the larger part"),
    ],
)
def test_the_article_is_chosen_by_its_text(source, text):
    assert Page(source).text() == text


def big_site(n):
    """Pages of one host: a menu of a section on 40 % of them, a line that many articles share, own texts."""
    out = []
    for i in range(n):
        menu = "<div><p>section menu</p><p>more of it</p></div>" if i % 5 < 2 else ""
        line = "<p>This line stands in many articles.</p>" if i % 2 else ""
        note = f"<div><p>notice of the month {i % 3}</p></div>"
        out.append((i, "http://big.example/x", f"<body>{menu}<div id=content><p>page {i} has a text of its own that is long enough to be most of it</p>{line}<p>end {i}</p></div>{note}</body>"))
    return out


def brute_texts(rows, share, least, many):
    """The definition, on parsed pages held in one process."""
    pages = [Page(h) for _, _, h in rows]
    seen = {}
    for p in pages:
        for h in {h for h in p.hashes[1:] if h}:
            seen.setdefault(h, set()).add(p.hashes[0])
    n = len({p.hashes[0] for p in pages})
    always = frozenset(h for h, own in seen.items() if len(own) >= least and len(own) >= share * n)
    often = frozenset(h for h, own in seen.items() if len(own) >= many) - always
    return [p.text(always, often) for p in pages]


def test_recurring_subtrees_go_outside_the_block_of_the_text_only(spark):
    rows = big_site(100)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for (i, _, _), text in zip(rows, brute_texts(rows, 0.6, 5, 20), strict=True):
        line = "This line stands in many articles. " if i % 2 else ""
        assert got[i] == text == f"page {i} has a text of its own that is long enough to be most of it {line}end {i}"


def test_very_long_and_repeated_pages(spark):
    long = "<body><div>menu</div><article>" + "".join(f"<p>paragraph {i} with words</p>" for i in range(40_000)) + "</article></body>"
    deep = "<div>" * 10_000 + "deep text" + "</div>" * 10_000
    rows = [(1, "http://a/", long), (1, "http://a/", long), (2, "http://a/", deep), (3, None, None), (4, "http://a/", "")]
    got = sorted((r.page_id, r.text) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = " ".join(f"paragraph {i} with words" for i in range(40_000))
    assert got == [(1, want), (1, want), (2, "deep text"), (3, ""), (4, "")]
