"""Page parsing and link extraction."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import html

PAGE = (
    "<html><head><title>T &amp; x</title>{meta}<script>var a='<p>';</script></head><body><nav><div>long navigation text, "
    "longer than the rest of it all</div></nav><div class='ad'>ad text</div><article><h1>H</h1><p>one<p>two<br>three &copy;"
    "<noscript>no</noscript></article><footer><section>foot</section></footer></body></html>"
)


def parse(spark, pages, mode="intent"):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return [tuple(r["p"]) for r in df.select("i", html.parse_html(F.col("html"), mode).alias("p")).orderBy("i").collect()]


def test_main_content_modes(spark):
    page = PAGE.format(meta="")
    assert parse(spark, [page]) == [("T & x", "H\none\ntwo\nthree ©")]
    # The ad comes first in the body, so with everything after it, it outweighs the article.
    assert parse(spark, [page], "sibling_tail") == [("T & x", "ad text")]
    with pytest.raises(ValueError):
        html.parse_html(F.col("x"), "other")


def test_title_precedence(spark):
    og, twitter = '<meta property="og:title" content=" OG ">', "<meta name='twitter:title' content='TW'>"
    pages = [
        PAGE.format(meta=og),
        PAGE.format(meta=og + twitter),
        "<head><meta property='og:title' content='a'><title></title></head><h1>He<br>ad</h1><h1>second</h1>",
        "<p>none</p>",
        "<head></head><body><title>late</title>x</body>",
    ]
    assert [t for t, _ in parse(spark, pages)] == ["OG", "TW", "Head", "", ""]


def test_text_rules(spark):
    pages = [
        "<div>a<ul><li>b<li>c</ul><section>d</section></div>",
        "plain &amp &#65;&bogus; <svg><svg>x</svg>y</svg>z",
        "<nav><div>long long long long</div></nav><div>ab</div><section>abc</section>",
        "<div><div>inner is the same</div></div>",
        "",
        None,
        "<a title='x>y'>t</a><div",
    ]
    bodies = [b for _, b in parse(spark, pages)]
    assert bodies[:6] == ["a\nb\nc\nd", "plain &amp A&bogus; z", "abc", "inner is the same", "", ""]
    assert bodies[6].startswith("t")


def test_article_wins_only_in_intent(spark):
    page = "<div>a much longer block of text than the article</div><article>short</article>"
    assert [parse(spark, [page], m)[0][1] for m in ("intent", "sibling_tail")] == ["short", "a much longer block of text than the article"]


def test_fragments(spark):
    df = spark.createDataFrame([("<p>a</p><style>x</style><p>b</p>",)], "h string")
    row = df.select(html.node_text(F.col("h")).alias("t"), html.strip_nontext(F.col("h")).alias("s")).first()
    assert (row["t"], row["s"]) == ("a\nb", "<p>a</p><p>b</p>")


LISTING = """
<a href="//finance.yahoo.com/news/1">One <b>bold</b></a>
<a href="https://FINANCE.yahoo.com/NEWS/2?a=1&amp;b=2"> Two </a>
<a href="https://finance.yahoo.com/news/3"><img src=x></a>
<a href="https://finance.yahoo.com/news/3">Three</a>
<a href="https://finance.yahoo.com/quote/4">quote</a>
<a href="https://finance.yahoo.com/news/5">Five<a href="https://finance.yahoo.com/news/6">Six</a>
"""


def links(spark, **kw):
    df = spark.createDataFrame([("p", LISTING)], "page string, html string")
    return [(r["pos"], r["title"], r["link"]) for r in html.extract_links(df, **kw).orderBy("pos").collect()]


def test_links(spark):
    base = "https://finance.yahoo.com/news/"
    assert links(spark) == [
        (0, "One bold", base + "1"),
        (1, "Two", "https://FINANCE.yahoo.com/NEWS/2?a=1&b=2"),
        (2, "Five", base + "5"),
        (3, "Six", base + "6"),
    ]
    # From the end, the filled anchor of link 3 comes first.
    assert [t for _, t, _ in links(spark, order="reverse_dfs", max_links=3)] == ["Six", "Five", "Three"]


def test_hard_markup_is_linear(spark):
    page = "<div>" * 3000 + "x" + "<a href='" * 2000 + "&" * 5000
    assert len(parse(spark, [page])) == 1
