import html
import re

from helpers import SF
from pyspark.sql import functions as F

from tally.llm import html_extract as hx


def article(page):
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    blocks = re.sub(r"</?(?:p|h1)>", "\0", m[1] if m else "")
    blocks = html.unescape(re.sub(r"<[^>]*>", "", blocks))
    return "\n\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in blocks.split("\0")) if x)


def test_articles_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in hx.extract(pages, keep=["page_id"]).collect()}
    assert got == want


def test_articles_renamed_to_div(spark):
    """Without the element that names the article, template and other rules leave the same text."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    renamed = pages.withColumn("html", F.regexp_replace("html", r"(</?)article\b", "$1div"))
    got = {r["page_id"]: r["text"] for r in hx.extract(renamed, keep=["page_id"]).collect()}
    assert got == want


def test_boilerplate_goes_and_text_stays():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar">
    <header>Site</header><nav><a>Menu</a></nav><aside>Side</aside><div class="cookie-notice">We use cookies</div>
    <article><header>By me</header><h1>Head &amp; tail</h1><p>One <b>bold</b>
       word &lt;b&gt;<br>next</p><script>var x = "<p>no</p>";</script><!-- <p>no</p> --><p>Two<p>Three &#233;
    <form><input><button>Send</button></form><div class="ad">Buy</div><ul><li>a<li>b</ul>
    <div id="comments"><p>First!</p></div></article><div class="share">Share</div><footer>&copy; x</footer></body></html>"""
    assert hx.main_text(page) == "Head & tail\n\nOne bold word <b> next\n\nTwo\n\nThree é\n\na\n\nb"
    assert hx.main_text("") == "" and hx.main_text("<p>a < b</p> x") == "a < b\n\nx"
    assert hx.main_text("<body><div>only <i>text</i></div>") == "only text"
    assert hx.main_text("<article></article><p>outside</p>") in ("", "outside")


def test_wrappers_are_no_boilerplate():
    article = "<article><h1>T</h1><p>Main words here.</p></article>"
    rest = "<nav>Menu</nav><div class='sidebar'>Side</div><footer>Foot</footer>"
    for wrap in ("<form action=x>{}</form>", "<div class='layout-no-sidebar'>{}</div>", "<div class='with-header'>{}</div>",
                 "<div class='page has-banner'>{}</div>", "<div class='elementor-widget'>{}</div>",
                 "<form><div class='with-header'><div id=widget-1>{}</div></div></form>"):
        assert hx.main_text(f"<body>{wrap.format(article + rest)}</body>") == "T\n\nMain words here.", wrap
        assert hx.main_text(f"<body>{rest}{wrap.format(article)}</body>") == "T\n\nMain words here.", wrap
        assert hx.main_text(f"<main>{wrap.format(article)}</main>") == "T\n\nMain words here.", wrap
        for plain in ("div", "section", "main"):
            page = wrap.format(f"<{plain}><p>Main words here.</p><p>And more of them, longer than what stands beside.</p></{plain}>" + rest)
            assert hx.main_text(page) == "Main words here.\n\nAnd more of them, longer than what stands beside.", (wrap, plain)
    # a sidebar beside the text stays a sidebar, also around a teaser
    assert hx.main_text("<div>Text of the page itself</div><div class=sidebar><article>Teaser</article></div>") == "Text of the page itself"
    assert hx.main_text("<article>Text</article><div id=comments><article>First! And a long comment.</article></div>") == "Text"
    assert hx.main_text("<div>Text</div><div id=comments><article>First! And a long comment.</article></div>") == "Text"
    assert hx.main_text("<article><div class='with-header'>x</div><div class=notice>A longer note than the text</div><p>y</p></article>") == "y"


def test_teasers_beside_a_main_element():
    text = "<main><h1>T</h1><p>Main words, more than a teaser has.</p>{}</main>{}"
    for page in (text.format("", "<article>Teaser</article>"), text.format("<article>Teaser</article>", ""),
                 text.format("", "<aside><article>Teaser</article></aside>")):
        assert hx.main_text(page) == "T\n\nMain words, more than a teaser has."
    assert hx.main_text("<main><p>Intro</p><article><p>The long text of the article</p></article></main>") == "The long text of the article"


def test_marked_paragraphs_and_parts_of_lines():
    page = ("<article><p class='advert'>Buy</p><p>One <span class='ad'>Buy <span>now</span> here</span> two</p><p hidden>Gone<p>Three"
            "<a class='share' href=x>Share</a><div>four <b style='display:none'>no</b>five <a class='nav-link'>six</a> "
            "<span class=ad>unclosed</div><p>seven <i class='ad'/>eight</p></article>")
    assert hx.main_text(page) == "One two\n\nThree\n\nfour five six\n\nseven eight"


def test_template_without_semantic_elements(spark):
    """No article, no telling names: the template's own words go, the slots' words stay."""
    page = ("<html><body><div class=a1><span>Home</span><span>About us</span></div><div class=b2><p>{0}</p><p>{1}</p></div>"
            "<div class=c3>All rights kept by the site</div></body></html>")
    rows = [(i, f"http://h.example/{i}", page.format(f"first words of story {i} go here", f"and more of them {i * 7}")) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), keep=["page_id"]).collect()}
    for i in range(20):
        assert got[i] == f"first words of story {i} go here\n\nand more of them {i * 7}"


def test_copied_articles_are_no_template(spark):
    page = "<html><body><nav>Menu</nav><article><p>Same text</p><p>{0}</p></article></body></html>"
    rows = [(i, "http://h.example/x", page.format("copy")) for i in range(30)] + [(99, "http://h.example/y", page.format("own"))]
    got = {r["page_id"]: r["text"] for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Same text\n\ncopy" and got[99] == "Same text\n\nown"


def _texts(spark, pages):
    rows = [(i, "http://h.example/x", page) for i, page in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), keep=["page_id"]).collect()}
    return [got[i] for i in range(len(pages))]


def test_copied_pages_without_article_keep_their_text(spark):
    page = "<html><body><div class=a1><p>Same text</p><p>{0}</p></div></body></html>"
    got = _texts(spark, [page.format("copy")] * 30 + [page.format("own")])
    assert got == ["Same text\n\ncopy"] * 30 + ["Same text\n\nown"]


def test_page_kinds_have_templates_of_their_own(spark):
    blog = "<html><body><div class=b1><span>Read our blog</span><span>Every week</span></div><div class=b2><p>story {0} told</p></div></body></html>"
    shop = "<html><body><div class=s1><span>Basket</span><span>Fast delivery</span></div><div class=s2><p>thing {0} sold</p></div></body></html>"
    got = _texts(spark, [x.format(i) for i in range(20) for x in (blog, shop)])
    assert got == [x.format(i) for i in range(20) for x in ("story {0} told", "thing {0} sold")]


def test_all_slots_stay(spark):
    page = ("<html><body><div class=a1><span>Home</span><span>About us</span></div><div class=b2><p>intro {0}</p><div class=c3><p>{1}</p></div>"
            "<div class=d4><p>second part {0}</p></div></div></body></html>")
    got = _texts(spark, [page.format(i, f"a long first part {i} " * 9) for i in range(20)])
    assert got == [f"intro {i}\n\n{(f'a long first part {i} ' * 9).strip()}\n\nsecond part {i}" for i in range(20)]


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "", "", "x"), (None, "no scheme", "<article>a", "x"), (4, "http://h/", "<" * 50, "x"),
            (5, "http://h/", "<p>" * 20_000 + "end", "x"), (6, "http://h/", "plain " * 20_000, "x"), (1, None, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, template string")
    out = hx.extract(pages)
    assert out.columns == [*pages.columns, "text"] and out.count() == len(rows)
    texts = {r["page_id"]: r["text"] for r in out.collect()}
    assert texts[1] == "" and texts[2] == "" and texts[None] == "a" and texts[5] == "end" and len(texts[6]) == 6 * 20_000 - 1
    assert hx.extract(pages.where("false")).count() == 0
