import html
import re

from ledgerlake.llm.html_main_text import PRIOR, extract, fit, main_text, weights

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p[x]</style></head><body><header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav>"
    '<div class="cookie-notice">We use cookies here</div><div id="sidebar"><p>Read this too</p></div>{}<form><input>Search</form>'
    '<section class="comments"><p>First reader comment</p></section><footer>&copy; 2020 Someone</footer>'
)


def test_regions():
    body = "<h1>My  title</h1><script>var t='</p>'</script><p>Hello &amp; welcome to <a href=x>this link</a>.<p>Second\n para<div class=ad-slot>Buy</div><ul><li>one<li>two</ul><!-- x --><blockquote>said <b>he</blockquote>tail"
    want = "My title\nHello & welcome to this link.\nSecond para\none\ntwo\nsaid he\ntail"
    for wrap in ("<article>{}</article>", "<main>{}</main>"):
        assert extract(PAGE.replace("{}", wrap.format(body), 1), PRIOR) == want


def test_edges():
    for page in ("", " ", "<p>", "<nav>only menu</nav>", "<", "<!-- open", "<script>never closed", "<p></p><div/>"):
        assert extract(page, PRIOR) in ("", "<")
    assert extract("plain &lt;text&gt; &#233;&nbsp;x", PRIOR) == "plain <text> é x"
    assert extract("<p>a<br>b</p>", PRIOR) == "a b"
    assert len(extract("<p>" + "word " * 200_000, PRIOR)) == 999_999


def test_held_out_pages(spark):
    """Fitted on half of the pages, exact on the other half, where the article is cut out by its markup."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    w = fit(pages.filter("page_id % 2 = 0"))
    for r in pages.filter("page_id % 2 = 1").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"</?b>", "", inner.replace("<br>", " "))
        blocks = (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"</?(?:p|h1)>", inner))
        assert extract(r.html, w) == "\n".join(b for b in blocks if b)


def test_table(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>é t</p>", "x"), (3, "u", "<p>é t</p>", "x"), (None, "u", "<p>q</p>", "x")], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (3, "u", "é t", 3), (3, "u", "é t", 3), (None, "u", "q", 1)], key=str)
    assert main_text(df.limit(0)).count() == 0
    assert weights({}) == PRIOR
