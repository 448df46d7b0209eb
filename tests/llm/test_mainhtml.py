import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mainhtml
from tests.conftest import SF, SF01


def marked(page):
    """Brute force for pages that mark their article: its text without markup."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    blocks = re.sub(r"</?(h1|p|br)>", " ", m[1]) if m else ""
    return " ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", blocks)).split())


@pytest.fixture(scope="module")
def trees(spark):
    return mainhtml.fit(spark.read.parquet(f"{SF01}/pages.parquet"))


def test_query_on_a_whole_table(spark):
    from tessera.llm.queries import op10_main_text

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op10_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    assert all(r.text == marked(pages[r.page_id]) and r.n_chars == len(r.text) for r in got)


def test_other_templates(trees):
    body = "<h1>Title of it</h1><p>First words, <b>bold</b>er &amp; more; some sentences follow here. And more of them, at length.</p><p>Second one with enough words in it to count as text, really.</p>"
    want = "Title of it First words, bolder & more; some sentences follow here. And more of them, at length. Second one with enough words in it to count as text, really."
    for opens, closes, before, after in mainhtml.VARIANTS:
        page = f"<html><head><title>x</title></head><body><nav><a href='/'>Home</a></nav>{before}{opens}{body}{closes}{after}<footer>f</footer></body></html>"
        assert " ".join(mainhtml.extract(page.replace("{0}", "some other words"), trees)) == want


def test_templates_that_training_never_shows(trees):
    """Names and nestings of site builders that are in no list of the module."""
    body = "<h2>A headline of this one</h2><p>It begins with a sentence, and goes on for a while; there is more to say here. Then it says more.</p><p>A second paragraph, as long as the first one, with several words and some commas, to be read.</p>"
    want = "A headline of this one It begins with a sentence, and goes on for a while; there is more to say here. Then it says more. A second paragraph, as long as the first one, with several words and some commas, to be read."
    head, menu, foot = "<html><head><title>t</title></head><body>", '<ul class="topnav"><li><a href="/">Home</a></li><li><a href="/b">B</a></li><li><a href="/c">C</a></li></ul>', '<div id="colophon"><p>Copyright by someone, all kinds of rights</p></div></body></html>'
    pages = [
        f'{head}<form id="aspnetForm" action="x.aspx">{menu}<article>{body}</article>{foot.replace("</body>", "</form></body>")}',
        f'{head}<div class="wrap search">{menu}<article>{body}</article></div>{foot}',
        f'{head}<div id="wpwrap"><nav>{menu}</nav><main class="site-main"><article>{body}</article></main></div>{foot}',
        f'{head}<article><header><p>By some writer, on a day</p></header>{body}<footer><p>Filed under things</p></footer></article>{foot}',
    ]
    for page in pages:
        assert " ".join(mainhtml.extract(page, trees)) == want, page[:200]


def test_no_descendant_of_a_rejected_element_is_kept():
    rng = np.random.default_rng(1)
    for _ in range(200):
        tags = rng.choice(["<div>", "</div>", "<p>", "<b>", "</b>", "x. ", "<nav>", "</nav>", "<article>", "<br>", "<li>", "<script>", "<!-- "], 40)
        nodes = mainhtml.elements(mainhtml.parse("".join(tags)))
        keep = mainhtml.decode(nodes, rng.normal(0, 3, len(nodes)))
        for node in nodes:
            up = node.parent
            if up and keep[up.at] and not keep[node.at]:
                inner = list(node.children)
                while inner:
                    n = inner.pop()
                    assert not keep[n.at]
                    inner += n.children


def test_edge_rows(spark, trees):
    long = "<body><article><p>" + "word, word. " * 20000 + "</p></article>"
    rows = [(1, None, "u", "x"), (2, "", "u", None), (3, "<article", None, None), (3, "<article", None, None), (None, "plain text", "", None), (5, long, "", None), (6, "<div" * 3000, "", None), (7, "<div>" * 3000 + "deep", "", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, main_text string").withColumn("__html", F.col("url"))
    out = mainhtml.extract_main(df, trees, spans="parts")
    assert out.columns == ["page_id", "html", "url", "__html", "main_text", "parts"]
    got = out.collect()
    assert all(r["__html"] == r.url for r in got)
    assert len(got) == len(rows) and all(r.main_text == " ".join(r.parts) for r in got)
    by = {r.page_id: r.main_text for r in got}
    assert by[1] == by[2] == by[3] == "" and by[5] == ("word, word. " * 20000).strip()
    assert mainhtml.extract_main(df, mainhtml.fit(df.where("false"))).where("main_text <> ''").count() == 0
    assert mainhtml.extract_main(df.where("false"), trees).count() == 0
