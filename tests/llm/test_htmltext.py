import html
import re

from quillstone.llm.htmltext import Extraction, Page, extract_text
from quillstone.llm.queries import op5_html_text

SITE = """<!DOCTYPE html><html><head><title>t{i}</title><script>var a="<p>no</p>";</script></head><body><header><a href="/">Site</a></header>
<div class="cookie-notice">We use cookies</div><div id=x1><div class="c7"><h1>Head {i}</h1><p>First&nbsp;{i} &lt;b&gt;
 <b>bold</b> text<br>more <p>Second {i} {more}<ul><li>one {i}<li>two</ul><div>Share this story</div></div>
<div class="sidebar">Popular {i}</div><div class="comments"><p>Nice {i}</p></div></div><form><label>Mail {i}</label></form><footer>foot</footer></body></html>"""


def page(i, more="words " * 30):
    return SITE.format(i=i, more=more)


def expected(i, more="words " * 30):
    return f"Head {i}\nFirst {i} <b> bold text more\nSecond {i} {more}".strip() + f"\none {i}"  # "two" and "Share" are in every page


def test_template_of_a_host(spark):
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(8)] + [(3, "https://a.example/3", page(3)), (20, "https://lone.example/", "<p>only <i>this</i> page &am")]
    rows += [(21, None, None), (22, "x", ""), (23, "https://a.example/z", "<table><tr><td>cell<td>two</table> < 3 <!-- never closed"), (24, "https://b.example/", "<article><header><h1>T</h1></header>" + "x" * 60_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, host string").repartition(3)
    for p in (Extraction(), Extraction(broadcast_hosts=0)):
        got = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in extract_text(pages, p).collect())
        assert [r[2] for r in got[:9]] == [expected(i) for i in sorted([*range(8), 3])]
        rest = {r[0]: r[2] for r in got[9:]}
        assert rest == {20: "only this page &am", 21: "", 22: "", 23: "cell\ntwo\n< 3", 24: "T\n" + "x" * 60_000}
        assert all(r[3] == len(r[2]) for r in got)
    assert extract_text(pages.limit(0)).collect() == []


def test_small_hosts_are_read_by_element_names():
    assert Page(page(1)).text([], set()).startswith("Head 1\nFirst 1 <b> bold text more\nSecond 1")


def test_names_of_layout_and_names_of_content():
    """Parts of an article whose name merely has a word of layout in it stay; its asides go."""
    kept = ["search-algorithms", "related-work", "share-prices", "alert-systems", "navigation-history", "comment-culture", "header-files"]
    gone = ["related-posts", "share", "social-links", "post-comments", "ad", "advertisement", "cookie-banner", "sidebar-left", "newsletter-signup"]
    parts = "".join(f"<section id='{n}'><p>{n} text</p></section><div class='x {n}'>{n} more</div>" for n in kept + gone)
    assert Page(f"<body><article><h1>Title</h1>{parts}</article></body>").text([], set()).split("\n") == ["Title", *(x for n in kept for x in (f"{n} text", f"{n} more"))]


def test_two_templates_of_a_host(spark):
    """Neither is on half of the pages; a block that most pages of both have is template, one that a few have is text."""
    one = "<html><body><div class=top><a>Home</a></div><div class=story><h1>S{i}</h1><p>{t} s{i}</p><p>Read on</p><p>{m}</p></div><div class=more><p>Latest {i}</p></div></body></html>"
    two = "<html><body><div class=top><a>Home</a></div><table class=list><tr><td><div class=entry><p>{t} e{i}</p><p>Read on</p></div></td></tr></table><div class=more><p>Latest {i}</p></div></body></html>"
    words = "many words of a long and telling text " * 6
    rows = [(i, "http://h/x", (one, two)[i % 2].format(i=i, t=words, m="rare" if i == 2 else f"m{i}")) for i in range(20)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, text in got.items():
        body = f"{words.strip()} e{i}" if i % 2 else f"S{i}\n{words.strip()} s{i}\n" + ("rare" if i == 2 else f"m{i}")
        assert text == body, i


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = op5_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.url == pages[r.page_id].url
