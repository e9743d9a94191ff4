"""Pages are parsed once and regular ones without the tokenizer; both ways give the same elements."""

import random

from pagequarry.functions import urls
from pagequarry.operators import html, links

_ALL = lambda tag, style: tag in html.TAGS or "background" in style
_BITS = ["<a href='x&amp;y'>", "<A HREF=/a/b/>", '<img src="a" src=\'b\' alt>', "<br/>", "</p>", "<p>", "<div style='background:url(a)'>", "</div>", "<script>if(a<b){}</script>", "<script src=a/>", "<script/>", "<style>a{background:x}</STYLE>", "<!-- a - b -->", "<!-- a -- b --->", "<!doctype html>", "< a", "&lt;", "text ", "<video>", "</video>", "<source src=a>", "<a b", '"', "'", ">", "<a\x0bhref=x>", "<![CDATA[x]]>", "<?x?>", "</a b>", "<a x=1y=2>", "<a x='1'y='2'>", "<a x = '1'>", "<p\n class=\"k\"\t>", '<a b="<c>">', "<é>"]


def _tokenized(text):
    p = html._Elements(None, _ALL)
    p.feed(text)
    return p.rows


def test_regular_pages_need_no_tokenizer():
    page = '<!DOCTYPE html><html><head><meta property="og:image" content="/a?b=1&amp;c"></head><body><picture><source srcset="/p.avif"></picture><script>var a = "<b>";</script><video src=/v.mp4 title=\'V\'><source src="/v.m3u8"></video></body></html>'
    assert html._regular_elements(page, _ALL) == _tokenized(page) and len(_tokenized(page)) == 6
    rnd, regular = random.Random(1), 0
    for _ in range(5_000):
        text = "".join(rnd.choice(_BITS) for _ in range(rnd.randint(1, 9)))
        rows = html._regular_elements(text, _ALL)
        assert rows is None or rows == _tokenized(text), text
        regular += rows is not None
    assert regular > 1_000


def test_videos_are_found_in_one_pass(spark):
    page = '<video title="T" poster="/o.jpg" src="/a.mp4"><source src="/b.m3u8"><source src="/a.mp4"></video><p><source src="/no.mp4"></p>'
    pages = spark.createDataFrame([(1, "https://a.example.com/", page), (2, "https://a.example.com/2", '<video aria-label="L"><source src="/c.webm"></video>')], "page_id long, url string, html string")
    found = html.detect_videos(html.html_elements(pages))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r.page_id, r.video_url.rpartition("/")[2], r.source_type, r.thumbnail_url, r.title) for r in found.collect()}
    assert got == {(1, "b.m3u8", "hls-js", "/o.jpg", "T"), (1, "a.mp4", "source", "/o.jpg", "T"), (2, "c.webm", "source", None, "L")}


def test_elements_asked_for_by_name_keep_numbers_and_parents(spark):
    pages = spark.createDataFrame([(1, "https://a.example.com/", '<p><a href="/x">x</a><picture><source srcset="/s.jpg"></picture><div style="background:url(/b.jpg)"></div></p>')], "page_id long, url string, html string")
    every = {r.el_no: r for r in html.html_elements(pages).collect()}
    assert [(r.el_no, r.tag, r.parent, r.parent_no) for r in html.html_elements(pages, tags={"source", "style"}).collect()] == [(n, every[n].tag, every[n].parent, every[n].parent_no) for n in (3, 4)]


def test_clean_urls_are_resolved_alike_by_the_short_way():
    rnd, short = random.Random(2), 0
    ends, bits = ["", "c", "/", "d;e", "?q=1", "#z", ":80", "..", "//"], ["a", ".", "..", "/", "?", "x=1", "#f", "%20", " ", "https://h.x", "//", "é", "\n", "b.c", ":443/", "user@", ";p"]
    for _ in range(20_000):
        raw, base = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 6))), "https://a.b" + "".join(rnd.choice(ends) for _ in range(rnd.randint(0, 4)))
        url = urls._plain(raw, urls._plain_base(base))
        short += url is not None
        assert url is None or url == urls._resolve(raw, base, True) == urls._resolve(raw, base, False), (raw, base)
    assert short > 100


def test_links_are_resolved_once(spark):
    page = '<a href="/x">x</a><a href="b.jpg">b</a><a href="http://[bad">c</a><a href="#f">d</a><a href="/logout">e</a><a href="../y?q=1#z">f</a>'
    pages = spark.createDataFrame([(1, "https://a.example.com/p/", page), (2, "https://a.example.com/", None)], "page_id long, url string, html string")
    for found in (links.page_links(pages), links.extract_links(html.html_elements(pages, tags={"a"}))):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        assert {(r.page_id, r.link) for r in found.collect()} == {(1, "https://a.example.com/x"), (1, "https://a.example.com/y?q=1")}
