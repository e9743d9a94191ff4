"""Pictures of pages in one pass, against the detectors and the merge that go over rows."""

import random

from pyspark.sql import functions as F

from pagequarry.operators import html, pictures
from pagequarry.plans import catalog
from tests.conftest import DATA

_SCHEMA = "page_id long, url string, html string"
_URLS = ["/a.jpg", "/a.jpg?w=5", "/a.jpg?W=5&q=1", "/a.jpg?id=1", "/a.jpg?w=5&", "/a.jpg?&&", "a.jpg", "./a.jpg", "../a.jpg", "/thumb_a.jpg", "/THUMB_a.jpg?w=1", "/thumb_thumb_a.jpg", "/thumb_", "/x/thumb_a/b.jpg", "/p?x=/thumb_a.jpg", "/b.PNG#f", "//h.com/a.jpg", "HTTP://H.com:80/a.jpg", "https://h.com", "https://h.com?x.jpg", "ftp://h.com/a.jpg", "data:image/png;base64,x", " data:x", "blob:https://x/y", "mailto:x", "/ä.jpg", "/a b.jpg", "/a\nb.jpg", "/a.jpg\n", "", " ", "#", "?q=a.jpg", "/a&amp;b.jpg?x=1&amp;y=2", "http://[bad", "/a.jpg/", "/.a.jpg", "/a/../a.jpg", "/media/r/q.jpg", "/MEDIA/R/q.webp", "\\a.jpg", "/a.toolong", "/a.b.tiff", "/a.j"]
_SETS = ["/a.jpg 1x, /b.png 2x", "/a.jpg 100w,/a.jpg 200.5w , /c.gif 1.5.2w", "/a.jpg  7h", "/a.jpg\t7w", "/a.jpg 7w\n", "/a.jpg 7w\r\n", "/a.jpg\r", "/a.jpg\n\r", "/a.jpg 7w\u2028", "/a.jpg\u2029", "/a.jpg\x85", "/a.jpg\xa07w", "\n/a.jpg 7w", "/a.jpg 7q", "/a.jpg 7 w", ",,", "/thumb_a.jpg 9w, /a.jpg?w=3 9w, /a.jpg 9w, /a.jpg 9w", "/a.jpg .w", "/a.jpg 2147483647w", "data:x 1w, /a.jpg?w=9 8w"]
_STYLES = ["background:url(/a.jpg)", "background-image: url( '/b.png' ), url(\"/c.gif\" )", "background:url()", "background:url( /a.jpg\n )", "background:url(data:x)", "background:url(var(--x))", "background:url('a)b.jpg')", "background:url(a'b)", "color:red", "BACKGROUND:url(/a.jpg)", "background:url(/a.jpg", "background:url('/thumb_a.jpg') url(/a.jpg)"]
_BASES = ["https://x.com/p/", "https://x.com/p/q.html?a=/b", "https://x.com", "http://x.com:81/a/./b", "HTTPS://X.com/", "https://x.com/thumb_p/", "about:blank", "", None]


def _element(rnd):
    url, srcset, style, words = (rnd.choice(x) for x in (_URLS, _SETS, _STYLES, ["", "alt=A", "title=T alt=''", "title='t'", "ALT=&lt; alt=no"]))
    said = rnd.choice(["", f"style=\"{style.replace(chr(34), '&quot;')}\"", "style"])
    return rnd.choice(
        [
            f'<img src="{url}" {words} {said}>', f'<img srcset="{srcset}" src="{url}" {words}>', f'<img data-srcset="{srcset}" srcset="" {words}>', f'<img data-src="{url}" data-url="{srcset}" data-echo=" {url} " {words}/>',
            f'<picture {said}><source srcset="{srcset}" {words}></picture>', f'<source srcset="{srcset}" {words}>', f'<picture><p><source srcset="{url}"></picture>', f'<a href="{url}" {words} {said}>x</a>',
            f'<meta property="og:image" content="{url}">', f'<meta name="twitter:image" itemprop="image" content="{url}">', f'<meta property="og:image:url" name="twitter:image:src" content="{url}" {words}>',
            f'<link rel="icon image_src" href="{url}">', f'<link rel="image_src\xa0x" href="{url}">', f'<link rel="\nimage_src" {said} href="{url}">', f'<input type="Image" src="{url}" {words}>', f'<input type="text" src="{url}">',
            f"<div {said}>{url}</div>", f"<script>var a = '{url}', b = '<img src=/no.jpg>';</script>", "< <b", "<!-- <img src=/no.jpg> -->", f"<video src='{url}'></video>", "</p>", "text", "<style>p{}</style>",
        ]
    )


def _row(r):
    return (r.page_id, r.image_url, r.source_type, tuple(map(tuple, r.variants)), r.alt, r.title, tuple(r.place))


def test_one_pass_gives_what_detectors_and_merge_give(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(_BASES[:6] * 3 + _BASES), "".join(_element(rnd) for _ in range(rnd.choice((1, 2, 3, 30))))) for i in range(1_500)]
    rows += [(1_500, "https://x.com/", None), (1_501, "https://x.com/", ""), (1_502, "https://x.com/", "<img src=/1.jpg>" * 5_000)]
    pages = spark.createDataFrame(rows, _SCHEMA).repartition(4).cache()
    want = sorted(map(_row, html.merge_page_hits(html.detect_images(pages)).collect()), key=repr)
    listed = pictures.page_pictures(pages)
    got = sorted(map(_row, listed.collect()), key=repr)
    assert got == want and len({r[6][0] for r in got}) == 9 and max(len(r[3]) for r in got) > 3
    told = ["page_id", "image_url", "source_type", "alt", "title"]
    counted = pictures.page_pictures(pages, counted=True)
    assert counted.columns == [*told, "variants"] and sorted(counted.collect(), key=repr) == sorted(listed.select(*told, F.size("variants").alias("variants")).collect(), key=repr)


def test_pages_of_one_number_are_pages_of_their_own(spark):
    pages = spark.createDataFrame([(1, "https://x.com/", '<img src="/a.jpg">'), (1, "https://y.com/", '<img src="/a.jpg">'), (1, "https://x.com/", '<img src="/a.jpg">')], _SCHEMA)
    assert sorted(r.image_url for r in pictures.page_pictures(pages).collect()) == ["https://x.com/a.jpg", "https://x.com/a.jpg", "https://y.com/a.jpg"]


def test_sizes_that_are_no_int_are_unknown(spark):
    pages = spark.createDataFrame([(1, "https://x.com/", '<img srcset="/a.jpg 99999999999w, /b.jpg 2147483648h, /c.jpg 2147483647w">')], _SCHEMA)
    assert [v.width for v in pictures.page_pictures(pages).first().variants] == [2147483647, None, None]


def test_hits_of_page_images_go_through_no_shuffle(spark):
    plan = catalog.queries()["page_images"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "ArrowEvalPython" not in plan
