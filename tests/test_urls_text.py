import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text, urls


def col(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    "raw, base, want",
    [
        ("a.jpg", "https://x.com/p/q", "https://x.com/p/a.jpg"),
        ("//cdn.com/a.jpg#f", "https://x.com/", "https://cdn.com/a.jpg"),
        ("HTTP://X.com:80/a/../b?q=1", None, "http://x.com/b?q=1"),
        ("/èê b", "https://x.com", "https://x.com/%C3%A8%C3%AA%20b"),
        ("a.jpg", None, None),
        ("https://", None, None),
        ("?x=1", "https://x.com/p?y=2", "https://x.com/p?x=1"),
    ],
)
def test_normalize(one, raw, base, want):
    assert one(urls.normalize_url(col(raw), col(base))) == want


def test_fragment_kept(one):
    assert one(urls.normalize_url(col("/a#f"), col("https://x.com"), keep_fragment=True)) == "https://x.com/a#f"


@pytest.mark.parametrize(
    "f, url, want",
    [
        (urls.canonical_url, "https://a.com/x?utm_source=1&b=2#h", "https://a.com/x?b=2"),
        (urls.canonical_url, "https://a.com/x?UTM_SOURCE=1", "https://a.com/x"),
        (urls.canonical_url, "https://a.com/X", "https://a.com/X"),
        (urls.image_variant_key, "https://a.com/i.jpg?w=8&h=2&q=1", "https://a.com/i.jpg"),
        (urls.image_variant_key, "https://a.com/i.jpg?id=1", "https://a.com/i.jpg?id=1"),
        (urls.image_variant_key, "https://a.com/thumb_i.jpg?w=1&id=2", "https://a.com/i.jpg?w=1&id=2"),
        (urls.video_variant_key, "https://a.com/v.mp4?B=2&a=1&token=x#t", "https://a.com/v.mp4?a=1&b=2"),
        (urls.video_variant_key, "blob:https://a.com/1", "blob:https://a.com/1"),
        (urls.expand_thumb_url, "https://a.com/thumb_f.jpg", "https://a.com/f.jpg"),
        (urls.expand_thumb_url, "https://a.com/f.jpg", None),
        (urls.normalize_playback_url, "https://r.googlevideo.com/videoplayback?id=1&range=0-9&rn=2", "https://r.googlevideo.com/videoplayback?id=1"),
        (urls.normalize_playback_url, "https://a.com/v?range=1", "https://a.com/v?range=1"),
        (urls.extension_from_url, "https://a.com/p/F.JPEG?x=.png", "jpeg"),
        (urls.extension_from_url, "https://a.com/p/f", None),
        (urls.is_html_page_url, "https://a.com/a.pdf", False),
        (urls.is_html_page_url, "https://a.com/a.html", True),
        (urls.registrable_domain, "https://a.b.co.uk/x", "b.co.uk"),
        (urls.registrable_domain, "https://a.b.example.com/x", "example.com"),
        (urls.url_basename, "https://a.com/p/q/", "q"),
        (urls.hostname_of, "https://u@A.com:8080/x", "a.com"),
        (urls.content_disposition_filename, "attachment; filename=\"a b.jpg\"", "a b.jpg"),
        (urls.content_disposition_filename, "inline; filename*=UTF-8''%D1%84.png; filename=x", "ф.png"),
        (urls.mime_to_ext, "Image/JPEG; charset=x", "jpg"),
    ],
)
def test_url_functions(one, f, url, want):
    assert one(f(col(url))) == want


def test_srcset(one):
    got = one(urls.parse_srcset(col("a.jpg 800w, b.jpg 2x, c.jpg, bad one two")))
    assert [(x.raw, x.width, x.density) for x in got] == [("a.jpg", 800, None), ("b.jpg", None, 2.0), ("c.jpg", None, None)]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (text.format_bytes, 1280, "1.3 KB"),
        (text.format_bytes, None, "—"),
        (text.format_bytes, 5 << 20, "5.0 MB"),
        (text.format_duration, 3661, "1:01:01"),
        (text.format_duration, 59, "0:59"),
        (text.format_duration_words, 3700, "1 ч 1 мин"),
        (text.format_bitrate, 1500, "1.5 Мбит/с"),
    ],
)
def test_figures(one, f, value, want):
    assert one(f(F.lit(value).cast("double"))) == want


def test_names(one):
    assert one(text.sanitize_filename(col('a<b>:  c?.jpg'))) == "ab c.jpg"
    assert one(text.sanitize_filename(col("???"))) == "image"
    assert one(text.sanitize_filename(col("..Ви́део 😀 -.mp4"), "video")) == "Ви́део -.mp4"
    assert one(text.sanitize_filename(col("é"), "video", compose=True)) == "é"
    none = F.lit(None)
    name = lambda t, title: text.apply_filename_template(t, "2024-01-02", col(title), col(None), none, none, none, col(None), col("MP4"), col(None))
    assert one(name("{title}_{quality}.{ext}", "clip")) == "clip.mp4"
    assert one(name("{title}_{nope}{date}", "clip")) == "clip_2024-01-02"
    assert one(name("{quality}.{ext}", "x")) == "video.mp4"
    assert [one(text.is_obscure_title(col(t))) for t in (None, "Video", "dash_1_2.mpd", "My film")] == [True, True, True, False]
    assert one(text.iso_duration_seconds(col("PT1H2M3.5S"))) == 3723.5
    assert one(text.iso_duration_seconds(col("P1D"))) == 0


def test_plain_resolution_equals_the_helper(spark):
    """Wherever resolve_plain() gives a URL, normalize_url() gives the same one."""
    raws = ["/a", "b.html", "b/c/", "/a/b?x=1&y=/z:1", "?q", "", "#f", "/a#f", "../up", "./a", "a/../b", "/a/./b", "a/..", "//host/x", "https://o.com/c", "HTTP://O.com", "a:b", "a b", "é", "/%41", "/a//b", "/a\\b", "mailto:x", "a?b#c", "/..a/b", "x.y/..z", "/a?", "a/?b", " /a ", "/a{b}", "/a?b=%20", None, "~u/v-w_x", "/a;b,c!d$e'(f)*+=@"]
    bases = ["https://x.com/p/q.html", "http://x.com", "https://X.com/a/", "https://x.com:443/a", "http://x.com:80/", "https://x.com:8080/a/b", "https://x.com/a/../b", "https://u:p@x.com/a", "https://x.com/a b/c", "https://x.com/d/e?f=/g/h#i/j", "ftp://x.com/a/", "https://x.com/a/b#c", "", None, "https://ü.com/a", "https://x.com/%41/b"]
    df = spark.createDataFrame([(r, b) for r in raws for b in bases], "raw string, base string")
    for keep in (False, True):
        out = df.select("raw", "base", urls.resolve_plain(F.col("raw"), F.col("base")).alias("plain"), urls.resolve(F.col("raw"), F.col("base"), keep).alias("mixed"), urls.normalize_url(F.col("raw"), F.col("base"), keep).alias("helper")).collect()
        for r in out:
            assert r.mixed == r.helper and r.plain in (None, r.helper), r
        assert sum(r.plain is not None for r in out) > 30
