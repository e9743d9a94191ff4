import struct

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import filters, html, links, manifests, metadata

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\x06\0\0\0"
GIF = b"GIF89a" + struct.pack("<HH", 1200, 800) + b"\xf7\0\0"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 1080, 1920) + b"\x03"
VP8L = b"RIFF" + struct.pack("<I", 99) + b"WEBPVP8L" + struct.pack("<I", 40) + b"\x2f" + struct.pack("<I", 299 | 199 << 14) + bytes(20)
BMP = b"BM" + bytes(16) + struct.pack("<ii", 30, -20) + bytes(10)
MP4 = struct.pack(">I4s4s", 12, b"ftyp", b"isom") + struct.pack(">I4s", 8 + 108, b"moov") + struct.pack(">I4s", 108, b"mvhd") + bytes(12) + struct.pack(">II", 1000, 5500) + bytes(80)


@pytest.mark.parametrize(
    "body, want",
    [
        (PNG, (640, 480, "image/png", "raster")),
        (GIF, (1200, 800, "image/gif", "raster")),
        (JPEG, (1920, 1080, "image/jpeg", "raster")),
        (VP8L, (300, 200, "image/webp", "raster")),
        (BMP, (30, 20, "image/bmp", "raster")),
        (b'<svg width="100" height="50px">', (100, 50, "image/svg+xml", "svg")),
        (b"junk junk junk", (None, None, None, "unknown")),
        (b"", (None, None, None, "unknown")),
    ],
)
def test_sniff(spark, body, want):
    df = spark.createDataFrame([(bytearray(body), None)], "b binary, m string")
    assert tuple(df.select(metadata.sniff_image(F.col("b"), F.col("m")).alias("s")).first()["s"]) == want


@pytest.mark.parametrize(
    "body, url, mime, want",
    [
        (MP4, None, None, "mp4"),
        (b"\x1aE\xdf\xa3webm....", None, None, "webm"),
        (b"\x1aE\xdf\xa3..matroska", None, None, "mkv"),
        (b"#EXTM3U\n#EXT-X-KEY:METHOD=AES-128", None, None, "hls"),
        (b"<?xml?><MPD type='static'>", None, None, "dash"),
        (b"FLV\x01.........", None, None, "flv"),
        (b"\x47" + bytes(100), None, None, "ts"),
        (b"", "https://a/x.mpd", None, "dash"),
        (b"", None, "video/webm; x", "webm"),
        (b"nothing known", "https://a/x", None, "unknown"),
    ],
)
def test_formats(spark, body, url, mime, want):
    df = spark.createDataFrame([(bytearray(body), url, mime)], "b binary, u string, m string")
    got = df.select(metadata.detect_format(F.col("b"), F.col("u"), F.col("m")).alias("f")).first()["f"]
    assert got.container == want and got.is_encrypted == (b"AES-128" in body)


def test_boxes(spark):
    df = spark.createDataFrame([(bytearray(MP4), "mp4")], "b binary, c string")
    assert df.select(metadata.parse_media_boxes(F.col("b"), F.col("c")).alias("s")).first()["s"].duration == 5.5


def pages(spark, body, url="https://x.com/p/"):
    return spark.createDataFrame([(1, url, body)], "page_id long, url string, html string")


def test_images_and_merge(spark):
    body = """<meta property="og:image" content="/og.png"><img src="a.jpg?w=1" srcset="a.jpg?w=800 800w, a.jpg?w=400 400w" alt="x">
    <img src="/thumb_b.jpg"><img data-src="c.jpg 2x, d.jpg 1x" title="t"><picture><source srcset="e.webp 10w"></picture>
    <link rel="icon image_src" href="l.png"><a href="f.gif">f</a><a href="page.html">p</a><input type="image" src="i.png">
    <div style="background:url('bg.png')"></div><div style="background:url(data:xx)"></div><script>"/media/r/z.jpg"</script>"""
    got = {r.image_url: r for r in html.merge_page_hits(html.detect_images(pages(spark, body))).collect()}
    assert set(got) == {f"https://x.com{u}" for u in ("/og.png", "/p/a.jpg?w=800", "/b.jpg", "/p/c.jpg", "/p/e.webp", "/p/l.png", "/p/f.gif", "/p/i.png", "/p/bg.png", "/media/r/z.jpg")}
    assert [v.url for v in got["https://x.com/b.jpg"].variants] == ["https://x.com/b.jpg", "https://x.com/thumb_b.jpg"]
    assert got["https://x.com/p/a.jpg?w=800"].alt == "x" and len(got["https://x.com/p/a.jpg?w=800"].variants) == 3


def test_links(spark):
    body = "".join(f'<a href="{h}">x</a>' for h in ("/a", "b.html", "#", "mailto:x", "javascript:1", "/logout", "/login", "/f.pdf", "/a#z", "https://o.com/c", "ftp://q"))
    want = {"https://x.com/a", "https://x.com/p/b.html", "https://o.com/c"}
    assert {r.link for r in links.extract_links(html.html_elements(pages(spark, body))).collect()} == want
    assert {r.link for r in links.page_links(pages(spark, body)).collect()} == want


def test_robots(spark):
    txt = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf\nDisallow: /end$\nCrawl-delay: 2 # s\nUser-agent: other\nDisallow: /"
    rules = links.parse_robots(spark.createDataFrame([("https://x.com", txt)], "origin string, body string"))
    asked = {"https://x.com/a/c": False, "https://x.com/a/b/c": True, "https://x.com/q/x.pdf": False, "https://x.com/end": False, "https://x.com/endless": True, "https://y.com/a": True, "https://x.com": True}
    got = links.robots_allowed(spark.createDataFrame([(u,) for u in asked], "url string"), rules)
    assert {r.url: r.allowed for r in got.collect()} == asked
    assert links.crawl_delay_floor(rules, 100, 1500).first()["delay_ms"] == 1500


def test_videos(spark):
    body = '<video src="m.mp4" poster="p.jpg"><source src="a.m3u8"><source src="b" type="application/dash+xml"></video><iframe src="/in"></iframe>'
    inner = spark.createDataFrame([(2, "https://x.com/in", '<video src="z.webm"></video>')], "page_id long, url string, html string")
    both = pages(spark, body).union(inner)
    e = html.html_elements(both)
    got = {(r.page_id, r.video_url.rsplit("/", 1)[1]): (r.source_type, r.container) for r in html.detect_videos(e).collect()}
    assert got == {(1, "m.mp4"): ("video", "mp4"), (1, "a.m3u8"): ("hls-js", "hls"), (1, "b"): ("hls-js", "hls"), (2, "z.webm"): ("video", "webm")}
    framed = html.detect_iframe_videos(e, both).collect()
    assert [(r.page_id, r.iframe_src) for r in framed] == [(1, "https://x.com/in")]


def test_player_response(spark):
    body = 'x ytInitialPlayerResponse = {"a":"}{","streamingData":{"hlsManifestUrl":"https://h","formats":[{"url":"https://f","mimeType":"video/webm","height":720},{"signatureCipher":"s"}]}}; y'
    got = {(r.video_url, r.container, r.height) for r in html.player_response_videos(pages(spark, body)).collect()}
    assert got == {("https://h", "hls", None), ("https://f", "webm", 720)}


def manifest(spark, body, url="https://m.com/d/x.m3u8"):
    return spark.createDataFrame([(url, body)], "url string, body string")


def test_hls_media(spark):
    body = '#EXTM3U\n#EXT-X-TARGETDURATION:7\n#EXT-X-MEDIA-SEQUENCE:5\n#EXT-X-MAP:URI="init.mp4"\n#EXT-X-KEY:METHOD=AES-128,URI="k1"\n#EXTINF:4.5,\n#EXT-X-BYTERANGE:1000@0\na.ts\n#EXT-X-BYTERANGE:500\na.ts\n#EXT-X-KEY:METHOD=NONE\n#EXT-X-BYTERANGE:700@5000\na.ts\nb.ts\n#EXT-X-BYTERANGE:9\nc.ts\n#EXT-X-ENDLIST'
    rows = manifests.parse_hls_media(manifest(spark, body)).orderBy("seg_no").collect()
    assert [(r.seq, r.is_init, r.range_start, r.range_length) for r in rows] == [(-1, True, None, None), (5, False, 0, 1000), (6, False, 1000, 500), (7, False, 5000, 700), (8, False, None, None), (9, False, 0, 9)]
    assert [r.duration for r in rows] == [0, 4.5, 7, 7, 7, 7]
    assert [r.key_uri for r in rows] == [None, "https://m.com/d/k1", "https://m.com/d/k1", None, None, None]
    info = manifests.hls_info(manifest(spark, body)).first()
    assert (info.total_duration, info.segment_count, info.is_vod, info.is_encrypted, info.is_drm) == (33, 6, True, True, False)


def test_hls_long(spark):
    body = "#EXTM3U\n" + "\n".join(f"#EXTINF:2,\ns{i}.ts" for i in range(25_000)) + "\n#EXT-X-ENDLIST"
    info = manifests.hls_info(manifest(spark, body)).first()
    assert (info.segment_count, info.is_vod, info.total_duration) == (25_000, True, 50_000)


def test_hls_master(spark):
    body = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",URI="a1.m3u8"\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="b",DEFAULT=YES,URI="b1.m3u8"\n#EXT-X-STREAM-INF:BANDWIDTH=100,AUDIO="a"\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=900,RESOLUTION=1280x720\n\n# c\nhi.m3u8'
    rows = manifests.hls_variants(manifest(spark, body)).orderBy("variant_no").collect()
    assert [(r.bandwidth, r.audio_url.rsplit("/", 1)[1], r.label) for r in rows] == [(100, "a1.m3u8", "0kbps"), (900, "b1.m3u8", "1280x720")]
    assert manifests.best_variant(manifests.hls_variants(manifest(spark, body))).first().variant_url == "https://m.com/d/hi.m3u8"


def test_dash_timeline(spark):
    body = '<MPD mediaPresentationDuration="PT10S"><BaseURL>https://b.com/v/</BaseURL><Period><AdaptationSet mimeType="video/mp4"><SegmentTemplate initialization="i.mp4" media="$Time$.m4s" timescale="90000"><SegmentTimeline><S t="0" d="180000"/><S d="90000" r="1"/><S d="5" r="-1"/></SegmentTimeline></SegmentTemplate><Representation id="r" bandwidth="5"/></AdaptationSet></Period></MPD>'
    rows = manifests.dash_timeline_segments(manifests.dash_representations(manifest(spark, body))).orderBy("seg_no").collect()
    assert [r.seg_url.rsplit("/", 1)[1] for r in rows] == ["i.mp4", "0.m4s", "180000.m4s", "270000.m4s", "360000.m4s"]


def test_dash_numbers(spark):
    body = '<MPD mediaPresentationDuration="PT6S"><Period><AdaptationSet contentType="audio"><Representation id="r" bandwidth="5"><SegmentTemplate initialization="i_$RepresentationID$.mp4" media="chunk_$Number%04d$" duration="3" startNumber="7"/></Representation></AdaptationSet></Period></MPD>'
    reps = manifests.dash_representations(manifest(spark, body))
    rows = manifests.dash_segments(reps).orderBy("seg_no").collect()
    assert [r.seg_url.rsplit("/", 1)[1] for r in rows] == ["i_r.mp4", "chunk_0007", "chunk_0008"]
    assert manifests.parse_dash(manifest(spark, body)).first().is_audio_only


def test_unknown_never_passes(spark):
    rows = [(1, 1600, 1200, 500_000, "jpg"), (2, 100, 80, 10_000, "jpg"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "seq int, width int, height int, file_size long, extension string").withColumn("aspect_ratio", F.lit(None).cast("double")).withColumn("mime_type", F.lit(None).cast("string"))
    keep = lambda **f: [r.seq for r in df.where(filters.image_filter(filters.ImageFilter(**f))).orderBy("seq").collect()]
    assert keep() == [1, 2, 3]
    assert keep(min_width=200) == [1]
    assert keep(min_width=200, exclude_formats=("png",), mode="OR") == [1, 2, 3]
    assert keep(include_formats=("jpg",), min_size_kb=50) == [1]


def test_names_sorted_in_russian(spark):
    df = spark.createDataFrame([(1, "Яблоко"), (2, "ёлка"), (3, "арбуз")], "seq int, title string").withColumn("image_url", F.lit("https://x/y"))
    assert [r.seq for r in filters.sort_candidates(df, "name", "asc").collect()] == [3, 2, 1]
