"""Manifests stay in one row as long as they can; files of manifests are written and listed by tasks."""

import random

from pagequarry.operators import manifests as m
from pagequarry.operators import site_data
from pagequarry.plans import catalog
from pagequarry.sources import readers
from tests.conftest import DATA


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_variants_meet_their_sound_without_a_shuffle(spark):
    body = """#EXTM3U
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",URI="a1.m3u8"
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="b",default=yes,URI="https://s.example.com/b.m3u8"
#EXT-X-STREAM-INF:BANDWIDTH=5,AUDIO="a"
#EXT-X-STREAM-INF:BANDWIDTH=6,AUDIO="none"
#EXT-X-OTHER
../v.m3u8
w.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=7
//[bad
#EXT-X-STREAM-INF:bandwidth=8
x.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=9
"""
    only = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",URI="/s.m3u8"'
    t = spark.createDataFrame([("https://m.example.com/1/x.m3u8", body), ("https://m.example.com/2/x.m3u8", only)], "url string, body string")
    for df in (m.hls_variants(t), m.parse_hls_master(t)):
        assert "Exchange" not in _plan(df)
    told = [(r.variant_no, r.variant_url, r.bandwidth, r.audio_url, r.is_audio_only) for r in m.hls_variants(t).orderBy("url", "variant_no").collect()]
    at, b = "https://m.example.com/1", "https://s.example.com/b.m3u8"
    assert told == [(0, "https://m.example.com/v.m3u8", 5, f"{at}/a1.m3u8", False), (1, "https://m.example.com/v.m3u8", 6, b, False), (2, f"{at}/x.m3u8", 8, b, False), (0, "https://m.example.com/s.m3u8", 128_000, None, True)]
    assert [r.variant_no for r in m.parse_hls_master(t).orderBy("variant_no").collect()] == [0, 1, 2]


def test_manifests_of_a_folder_are_listed_below_it(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"k={k}").mkdir()
        (tmp_path / f"k={k}" / "a.txt").write_text(f"#EXTM3U\n#{k}")
        (tmp_path / f"k={k}" / "a.log").write_text("no")
    every = {r.url.rpartition("/k=")[2]: r.body for r in readers.read_manifests(spark, str(tmp_path), "*.txt").collect()}
    assert every == {f"{k}/a.txt": f"#EXTM3U\n#{k}" for k in range(40)}
    assert readers.read_manifests(spark, f"{tmp_path}/*/*.txt").count() == 40


def test_video_tags_know_their_site_without_a_join(spark):
    pages = spark.createDataFrame([(1, "https://www.tiktok.com/v/1", '<video src="https://t.example.com/1.mp4"><source src="https://t.example.com/no.mp4"></video>')], "page_id long, url string, html string")
    found = site_data._tags(pages, ["tiktok"])
    assert "Join" not in _plan(found) and [(r.page_id, r.source_type, r.x.url) for r in found.collect()] == [(1, "tiktok", "https://t.example.com/1.mp4")]


def test_manifest_files_are_written_by_many_tasks(spark, monkeypatch):
    spread = []
    kind = type(spark.range(1))
    deal = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: spread.append(a) or deal(self, *a))
    catalog.queries()["manifest_files"](spark, DATA)
    assert spread == [(4, "k")]


def _segments(body):
    """Ranges and places of a media playlist in plain Python: (seg_url, is_init, range_start, range_length)."""
    out, told, init, end = [], None, None, None
    for line in (x.strip(" ") for x in body.replace("\r\n", "\n").split("\n")):
        if line.startswith("#EXT-X-BYTERANGE:"):
            told = line.split(":")[1]
        elif line.startswith("#EXT-X-MAP"):
            init = "https://s.example.com/i.mp4"
        elif line and not line.startswith("#"):
            length, start = None, None
            if told:
                length, _, at = told.partition("@")
                length = int(length)
                start = int(at) if at else (end or 0)
            out += [(init, True, None, None)] if init else []
            out.append((line, False, start, length))
            end, told, init = None if length is None else start + length, None, None
    return out


def test_playlists_by_one_order_of_their_lines(spark):
    rnd = random.Random(3)
    bits = ["#EXT-X-BYTERANGE:10", "#EXT-X-BYTERANGE:7@100", "https://s.example.com/a.ts", "https://s.example.com/b.ts", '  #EXT-X-MAP:URI="https://s.example.com/i.mp4"', "#X", "", '#EXT-X-KEY:METHOD=aes-128,URI="k"', "#EXT-X-KEY:METHOD=NONE", " #EXT-X-ENDLIST "]
    bodies = {f"https://m.example.com/{i}.m3u8": "#EXTM3U\n" + rnd.choice(["\n", "\r\n"]).join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for i in range(150)}
    t = spark.createDataFrame(list(bodies.items()), "url string, body string")
    got = {}
    for r in sorted(m.parse_hls_media(t).collect(), key=lambda r: (r.url, r.seg_no)):
        got.setdefault(r.url, []).append((r.seg_url, r.is_init, r.range_start, r.range_length))
    assert got == {u: _segments(b) for u, b in bodies.items() if _segments(b)}
    info = m.hls_info(t)
    lines = {u: [x.strip(" ") for x in b.replace("\r\n", "\n").split("\n")] for u, b in bodies.items()}
    assert {r.url: (r.is_vod, r.is_encrypted, r.is_fmp4, r.segment_count) for r in info.collect()} == {u: ("#EXT-X-ENDLIST" in x, any("aes-128" in y for y in x), any("X-MAP" in y for y in x), len(_segments(bodies[u]))) for u, x in lines.items()}


def test_segments_are_planned_in_one_pass(spark):
    body = '#EXTM3U\n#EXT-X-MAP:URI="/i.mp4"\na.ts\n#EXT-X-MAP:URI="/i.mp4"\na.ts\nb.ts'
    seg = m.parse_hls_media(spark.createDataFrame([("https://m.example.com/x.m3u8", body)], "url string, body string")).selectExpr("*", "false as is_audio")
    plan = m.segment_plan(seg)
    assert _plan(plan).count("ArrowEvalPython") <= _plan(seg).count("ArrowEvalPython")
    assert [(r.fetch_no, r.seg_url.rpartition("/")[2], r.is_init) for r in plan.orderBy("fetch_no").collect()] == [(0, "i.mp4", True), (1, "a.ts", False), (2, "a.ts", False), (3, "b.ts", False)]
