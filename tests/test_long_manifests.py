"""Playlists and documents of odd size: many tag lines, many segments."""

from pyspark.sql import functions as F

from pagequarry.operators import manifests as m


def _table(spark, *bodies):
    return spark.createDataFrame([(f"https://m.example.com/{i}/x.m3u8", b) for i, b in enumerate(bodies)], "url string, body string")


def test_masters_with_many_tag_lines(spark):
    many = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=5\n" + "#EXT-X-OTHER\n\n" * 50_000 + "a.m3u8\n"
    row = "#EXTM3U\r\n" + "#EXT-X-STREAM-INF:BANDWIDTH=7\r\n" * 3_000 + " #EXT-X-OTHER\r\n  b.m3u8  \r\nc.m3u8\r\n#EXT-X-STREAM-INF:BANDWIDTH=9\r\n#EXT-X-END"
    got = m.hls_variants(_table(spark, many, row)).collect()
    assert [(r.variant_url, r.bandwidth) for r in got if "/0/" in r.url] == [("https://m.example.com/0/a.m3u8", 5)]
    assert {(r.variant_url, r.bandwidth) for r in got if "/1/" in r.url} == {("https://m.example.com/1/b.m3u8", 7)} and len(got) == 3_001


def test_all_segments_of_a_long_playlist(spark):
    body = "#EXTM3U\n#EXT-X-TARGETDURATION:4\n" + "".join(f"#EXTINF:2,\ns{k}.ts\n" for k in range(130_000)) + "#EXT-X-ENDLIST"
    t = _table(spark, body)
    info = m.hls_info(t).first()
    assert (info.segment_count, info.total_duration, info.is_vod) == (130_000, 260_000, True)
    assert m.parse_hls_media(t, most=m.MAX_HLS).count() == 120_000


def test_all_segments_of_a_long_representation(spark):
    head = '<MPD mediaPresentationDuration="PT25000S"><Period><AdaptationSet mimeType="video/mp4"><SegmentTemplate initialization="i.mp4" media="$Number$.m4s" '
    body = head + 'duration="1"/><Representation id="v" bandwidth="1"/></AdaptationSet></Period></MPD>'
    line = head + '><SegmentTimeline><S t="5" d="2" r="24998"/><S d="3"/></SegmentTimeline></SegmentTemplate><Representation id="v" bandwidth="1"/></AdaptationSet></Period></MPD>'
    reps = m.dash_representations(_table(spark, body, line))
    for rows in (m.dash_segments(reps), m.dash_timeline_segments(reps)):
        said = rows.agg(F.count("*"), F.count_distinct("seg_no"), F.max("seg_no"), F.max_by("seg_url", "seg_no")).first()
        assert tuple(said)[:3] == (25_001, 25_001, 25_000) and said[3].endswith("/25000.m4s")
    assert m.dash_segments(reps, most=m.MAX_DASH).count() == 20_001
