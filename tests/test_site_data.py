"""Site data from scripts: pages as sites write them, and odd ones."""

from pagequarry.operators import site_data

LIVE = """<!DOCTYPE html><html><head><title>Прямой эфир турнира | ВКонтакте</title><meta property="og:title" content="Турнир по киберспорту Финал">
<meta property="og:image" content="https://sun9-1.userapi.com/thumb.jpg"></head><body><script>var playerParams = {
"hls_live_playback": "https://vkvideo.ru/video_hls/live_12345/index.m3u8?extra=token123", "live": "https://vkvideo.ru/video_hls/live_12345/master.m3u8",
"title": "Турнир по киберспорту Финал", "duration": 32400};</script></body></html>"""
NEXT = """<html><head><title>Шоу выпуск 1</title></head><body><script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"video": {
"title": "Эксклюзивное шоу", "duration": 5400, "thumb": "https://vkvideo.ru/thumb/999.jpg", "files": {"hls": "https://vkvideo.ru/master.m3u8",
"mp4_720": "https://vkuservideo.net/720.mp4", "mp4_1080": "https://vkuservideo.net/1080.mp4"}}}}}</script></body></html>"""


def _pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_vk_pages(spark):
    odd = '<title>Стена | ВКонтакте</title><script>x={"title":"A \\"b\\" \\u0434","thumb":"//t/x.jpg"}</script><video src="https://c/v.mp4"></video><video src="blob:x"><source src="https://c/s.mp4"></video>'
    rows = site_data.vk_videos(_pages(spark, ("https://vk.com/video-12345_67890", LIVE), ("https://vkvideo.ru/video-1_2", NEXT), ("https://m.vk.com/w", odd), ("https://notvk.com/", LIVE), ("https://vk.com/e", ""), ("https://vk.com/n", None), ("https://vk.com/b", '<script id="__NEXT_DATA__">{broken</script>'))).collect()
    live = {r.video_url: r for r in rows if r.page_id == 0}
    first = live["https://vkvideo.ru/video_hls/live_12345/index.m3u8?extra=token123"]
    assert (first.container, first.is_manifest, first.title, first.thumbnail_url, first.duration_sec, first.is_live) == ("hls", True, "Турнир по киберспорту Финал", "https://sun9-1.userapi.com/thumb.jpg", 32400.0, True)
    show = {r.video_url: r for r in rows if r.page_id == 1}
    assert len(show) == 3 and show["https://vkvideo.ru/master.m3u8"].title == "Эксклюзивное шоу" and show["https://vkuservideo.net/1080.mp4"].height == 1080
    assert {(r.video_url, r.container, r.title, r.thumbnail_url) for r in rows if r.page_id == 2} == {(u, "mp4", 'A "b" д', "https://t/x.jpg") for u in ("https://c/v.mp4", "https://c/s.mp4")}
    assert {r.page_id for r in rows} == {0, 1, 2}


def test_manifests_in_scripts(spark):
    xml = '<MPD><Period/></MPD>'
    pages = _pages(spark, ("https://www.instagram.com/p/1", f'<script>{{"dash_manifest":"{xml}"}}</script><script>{{"video_dash_manifest": "%3CMPD%3E%3CPeriod/%3E%3C/MPD%3E"}}</script>'), ("https://www.instagram.com/p/2", '<script>{"dash_manifest":"' + "\\\\" * 50_000 + '"}</script>'))
    assert sorted((r.page_id, r.url, r.body) for r in site_data.script_manifests(pages).collect()) == [(0, "https://www.instagram.com/p/1", b) for b in sorted((xml, "<MPD><Period/></MPD>"))]


def test_deep_json(spark):
    deep = '{"a":' * 9 + '"https://x/1"' + "}" * 9
    rows = site_data.json_urls(site_data.page_json(_pages(spark, ("u", f"<script>var D = {deep};</script>"), ("v", "nothing"), ("w", "D = {}")), "D =")).collect()
    assert [(r.page_id, r.url, r.path.count(".a")) for r in rows] == [(0, "https://x/1", 9)]
