"""Registered queries over what sites keep in their pages' scripts; the pages are made from orders, one site to a remainder by 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import manifests, site_data
from pagequarry.plans import fixtures
from pagequarry.plans.catalog import _register
from pagequarry.plans.fixtures import view

_SLASH = "chr(92) || '/'"
fixtures.VIEWS["script_pages"] = """SELECT o_orderkey AS page_id, CASE o_orderkey % 7 WHEN 0 THEN 'https://vk.com/video' WHEN 1 THEN 'https://m.vkvideo.ru/video' WHEN 2 THEN 'https://www.instagram.com/p/' WHEN 3 THEN 'https://old.reddit.com/r/' WHEN 4 THEN 'https://x.com/s/' WHEN 5 THEN 'https://www.tiktok.com/v/' ELSE 'https://9gag.com/g/' END || CAST(o_orderkey AS STRING) AS url,
  replace(CASE o_orderkey % 7
  WHEN 0 THEN '<title>T | VK</title><meta property="og:title" content="Live KEY"><meta property="og:image" content="https://t.example.com/KEY.jpg"><script>var p = {{"hls_live_playback": "https:' || ~ || ~ || 'vkvideo.ru/KEY/index.m3u8?e=1", "live": "//vkvideo.ru/KEY/master.m3u8", "url720": "https://c.example.com/KEY.mp4", "dash": "https://c.example.com/KEY.mpd", "duration": 3KEY}};</script>'
  WHEN 1 THEN '<title>VK</title><script id="__NEXT_DATA__" type="application/json">{{"props": {{"pageProps": {{"video": {{"title": "Show KEY", "duration": 5400, "is_live": 1, "thumb": "https://t.example.com/KEY.png", "files": {{"hls": "https://vkvideo.ru/KEY.m3u8", "mp4_1080": "https://vkuservideo.net/KEY-1080.mp4"}}, "related": [{{"u": "https://r.example.com/KEY"}}, "no", ["https://r.example.com/KEY/2"]]}}}}}}}}</script>'
  WHEN 2 THEN '<script>x = {{"video_url":"https:' || ~ || ~ || 'i.example.com/KEY.mp4","video_versions":[{{"type":101,"url":"https:' || ~ || ~ || 'i.example.com/KEY-v.mp4?q=2"}}],"dash_manifest":"<MPD mediaPresentationDuration=' || chr(92) || '"PT9S' || chr(92) || '"><Period><AdaptationSet mimeType=' || chr(92) || '"video/mp4' || chr(92) || '">' || chr(92) || 'u003CRepresentation id=' || chr(92) || '"v' || chr(92) || '" bandwidth=' || chr(92) || '"KEY' || chr(92) || '"><BaseURL>d-KEY.mp4</BaseURL></Representation></AdaptationSet></Period></MPD>"}}</script>'
  WHEN 3 THEN '<script type="application/ld+json">{{"@type": "VideoObject", "contentUrl": "https://r.example.com/KEY.mpd"}}</script><script type="application/ld+json">{{"@type": "Thing", "contentUrl": "https://no.example.com/"}}</script><video src="https://r.example.com/KEY.mp4"></video>'
  WHEN 4 THEN '<script>{{"video_info": {{"k": 1, "variants": [{{"url": "https:' || ~ || ~ || 'video.example.com/KEY.m3u8"}}, {{"url": "https://video.example.com/KEY.mp4?t=1"}}]}}}}</script><video><source src="https://video.example.com/KEY-s.mp4"></video>'
  WHEN 5 THEN '<video src="https://tk.example.com/KEY.mp4"><source src="https://tk.example.com/no.mp4"></video>'
  ELSE '<video src="https://g.example.com/KEY.webm"></video><video src="blob:no"></video>' END, 'KEY', CAST(o_orderkey AS STRING)) AS html
FROM {orders}""".replace("~", _SLASH)
fixtures.SPREAD.add("script_pages")

_K = "CAST(page_id AS VARCHAR)"


def _rows(of: int, rows: list[tuple]) -> str:
    return " UNION ALL ".join(f"SELECT page_id, {', '.join(r)} FROM script_pages WHERE page_id % 7 = {of}" for r in rows)


_VK_LIVE = (f"'Live ' || {_K}", f"'https://t.example.com/' || {_K} || '.jpg'", f"CAST('3' || {_K} AS DOUBLE)")
_VK_NEXT = (f"'Show ' || {_K}", f"'https://t.example.com/' || {_K} || '.png'", "CAST(5400 AS DOUBLE)")


@_register(
    "vk_videos",
    "SELECT page_id, u AS video_url, c AS container, c IN ('hls', 'dash') AS is_manifest, h AS height, t AS title, p AS thumbnail_url, d AS duration_sec, l AS is_live FROM ("
    + _rows(0, [(f"'{u}' AS u".replace("KEY", f"' || {_K} || '"), f"'{c}' AS c", f"{h} AS h", f"{_VK_LIVE[0]} AS t", f"{_VK_LIVE[1]} AS p", f"{_VK_LIVE[2]} AS d", f"{live} AS l") for u, c, h, live in [("https://vkvideo.ru/KEY/index.m3u8?e=1", "hls", "NULL", "true"), ("https://vkvideo.ru/KEY/master.m3u8", "hls", "NULL", "true"), ("https://c.example.com/KEY.mp4", "mp4", "720", "false"), ("https://c.example.com/KEY.mpd", "dash", "NULL", "false")]])
    + " UNION ALL "
    + _rows(1, [(f"'{u}'".replace("KEY", f"' || {_K} || '"), f"'{c}'", h, *_VK_NEXT, "true") for u, c, h in [("https://vkvideo.ru/KEY.m3u8", "hls", "NULL"), ("https://vkuservideo.net/KEY-1080.mp4", "mp4", "1080")]])
    + ")",
    "script_pages",
)
def _(spark, d):
    return site_data.vk_videos(view(spark, d, "script_pages"))


def _script_rows(of: int, site: str, found: list[tuple[str, str]]) -> str:
    """Rows of one site, by addresses with KEY in them and containers."""
    return _rows(of, [(f"'{u}' AS video_url".replace("KEY", f"' || {_K} || '"), f"'{site}' AS source_type", f"'{c}' AS container", f"{str(c != 'mp4').lower()} AS is_manifest") for u, c in found])


_SCRIPT_SITES = {
    "instagram": (2, [("https://i.example.com/KEY.mp4", "mp4"), ("https://i.example.com/KEY-v.mp4?q=2", "mp4")]),
    "reddit": (3, [("https://r.example.com/KEY.mpd", "dash"), ("https://r.example.com/KEY.mp4", "mp4")]),
    "twitter": (4, [("https://video.example.com/KEY.m3u8", "hls"), ("https://video.example.com/KEY.mp4?t=1", "mp4"), ("https://video.example.com/KEY-s.mp4", "mp4")]),
    "tiktok": (5, [("https://tk.example.com/KEY.mp4", "mp4")]),
    "9gag": (6, [("https://g.example.com/KEY.webm", "mp4")]),
}


def _register_site(site: str, of: int, found: list[tuple[str, str]]) -> None:
    @_register(f"{site}_videos", _script_rows(of, site, found), "script_pages")
    def _(spark, d):
        return site_data.script_videos(view(spark, d, "script_pages")).where(F.col("source_type") == site)


for _site, (_of, _found) in _SCRIPT_SITES.items():
    _register_site(_site, _of, _found)


@_register("script_manifests", f"SELECT page_id, page_id AS bandwidth, 'https://www.instagram.com/p/d-' || {_K} || '.mp4' AS variant_url, CAST(9 AS DOUBLE) AS duration FROM script_pages WHERE page_id % 7 = 2", "script_pages")
def _(spark, d):
    told = site_data.script_manifests(view(spark, d, "script_pages"))
    variants, info = manifests.parse_dash(told), manifests.dash_info(told)
    return told.select("page_id", "url").join(variants, "url").join(info.select("url", "duration"), "url").select("page_id", "bandwidth", "variant_url", "duration")


@_register("json_urls", " UNION ALL ".join(f"SELECT page_id, '$.props.pageProps.video.{path}' AS path, 'https://{url}' AS url FROM script_pages WHERE page_id % 7 = 1".replace("KEY", f"' || {_K} || '") for path, url in [("thumb", "t.example.com/KEY.png"), ("files.hls", "vkvideo.ru/KEY.m3u8"), ("files.mp4_1080", "vkuservideo.net/KEY-1080.mp4"), ("related[0].u", "r.example.com/KEY"), ("related[2][0]", "r.example.com/KEY/2")]), "script_pages")
def _(spark, d):
    return site_data.json_urls(site_data.page_json(view(spark, d, "script_pages"), "__NEXT_DATA__"))
