"""What video sites keep in their pages' scripts: titles, pictures, lengths, files and manifests.

JSON is read as VARIANT, scripts by expressions over each script, tags from the table of elements. Of a page's findings with one URL
the first counts, in the order in which they are looked for: page data, scripts from top to bottom, video tags.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text, urls
from pagequarry.functions.tables import keep
from pagequarry.operators.html import balanced_json, html_elements

# Hosts, keys and sizes of the sites' own scripts.
VK = r"(?:^|\.)(?:vk\.com|vk\.ru|vkvideo\.ru)$"
VK_HLS = ["hls_live_playback", "live_playback", "hls_live", "hls_ondemand", "hls_vod", "hls", "manifestUrl", "live"]
VK_DASH = ["dash_live_playback", "dash_live", "dash_ondemand", "dash_uni", "dash"]
VK_SIZES = [240, 360, 480, 720, 1080, 1440, 2160]
VK_CDN = r"(?i)https?://[^\s\"'<>\\)]+?(?:vkvideo\.ru|vkuservideo\.net|mycdn\.me|vk\.me|userapi\.com)[^\s\"'<>\\)]*?\.(?:m3u8|mpd|mp4)(?:\?[^\s\"'<>\\)]*)?"
INSTAGRAM, REDDIT, TWITTER = r"(?:^|\.)instagram\.com$", r"(?:^|\.)(?:reddit\.com|redd\.it)$", r"(?:^|\.)(?:twitter|x)\.com$"
TAG_SITES = {"vk": VK, "instagram": INSTAGRAM, "reddit": REDDIT, "twitter": TWITTER, "facebook": r"(?:^|\.)facebook\.com$", "tiktok": r"(?:^|\.)tiktok\.com$", "9gag": r"(?:^|\.)9gag\.com$"}
#: Sites whose video tags count by their own address only, not by their sources'.
OWN_SRC_ONLY = ["reddit", "facebook", "tiktok", "9gag"]

_FOUND = "array<struct<url:string,container:string,height:int,is_live:boolean>>"
_SCRIPT = r"(?is)<script([^>]*+)>(.*?)</script>"


def _found(url: Column, container: Column | str | None = None, height: Column | int | None = None, live: Column | bool = False) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(url.alias("url"), as_column(container).cast("string").alias("container"), as_column(height).cast("int").alias("height"), F.coalesce(as_column(live), F.lit(False)).alias("is_live"))


def _all(c: Column, rx: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(rx), F.lit(group))


def _one(c: Column, rx: str) -> Column:
    return F.nullif(F.regexp_extract(c, rx, 1), F.lit(""))


def clean_url(u: Column) -> Column:
    """A URL out of a script: escapes undone, https where the scheme is left out."""
    s = F.replace(F.replace(F.replace(u, F.lit("\\/"), F.lit("/")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(s.startswith("//"), F.concat(F.lit("https:"), s)).otherwise(s)


def scripts_of(pages: DataFrame) -> DataFrame:
    """page_id, script_no, attrs, script of each script with content."""
    both = F.arrays_zip(_all(F.col("html"), _SCRIPT, 1).alias("attrs"), _all(F.col("html"), _SCRIPT, 2).alias("script"))
    return pages.select("page_id", F.posexplode(both).alias("script_no", "s")).select("page_id", "script_no", "s.*").where("trim(script) <> ''")


def _of_site(pages: DataFrame, host: str) -> DataFrame:
    return pages.where(urls.hostname_of(F.col("url")).rlike(host))


def _first_of_each(found: DataFrame, *more: str) -> DataFrame:
    """found (page_id, at, x) as page_id, video_url and the rest of x: of one URL of a page, the first by at."""
    http = found.where(urls.is_http_url(F.col("x.url")))
    best = http.groupBy("page_id", F.col("x.url").alias("video_url")).agg(F.min_by("x", "at").alias("x"), *[F.min_by(c, "at").alias(c) for c in more])
    return best.select("page_id", "video_url", F.col("x.container").alias("container"), F.col("x.height").alias("height"), F.col("x.is_live").alias("is_live"), *more)


# --- VK


def _meta(html: Column, attribute: str, name: str) -> Column:
    """Content of a meta tag, whichever attribute stands first."""
    forth, back = rf'(?is)<meta\s[^>]*?{attribute}=["\']{name}["\'][^>]*?content=["\']([^"\']*)["\']', rf'(?is)<meta\s[^>]*?content=["\']([^"\']*)["\'][^>]*?{attribute}=["\']{name}["\']'
    return F.coalesce(_one(html, forth), _one(html, back))


def vk_page_data(pages: DataFrame) -> DataFrame:
    """page_id, title, thumbnail_url, duration_sec, next (page data as VARIANT, null without a video) of VK pages: first from the
    page data, then from meta tags and the title, then from the scripts."""
    html = F.col("html")
    data = F.try_parse_json(_one(html, r'(?is)<script[^>]*?id=["\']__NEXT_DATA__["\'][^>]*+>(.*?)</script>'))
    p = _of_site(pages, VK).withColumn("data", data)
    at = lambda path, kind: F.try_variant_get("data", path, kind)
    root = F.when(at("$.props.pageProps", "variant").isNotNull(), "$.props.pageProps").otherwise("$.props.initialState")
    videos = [(r, k, at(f"{r}.{k}", "variant")) for r in ("$.props.pageProps", "$.props.initialState") for k in ("video", "videoItem", "initialVideo")]
    p = p.withColumn("next", F.coalesce(*[F.when(root == r, v) for r, _, v in videos]))
    said = lambda name: F.try_variant_get("next", f"$.{name}", "string")
    bare = F.nullif(F.trim(F.regexp_replace(_one(html, r"(?is)<title[^>]*+>(.*?)</title>"), r"(?is)\s*\|\s*(ВКонтакте|VK|VK Видео).*$", "")), F.lit(""))
    title = F.coalesce(F.nullif(said("title"), F.lit("")), _meta(html, "property", "og:title"), _meta(html, "name", "twitter:title"), bare)
    # Each script is asked in turn; the first that has it decides.
    scripts = F.array_join(_all(html, _SCRIPT, 2), "\n")
    in_script = F.coalesce(*[F.nullif(F.from_json(F.concat(F.lit('["'), _one(scripts, rf'"{k}"\s*:\s*"((?:[^"\\]++|\\.)*+)"'), F.lit('"]')), "array<string>")[0], F.lit("")) for k in ("md_title", "title")])
    title = F.when(title.isNull() | text.is_obscure_title(title), F.coalesce(in_script, title)).otherwise(title)
    thumb = F.coalesce(F.nullif(said("thumb"), F.lit("")), _meta(html, "property", "og:image"), _meta(html, "name", "twitter:image"), clean_url(F.coalesce(_one(scripts, r'"thumb"\s*:\s*"([^"]+)"'), _one(scripts, r'"jpg"\s*:\s*"([^"]+)"'))))
    length = F.coalesce(F.nullif(said("duration").try_cast("double"), F.lit(0.0)), _one(scripts, r'"duration"\s*:\s*([0-9]+)').try_cast("double"))
    return p.select("page_id", title.alias("title"), thumb.alias("thumbnail_url"), length.alias("duration_sec"), "next")


def _vk_next(data: DataFrame) -> DataFrame:
    """Files of the page data, with a height in their name."""
    said = lambda name: F.try_variant_get("next", f"$.{name}", "string")
    live = said("is_live").isin("1", "true") | (said("live") == "1") | (said("status") == "live")
    files = F.map_entries(F.coalesce(F.try_variant_get("next", "$.files", "map<string,string>"), F.create_map().cast("map<string,string>")))
    kind = lambda k: F.when(k.isin("hls", "dash"), k).otherwise("mp4")
    rows = F.transform(files, lambda e: _found(clean_url(e["value"]), kind(e["key"]), F.when(kind(e["key"]) == "mp4", F.regexp_extract(e["key"], r"([0-9]{3,4})", 1).try_cast("int")), live))
    more = F.array(_found(clean_url(said("hls")), "hls", None, live), _found(clean_url(said("dash")), "dash", None, live), _found(clean_url(said("video_url")), None, None, live))
    return data.where("next is not null").select("page_id", F.posexplode(F.concat(rows, more)).alias("n", "x")).select("page_id", F.struct(F.lit(-1).alias("script_no"), "n").alias("at"), "x")


def _vk_scripts(pages: DataFrame) -> DataFrame:
    s = F.col("script")
    live = s.rlike(r'(?i)"is_live"\s*:\s*(?:1|true)|"live"\s*:\s*1|"status"\s*:\s*"live"')

    def values(key: str, *more: Column | str | int | None) -> Column:
        return F.transform(_all(s, rf'"{key}"\s*:\s*"([^"]+)"'), lambda u: _found(clean_url(u), *more))

    parts = [values(k, "hls", None, F.lit("live" in k) | live) for k in VK_HLS] + [values(k, "dash") for k in VK_DASH]
    parts += [values(f"url{n}", "mp4", n) for n in VK_SIZES]
    parts += [F.transform(_all(s, VK_CDN, 0), lambda u: _found(clean_url(u)))]
    return scripts_of(pages).select("page_id", "script_no", F.posexplode(F.concat(*parts)).alias("n", "x")).select("page_id", F.struct("script_no", "n").alias("at"), "x")


def _container(url: Column, said: Column) -> Column:
    hls = url.rlike(r"(?i)\.m3u8(\?|$)|/hls/") | (said == "hls")
    return F.when(hls, "hls").when(url.rlike(r"(?i)\.mpd(\?|$)") | (said == "dash"), "dash").otherwise(F.coalesce(said, F.lit("mp4")))


def vk_videos(pages: DataFrame) -> DataFrame:
    """page_id, video_url, container, is_manifest, height, title, thumbnail_url, duration_sec, is_live of VK pages."""
    own = _of_site(pages, VK)
    data = vk_page_data(own)
    found = _first_of_each(_vk_next(data).unionByName(_vk_scripts(own)).unionByName(_tags(own, ["vk"]).drop("source_type")))
    kind = _container(F.col("video_url"), F.coalesce("container", F.lit("mp4")))
    out = found.join(data.drop("next"), "page_id").withColumn("container", kind)
    return out.select("page_id", "video_url", "container", F.col("container").isin("hls", "dash").alias("is_manifest"), "height", "title", "thumbnail_url", "duration_sec", "is_live")


# --- other sites


def _by_extension(url: Column) -> Column:
    return F.when(url.rlike(r"(?i)\.m3u8"), "hls").when(url.rlike(r"(?i)\.mpd"), "dash").otherwise("mp4")


def _tags(pages: DataFrame, sites: list[str]) -> DataFrame:
    """page_id, source_type, at, x: addresses of video tags on pages of some sites; of their sources too, where the site has them."""
    host = urls.hostname_of(F.col("url"))
    site = F.coalesce(*[F.when(host.rlike(TAG_SITES[s]), F.lit(s)) for s in sites])
    own = pages.where(site.isNotNull())
    e = html_elements(own, tags={"video", "source"}).where("tag = 'video' or (tag = 'source' and parent = 'video')")
    e = e.withColumn("source_type", site).where(~((F.col("tag") == "source") & F.col("source_type").isin(*OWN_SRC_ONLY)))
    src = F.nullif(F.trim(F.col("attrs")["src"]), F.lit(""))
    return e.select("page_id", "source_type", F.struct(F.lit(1 << 30).alias("script_no"), F.col("el_no").cast("int").alias("n")).alias("at"), _found(src).alias("x")).where("x.url is not null")


def _reddit(pages: DataFrame) -> DataFrame:
    s = scripts_of(_of_site(pages, REDDIT)).where(F.col("attrs").rlike(r'(?i)type=["\']application/ld\+json["\']'))
    v = F.try_parse_json("script")
    url = F.when(F.try_variant_get(v, "$['@type']", "string") == "VideoObject", F.try_variant_get(v, "$.contentUrl", "string"))
    return s.select("page_id", F.lit("reddit").alias("source_type"), F.struct("script_no", F.lit(0).alias("n")).alias("at"), _found(url).alias("x")).where("x.url is not null")


def _instagram(pages: DataFrame) -> DataFrame:
    s = F.replace("script", F.lit("\\/"), F.lit("/"))
    single = F.filter(_all(s, r'"(?:video_url|playable_url(?:_quality_\w+)?)"\s*:\s*"(https?://[^"]+)"'), lambda u: u.rlike(r"(?i)\.mp4|m3u8"))
    versions = F.flatten(F.transform(_all(s, r'"video_versions"\s*:\s*\[([^\]]{10,20000}?)\]'), lambda t: _all(t, r'(?i)https?://[^"\\]+?\.(?:mp4|m3u8)[^"\\]*', 0)))
    rows = F.transform(F.concat(single, versions), lambda u: _found(u))
    return scripts_of(_of_site(pages, INSTAGRAM)).select("page_id", "script_no", F.posexplode(rows).alias("n", "x")).select("page_id", F.lit("instagram").alias("source_type"), F.struct("script_no", "n").alias("at"), "x")


def _twitter(pages: DataFrame) -> DataFrame:
    listed = F.regexp_extract("script", r'"video_info"\s*:\s*\{[^}]*"variants"\s*:\s*\[([^\]]+)\]', 1)
    rows = F.transform(_all(listed, r'(?i)"(https?:(?:\\?/){2}[^"]+\.(?:mp4|m3u8|mpd)[^"]*)"'), lambda u: _found(F.replace(u, F.lit("\\/"), F.lit("/"))))
    return scripts_of(_of_site(pages, TWITTER)).select("page_id", "script_no", F.posexplode(rows).alias("n", "x")).select("page_id", F.lit("twitter").alias("source_type"), F.struct("script_no", "n").alias("at"), "x")


def script_videos(pages: DataFrame) -> DataFrame:
    """page_id, video_url, source_type, container, is_manifest from the scripts and video tags of Instagram, Reddit, Twitter, and
    the video tags of Facebook, TikTok and 9GAG."""
    found = _instagram(pages).unionByName(_reddit(pages)).unionByName(_twitter(pages)).unionByName(_tags(pages, [s for s in TAG_SITES if s != "vk"]))
    out = _first_of_each(found, "source_type").withColumn("container", _by_extension(F.col("video_url")))
    return out.select("page_id", "video_url", "source_type", "container", F.col("container").isin("hls", "dash").alias("is_manifest"))


def script_manifests(pages: DataFrame) -> DataFrame:
    """page_id, url (of the page, the base of what the manifest names), body: the DASH documents that Instagram's scripts hold as JSON
    texts, percent-encoded or not; rows for parse_dash()."""
    raw = _all(F.col("script"), r'"(?:video_)?dash_manifest"\s*:\s*"((?:[^"\\]++|\\.)*+)"')
    told = scripts_of(_of_site(pages, INSTAGRAM)).select("page_id", F.explode(raw).alias("raw"))
    plain = F.from_json(F.concat(F.lit('["'), "raw", F.lit('"]')), "array<string>")[0]
    told = told.select("page_id", plain.alias("body")).withColumn("body", F.when(F.col("body").startswith("%3C"), F.try_url_decode("body")).otherwise(F.col("body")))
    return told.where(F.col("body").rlike(r"(?i)<MPD[\s>]")).join(pages.select("page_id", "url"), "page_id").select("page_id", "url", "body")


def page_json(pages: DataFrame, marker: str) -> DataFrame:
    """page_id, data: the JSON object after a marker in a page's scripts as VARIANT; pages without one have no row."""
    return pages.select("page_id", F.try_parse_json(balanced_json(F.col("html"), marker)).alias("data")).where("data is not null")


def json_urls(data: DataFrame) -> DataFrame:
    """page_id, path, url: every http(s) text of VARIANT objects (page_id, data), wherever it stands. Each level of nesting is one
    round of variant_explode over what the round before left in a table; there are as many rounds as levels."""
    level = data.select("page_id", F.lit("$").alias("path"), "data")
    steps = "SELECT l.page_id, l.path || CASE WHEN e.key IS NULL THEN '[' || e.pos || ']' ELSE '.' || e.key END AS path, e.value AS data FROM {l} l, LATERAL variant_explode(l.data) e"
    kind, said = F.schema_of_variant("data"), F.try_variant_get("data", "$", "string")
    found: list[DataFrame] = []
    while not found or not level.isEmpty():
        inner = keep(level.sparkSession.sql(steps, l=level))
        found.append(inner.where((kind == "STRING") & urls.is_http_url(said)).select("page_id", "path", said.alias("url")))
        level = inner.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    return reduce(DataFrame.unionByName, found)
