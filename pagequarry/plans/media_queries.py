"""More registered queries: media on pages, site scripts, timelines, expanded manifests, names, budgets, files written and read.

Pages with media are made from orders, one element of each kind to a page, so that SQL can say what each detector must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import text, urls
from pagequarry.functions.tables import keep, new_path
from pagequarry.operators import dedup, downloads, html, links, manifests, metadata, pictures, reports
from pagequarry.plans import catalog, fixtures
from pagequarry.plans.catalog import _CANON, _EDGES, _JOBS, _MIME, _ONE, _PATHQ, _SIZE, _domain, _edges, _ext, _first_sql, _jobs, _pages, _register, _responses, _robots
from pagequarry.plans.fixtures import dealt_out, view, view_sql
from pagequarry.sources import sinks
from pagequarry.streaming import jobs


# --- images and videos of pages

_MEDIA = "SELECT page_id, url, regexp_extract(url, '^(https://[^/]+)', 1) AS o, CAST(page_id AS STRING) AS k FROM media_pages"


@_register("image_source_counts", "SELECT page_id, s.t AS source_type, s.n FROM media_pages, (SELECT unnest([{'t': 'img', 'n': 5}, {'t': 'srcset', 'n': 2}, {'t': 'lazy', 'n': 1}, {'t': 'picture', 'n': 2}, {'t': 'meta', 'n': 1}, {'t': 'link', 'n': 2}, {'t': 'other', 'n': 1}, {'t': 'background', 'n': 2}]) AS s)", "media_pages")
def _(spark, d):
    return html.source_type_counts(html.detect_images(view(spark, d, "media_pages")))


_PICTURES = [
    ("'/i/' || k || '.jpg'", "img", "'Alt ' || CAST(page_id % 40 AS STRING)", "NULL", 1), ("'/s/' || k || '-2.jpg'", "srcset", "NULL", "'T'", 3), ("'/z/' || k || '.webp'", "lazy", "NULL", "NULL", 1),
    ("'/p/' || k || '.avif'", "picture", "NULL", "NULL", 1), ("'/og/' || k || '.jpg'", "meta", "NULL", "NULL", 1), ("'/ls/' || k || '.png'", "link", "NULL", "NULL", 1),
    ("'/a/' || k || '.bmp'", "link", "NULL", "NULL", 1), ("'/n/' || k || '.ico'", "other", "NULL", "NULL", 1), ("'/b/' || k || '.tiff'", "background", "NULL", "NULL", 1),
    ("'/w/' || k || '.webm'", "background", "NULL", "NULL", 1), ("'/img/' || k || '.jpg'", "img", "NULL", "NULL", 2), ("'/media/r/' || k || '.jpg'", "img", "NULL", "NULL", 1),
]
_PICTURE_SQL = " UNION ALL ".join(f"SELECT page_id, o || {path} AS image_url, '{source}' AS source_type, CAST({alt} AS VARCHAR) AS alt, CAST({title} AS VARCHAR) AS title, {n} AS variants FROM m" for path, source, alt, title, n in _PICTURES)


@_register("page_images", f"WITH m AS ({_MEDIA}) {_PICTURE_SQL}", "media_pages")
def _(spark, d):
    return pictures.page_pictures(view(spark, d, "media_pages"), counted=True)


_VIDEO_SQL = """SELECT page_id, o || '/v/' || k || '.m3u8' AS video_url, 'hls-js' AS source_type, 'hls' AS container, 'application/x-mpegurl' AS mime_type, true AS is_manifest, '/o/' || k || '.jpg' AS thumbnail_url, 'V ' || k AS title FROM m
 UNION ALL SELECT page_id, o || '/v/' || k || '.mp4', 'video', 'mp4', 'video/mp4', false, '/o/' || k || '.jpg', 'V ' || k FROM m"""


@_register("page_videos", f"WITH m AS ({_MEDIA}) {_VIDEO_SQL}", "media_pages")
def _(spark, d):
    return html.detect_videos(html.html_elements(view(spark, d, "media_pages"), tags={"video", "source"}))


@_register("iframe_videos", f"WITH m AS ({_MEDIA}), v AS ({_VIDEO_SQL}) SELECT page_id, url AS iframe_src, video_url, source_type FROM v JOIN m USING (page_id)", "media_pages")
def _(spark, d):
    pages = view(spark, d, "media_pages")
    return html.detect_iframe_videos(html.html_elements(pages, tags={"iframe", "video", "source"}), pages).select("page_id", "iframe_src", "video_url", "source_type")


@_register("background_videos", f"WITH m AS ({_MEDIA}) SELECT page_id, o || '/w/' || k || '.webm' AS video_url, 'background' AS source_type, 'webm' AS container FROM m", "media_pages")
def _(spark, d):
    return html.detect_background_videos(html.html_elements(view(spark, d, "media_pages"), tags={"style"}))


@_register("site_videos", "SELECT page_id, 'https://cdn.example.com/' || page_id || '.m3u8' AS video_url, 'vk' AS source_type, 'hls' AS container FROM site_pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'https://cdn.example.com/' || page_id || '.mp4?a=1&b=2', 'vk', 'mp4' FROM site_pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'https://video.twimg.com/' || page_id || '.mp4', 'twitter', 'mp4' FROM site_pages WHERE page_id % 5 = 3", "site_pages")
def _(spark, d):
    return html.detect_site_videos(view(spark, d, "site_pages"))


@_register("player_videos", "SELECT page_id, 'https://y.example.com/' || page_id || '.m3u8' AS video_url, 'hls' AS container, CAST(NULL AS INT) AS height, page_id % 3 = 0 AS is_drm FROM site_pages WHERE page_id % 5 = 2 UNION ALL SELECT page_id, 'https://y.example.com/' || page_id || '?itag=18', 'mp4', 360, page_id % 3 = 0 FROM site_pages WHERE page_id % 5 = 2", "site_pages")
def _(spark, d):
    return html.player_response_videos(view(spark, d, "site_pages"))


_PLAYBACK = "contains(url, 'googlevideo.com/')"
_FULL = f"CASE WHEN {_PLAYBACK} THEN regexp_replace(url, '&range=[^&]*', '') ELSE url END"


@_register("sniffed_videos", f"SELECT DISTINCT tab_id % 20 AS job_id, {_FULL} AS video_url, CASE WHEN regexp_matches({_FULL}, '(?i)\\.m3u8(\\?|$)') THEN 'hls' ELSE 'mp4' END AS container, regexp_matches({_FULL}, '(?i)\\.m3u8(\\?|$)') AS is_manifest FROM requests", "requests")
def _(spark, d):
    return html.classify_sniffed(view(spark, d, "requests").select((F.col("tab_id") % 20).alias("job_id"), F.col("url").alias("media_url")))


# --- types and names


@_register("media_types", f"SELECT seq, CASE trim(regexp_extract(lower(content_type), '^([^;]*)', 1)) WHEN 'image/png' THEN 'png' WHEN 'image/jpeg' THEN 'jpg' END AS ext, content_type IS NULL OR content_type = 'text/html' AS is_html FROM responses", "responses")
def _(spark, d):
    c = F.col("content_type")
    return view(spark, d, "responses").select("seq", urls.mime_to_ext(c).alias("ext"), links.is_html_content_type(c).alias("is_html"))


@_register("video_types", f"WITH v AS (SELECT seq, {_ext('video_url')} AS ext FROM videos) SELECT seq, CASE ext WHEN 'm3u8' THEN 'application/x-mpegurl' WHEN 'mp4' THEN 'video/mp4' WHEN 'mpd' THEN 'application/dash+xml' WHEN 'webm' THEN 'video/webm' END AS mime, CASE ext WHEN 'm3u8' THEN 'hls' WHEN 'mp4' THEN 'mp4' WHEN 'mpd' THEN 'dash' WHEN 'webm' THEN 'webm' ELSE 'unknown' END AS container FROM v", "videos")
def _(spark, d):
    ext = urls.extension_from_url(F.col("video_url"))
    return view(spark, d, "videos").select("seq", urls.ext_to_mime(ext).alias("mime"), urls.container_from_ext(ext).alias("container"))


@_register("disposition_names", "SELECT seq, CASE seq % 7 WHEN 0 THEN 'a b' || (seq % 30) || '.jpg' WHEN 1 THEN 'ф.png' END AS name FROM responses", "responses")
def _(spark, d):
    return view(spark, d, "responses").select("seq", urls.content_disposition_filename(F.col("content_disposition")).alias("name"))


@_register("video_names", "SELECT seq, CASE WHEN coalesce(width, 0) > 0 AND coalesce(height, 0) > 0 THEN source_type || '_' || width || 'x' || height WHEN bitrate_kbps > 0 THEN source_type || '_' || bitrate_kbps || 'kbps' ELSE source_type END || '.' || CASE container WHEN 'hls' THEN 'ts' WHEN 'dash' THEN 'mp4' WHEN 'unknown' THEN 'mp4' ELSE container END AS name FROM videos", "videos")
def _(spark, d):
    null = F.lit(None).cast("string")
    name = downloads.video_filename("{title}_{quality}.{ext}", "2024-01-02", null, F.col("source_type"), null, F.col("width"), F.col("height"), F.col("duration_sec"), F.col("bitrate_kbps"), F.col("container"))
    return view(spark, d, "videos").select("seq", name.alias("name"))


@_register("titles", "SELECT seq, 'p' || (seq % 9) || CASE WHEN width > 0 AND height > 0 THEN ' · ' || height || 'p' ELSE '' END || CASE WHEN is_live THEN ' · live' WHEN duration_sec >= 3600 THEN ' · long' ELSE '' END AS title, seq % 4 IN (0, 1) AS obscure FROM videos", "videos")
def _(spark, d):
    page = F.concat(F.lit(" p"), (F.col("seq") % 9).cast("string"), F.lit(" "))
    told = F.element_at(F.array(F.lit("Master.m3u8"), F.lit("HTTPS://x.example.com/"), F.lit("A talk"), F.lit("Videos of us")), (F.col("seq") % 4 + 1).cast("int"))
    return view(spark, d, "videos").select("seq", metadata.derive_title(page, F.col("width"), F.col("height"), F.col("duration_sec"), F.col("is_live")).alias("title"), text.is_obscure_title(told).alias("obscure"))


_FOLDER = "CASE seq % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'f/' || source_domain ELSE 'f/page_' || lpad(CAST(page_no AS VARCHAR), 3, '0') END"


@_register("folders", f"WITH f AS (SELECT job_id, source_page_url, min(seq) AS s FROM images GROUP BY 1, 2), p AS (SELECT job_id, source_page_url, row_number() OVER (PARTITION BY job_id ORDER BY s) AS page_no FROM f) SELECT seq, {_FOLDER} AS folder FROM images JOIN p USING (job_id, source_page_url)", "images")
def _(spark, d):
    i = view(spark, d, "images")
    by = [downloads.target_folder(i, mode, "f").where(f"seq % 3 = {k}").select("seq", "folder") for k, mode in enumerate(("flat", "domain", "page"))]
    return by[0].unionByName(by[1]).unionByName(by[2])


# --- payloads


@_register("payload_classes", "SELECT seq, seq % 4 < 2 AS is_error, CASE WHEN coalesce(seq % 5 <> 0 AND seq % 3 = 2, false) THEN 'type' WHEN content_length IS NOT NULL AND seq * 3 < 16384 AND seq > 0 THEN 'small' END AS suspicious FROM responses", "responses")
def _(spark, d):
    k = F.col("seq").cast("string")
    body = F.element_at(F.array(F.concat(F.lit("  <!DOCTYPE html>"), k), F.concat(F.lit('{"a":'), k, F.lit(',"error": {}}')), F.concat(F.lit("ftypmp42"), k), F.concat(F.lit('{"ok":'), k, F.lit("}"))), (F.col("seq") % 4 + 1).cast("int"))
    return view(spark, d, "responses").select("seq", metadata.looks_like_error_payload(body.cast("binary")).alias("is_error"), metadata.classify_suspicious(F.col("content_type"), F.col("content_length").cast("long")).alias("suspicious"))


_SHA = "sha1(unhex('89504E470D0A1A0A0000000D494844520000000A0000000B0806000000'))"
_MAPPED = f"CASE coalesce({_MIME('h')}, {_MIME('g')}) WHEN 'image/png' THEN 'png' WHEN 'image/jpeg' THEN 'jpg' END"
_METADATA_SQL = f"""SELECT i.seq, CASE WHEN g.url IS NOT NULL THEN 'image/png' ELSE coalesce({_MIME('h')}, {_MIME('g')}) END AS mime_type, coalesce({_MAPPED}, CASE WHEN g.url IS NOT NULL THEN 'png' END, i.extension) AS extension,
 CASE WHEN g.url IS NOT NULL THEN 10 ELSE i.width END AS width, CASE WHEN g.url IS NOT NULL THEN 11 ELSE i.height END AS height, coalesce({_SIZE('h')}, {_SIZE('g')}, i.file_size) AS file_size,
 CASE WHEN g.url IS NOT NULL THEN 10 / CAST(11 AS DOUBLE) ELSE CAST(nullif(i.width, 0) AS DOUBLE) / nullif(i.height, 0) END AS aspect_ratio, CASE WHEN g.url IS NOT NULL THEN {_SHA} END AS fingerprint,
 CASE WHEN i.status IN ('downloaded', 'failed') THEN i.status ELSE 'ready' END AS status FROM images i LEFT JOIN {_ONE('HEAD')} h ON h.url = i.image_url LEFT JOIN {_ONE('GET')} g ON g.url = i.image_url"""


@_register("image_metadata", _METADATA_SQL, "images responses")
def _(spark, d):
    r = _responses(spark, d).withColumn("body", F.when(F.col("seq") % 2 == 1, F.unhex(F.lit("89504E470D0A1A0A0000000D494844520000000A0000000B0806000000"))))
    out = metadata.image_metadata(view(spark, d, "images"), r)
    return out.select("seq", "mime_type", "extension", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "file_size", "aspect_ratio", "fingerprint", "status")


_BOX_HEX = "'0000001066747970697364350000000000000064' || '6D6F6F76' || '0000005C' || '746B6864' || repeat('00', 76) || lpad(hex(CAST(p_size + 10 AS BIGINT)), 4, '0') || '0000' || lpad(hex(CAST(p_partkey % 1000 + 1 AS BIGINT)), 4, '0') || '0000'"


@_register("media_boxes", "SELECT p_partkey AS id, CAST(p_size + 10 AS BIGINT) AS width, p_partkey % 1000 + 1 AS height FROM part")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.unhex(F.expr(_BOX_HEX)).alias("body"))
    b = metadata.parse_media_boxes(F.col("body"), F.lit("mp4"))
    return p.select("id", b.alias("b")).select("id", F.col("b.width").cast("long").alias("width"), F.col("b.height").cast("long").alias("height"))


# --- manifests


@_register("dash_timeline", "WITH t AS (SELECT p_partkey AS k, p_size % 4 AS r FROM part), s AS (SELECT k, r, unnest(range(0, r + 2)) AS i FROM t) SELECT 'https://d.example.com/' || k || '/t.mpd' AS url, 0 AS seg_no, 'https://d.example.com/' || k || '/v/init.mp4' AS seg_url FROM t UNION ALL SELECT 'https://d.example.com/' || k || '/t.mpd', i + 1, 'https://d.example.com/' || k || '/v/t_' || lpad(CAST(i * 10 + 7 AS VARCHAR), 5, '0') || '.m4s' FROM s")
def _(spark, d):
    k, r = F.col("p_partkey").cast("string"), (F.col("p_size") % 4).cast("string")
    head = '<?xml version="1.0"?><MPD type="static"><Period><AdaptationSet mimeType="video/mp4"><SegmentTemplate initialization="$RepresentationID$/init.mp4" media="$RepresentationID$/t_$Time%05d$.m4s" timescale="10"><SegmentTimeline><S t="7" d="10" r="'
    body = F.concat(F.lit(head), r, F.lit('"/><S d="5"/></SegmentTimeline></SegmentTemplate><Representation id="v" bandwidth="5"/></AdaptationSet></Period></MPD>'))
    m = dealt_out(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")).select(F.concat(F.lit("https://d.example.com/"), k, F.lit("/t.mpd")).alias("url"), body.alias("body"))
    return manifests.dash_timeline_segments(manifests.dash_representations(m)).select("url", F.col("seg_no").cast("long").alias("seg_no"), "seg_url")


_PLAYED = "WITH i AS (SELECT l_orderkey, sum(CAST(l_quantity AS INT)) AS total, count(*) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n FROM lineitem GROUP BY 1)"


@_register("expand_manifests", f"{_PLAYED} SELECT l_orderkey AS id, 'https://m.example.com/' || l_orderkey || '.m3u8' AS best_url, 800000 AS bandwidth, CAST(total AS BIGINT) AS duration, n AS segment_count, l_orderkey % 2 = 1 AS is_live, CAST(total * 100000 AS BIGINT) AS estimated_size FROM i")
def _(spark, d):
    media = keep(fixtures.hls_media(spark, d))
    key = F.regexp_extract("url", r"/([0-9]+)\.m3u8$", 1)
    master = F.concat(F.lit("https://m.example.com/x/"), key, F.lit("/master.m3u8"))
    body = F.concat(F.lit("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1000\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=800000\n/"), key, F.lit(".m3u8\n"))
    masters = media.select(master.alias("url"), body.alias("body"))
    cands = media.select(key.cast("long").alias("id"), master.alias("video_url"))
    return manifests.expand_manifests(cands, masters.unionByName(media)).drop("video_url")


@_register("hls_init", "SELECT DISTINCT 'https://m.example.com/' || l_orderkey || '.m3u8' AS url, 'https://s.example.com/init.mp4' AS seg_url, CAST(0 AS DOUBLE) AS duration, -1 AS seq FROM lineitem WHERE l_orderkey % 5 = 0")
def _(spark, d):
    return manifests.parse_hls_media(fixtures.hls_media(spark, d)).where("is_init").select("url", "seg_url", "duration", "seq")


@_register("manifest_outcomes", "SELECT seq, CASE WHEN seq % 13 = 0 THEN 'parse_error' WHEN is_drm THEN 'drm' WHEN seq % 3 = 0 AND seq % 2 = 0 THEN 'no_key' WHEN seq % 7 = 0 AND seq % 4 = 0 THEN 'no_variants' WHEN seq % 4 = 0 THEN 'no_segments' ELSE 'ok' END AS outcome FROM videos", "videos")
def _(spark, d):
    k = F.col("seq")
    o = manifests.manifest_outcome(k % 13 != 0, F.col("is_drm"), k % 3 == 0, F.when(k % 2 == 1, "key"), k % 7, k % 4)
    return view(spark, d, "videos").select("seq", o.alias("outcome"))


@_register("variant_choices", "SELECT seq AS id, CASE WHEN seq % 3 = 0 THEN 'https://c.example.com/' || seq ELSE video_url END AS video_url, CASE WHEN seq % 3 = 0 THEN 7 ELSE bitrate_kbps END AS bitrate_kbps, width, CASE WHEN seq % 3 = 0 THEN 720 ELSE height END AS height FROM videos", "videos")
def _(spark, d):
    v = view(spark, d, "videos").select(F.col("seq").alias("id"), "video_url", "bitrate_kbps", "width", "height")
    chosen = v.where("id % 3 = 0").select("id", F.concat(F.lit("https://c.example.com/"), F.col("id").cast("string")).alias("video_url"), F.lit(7).cast("long").alias("bitrate_kbps"), F.lit(None).cast("int").alias("width"), F.lit(720).alias("height"))
    return manifests.apply_variant_choice(v, chosen)


# --- crawls, budgets, back-off

_ALLOWED = """coalesce(list_sort([x for x in [CASE WHEN starts_with(p, '/de') THEN struct_pack(n := 3, a := false) END, CASE WHEN starts_with(p, '/de/1') THEN struct_pack(n := 5, a := true) END,
 CASE WHEN regexp_matches(p, '^/fr/.*5.*') THEN struct_pack(n := length(p), a := false) END, CASE WHEN p = '/en/25' THEN struct_pack(n := 6, a := false) END] if x is not null], 'DESC')[1].a, true)"""


@_register(
    "frontier_scoped",
    f"""WITH RECURSIVE {_EDGES}, {_JOBS}, ok AS (SELECT {_CANON('url')} AS t, {_domain('url')} AS site FROM (SELECT url, {_PATHQ} AS p FROM pages) WHERE {_ALLOWED}),
e AS (SELECT DISTINCT {_CANON('src_url')} AS s, {_CANON('dst_url')} AS t FROM edges),
walk AS (SELECT job_id, {_CANON('root_url')} AS url, 0 AS depth, {_domain('root_url')} AS site FROM jobs UNION SELECT w.job_id, e.t, w.depth + 1, w.site FROM walk w JOIN e ON e.s = w.url JOIN ok ON ok.t = e.t AND ok.site = w.site WHERE w.depth < 2)
SELECT job_id, url, min(depth) AS depth FROM walk GROUP BY 1, 2""",
)
def _(spark, d):
    pages = _pages(spark, d)
    return links.expand_frontier(_edges(pages), _jobs(pages), links.parse_robots(_robots(spark, d)), "site")


@_register(
    "frontier_capped",
    f"""WITH {_EDGES}, {_JOBS}, e AS (SELECT DISTINCT {_CANON('src_url')} AS s, {_CANON('dst_url')} AS t FROM edges), r AS (SELECT job_id, {_CANON('root_url')} AS url FROM jobs),
a AS (SELECT * FROM (SELECT job_id, t AS url, row_number() OVER (PARTITION BY job_id ORDER BY t) AS n FROM (SELECT DISTINCT job_id, t FROM r JOIN e ON e.s = r.url WHERE t <> r.url)) WHERE n <= 4),
b AS (SELECT * FROM (SELECT job_id, t AS url, row_number() OVER (PARTITION BY job_id ORDER BY t) + (SELECT count(*) FROM a x WHERE x.job_id = y.job_id) AS n FROM (SELECT DISTINCT job_id, t FROM a JOIN e ON e.s = a.url WHERE (job_id, t) NOT IN (SELECT job_id, url FROM a UNION ALL SELECT job_id, url FROM r)) y) WHERE n <= 4)
SELECT job_id, url, 0 AS depth FROM r UNION ALL SELECT job_id, url, 1 FROM a UNION ALL SELECT job_id, url, 2 FROM b""",
)
def _(spark, d):
    pages = _pages(spark, d)
    return links.expand_frontier(_edges(pages), _jobs(pages), max_pages=5)


@_register("visited_pages", _first_sql("(SELECT job_id, seq, source_page_url AS url, CASE WHEN seq % 5 <> 0 THEN 'https://' || source_domain || '/?utm_source=a' END AS final_url FROM images)", f"job_id, {_CANON('coalesce(final_url, url)')}", "seq", "job_id, seq"), "images")
def _(spark, d):
    i = view(spark, d, "images").select("job_id", "seq", F.col("source_page_url").alias("url"), F.when(F.col("seq") % 5 != 0, F.concat(F.lit("https://"), "source_domain", F.lit("/?utm_source=a"))).alias("final_url"))
    return dedup.dedup_visited(i).select("job_id", "seq")


@_register(
    "plan_budget",
    f"""WITH RECURSIVE images AS ({view_sql('images')}), i AS MATERIALIZED (SELECT job_id, seq, file_size, coalesce(file_size, 0) AS s, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k FROM images),
f AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS total, true AS keep FROM i UNION ALL SELECT i.job_id, i.k, CASE WHEN f.total + i.s <= 20000000 THEN f.total + i.s ELSE f.total END, f.total + i.s <= 20000000 FROM f JOIN i ON i.job_id = f.job_id AND i.k = f.k + 1)
SELECT i.job_id, i.seq, i.file_size, f.keep FROM f JOIN i ON i.job_id = f.job_id AND i.k = f.k""",
)
def _(spark, d):
    return downloads.plan_budget(view(spark, d, "images").select("job_id", "seq", "file_size"), 20_000_000)


_NEXT = "least(CASE WHEN i.status IN (429, 503) THEN f.factor * 2 WHEN i.status IS NULL THEN f.factor * 1.4 WHEN i.status BETWEEN 200 AND 399 THEN greatest(f.factor * 0.75, 1) ELSE f.factor END, CAST(75 AS DOUBLE))"


@_register(
    "backoff",
    f"""WITH RECURSIVE requests AS ({view_sql('requests')}), i AS MATERIALIZED (SELECT tab_id % 20 AS job_id, status, row_number() OVER (PARTITION BY tab_id % 20 ORDER BY seq) AS k, count(*) OVER (PARTITION BY tab_id % 20) AS n FROM requests),
f AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS factor, n FROM i UNION ALL SELECT i.job_id, i.k, {_NEXT}, i.n FROM f JOIN i ON i.job_id = f.job_id AND i.k = f.k + 1)
SELECT job_id, 'page' AS kind, factor, least(greatest(factor * 800, 800), 60000) AS delay_ms FROM f WHERE k = n""",
)
def _(spark, d):
    r = view(spark, d, "requests").select((F.col("tab_id") % 20).alias("job_id"), F.lit("page").alias("kind"), "seq", "status")
    return jobs.backoff(r, 800, 60_000)


# --- branches that no other query reaches


@_register("history_search", "SELECT page_id AS job_id, url AS root_url FROM pages WHERE contains(lower(url), 'example.net/e')")
def _(spark, d):
    h = _pages(spark, d).select(F.col("page_id").alias("job_id"), F.col("url").alias("root_url"))
    return reports.history_search(h, "  Example.NET/E ")


@_register("failure_messages", "SELECT seq, CASE seq % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network' WHEN 2 THEN 'canceled' WHEN 3 THEN 'disk' ELSE 'unknown' END AS code, seq % 6 < 2 AS retryable FROM tasks", "tasks")
def _(spark, d):
    said = F.element_at(F.array(*[F.lit(m) for m in ("Request timed out", "connection RESET", "Canceled by user", "no Space left", "?", "")]), (F.col("seq") % 6 + 1).cast("int"))
    f = downloads.classify_failure(F.lit(None).cast("int"), said)
    return view(spark, d, "tasks").select("seq", f["code"].alias("code"), f["retryable"].alias("retryable"))


@_register("signature_skips", "SELECT seq, CASE WHEN is_drm THEN 'drm' WHEN is_blob THEN 'mse_blob' WHEN contains(video_url, 'token=3') THEN 'signature' END AS reason FROM videos", "videos")
def _(spark, d):
    needs = F.contains(F.col("video_url"), F.lit("token=3"))
    return view(spark, d, "videos").select("seq", downloads.video_skip_reason(F.col("is_drm"), F.col("is_blob"), needs).alias("reason"))


@_register("video_before_sound", "SELECT 'https://d.example.com/' || p_partkey || '/s.mpd' AS url, CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'v' END AS rep_id, CASE WHEN p_partkey % 3 = 0 THEN 900000 ELSE p_partkey END AS bandwidth FROM part")
def _(spark, d):
    k = F.col("p_partkey").cast("string")
    video = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit('<AdaptationSet mimeType="video/mp4"><Representation id="v" bandwidth="'), k, F.lit('"/></AdaptationSet>'))).otherwise("")
    body = F.concat(F.lit("<MPD><Period>"), video, F.lit('<AdaptationSet mimeType="audio/mp4"><Representation id="a" bandwidth="900000"/></AdaptationSet></Period></MPD>'))
    m = dealt_out(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")).select(F.concat(F.lit("https://d.example.com/"), k, F.lit("/s.mpd")).alias("url"), body.alias("body"))
    return manifests.best_variant(manifests.parse_dash(m), video_only=True).select("url", "rep_id", "bandwidth")


@_register("composed_names", "SELECT seq, 'Café ' || seq || '.mp4' AS name FROM videos", "videos")
def _(spark, d):
    raw = F.concat(F.lit("--Cafe\u0301 \U0001f600\u200b"), F.col("seq").cast("string"), F.lit(".mp4.. "))
    return view(spark, d, "videos").select("seq", text.sanitize_filename(raw, "video", compose=True).alias("name"))


# --- files: written to the shared folder and read back


@_register("url_list_file", "SELECT image_url AS value FROM images WHERE selected", "images")
def _(spark, d):
    path = new_path(spark)
    sinks.write_url_list(view(spark, d, "images"), path)
    return spark.read.text(path)


@_register("csv_file", "SELECT image_url, source_page_url, CAST(width AS VARCHAR) AS width, CAST(file_size AS VARCHAR) AS file_size, extension, status FROM images", "images")
def _(spark, d):
    path = new_path(spark)
    sinks.write_candidates_csv(view(spark, d, "images"), path)
    return spark.read.option("header", True).csv(path).select("image_url", "source_page_url", "width", "file_size", "extension", "status")


@_register("json_file", "SELECT CAST(seq AS VARCHAR) AS id, image_url, width, mime_type FROM images", "images")
def _(spark, d):
    path = new_path(spark)
    sinks.write_candidates_json(view(spark, d, "images").withColumn("id", F.col("seq").cast("string")), path)
    return spark.read.schema("id string, image_url string, width long, mime_type string").json(path)


@_register("snapshot_file", "SELECT job_id, seq, false AS selected, CASE WHEN status IN ('downloaded', 'failed') THEN status ELSE 'ready' END AS status FROM images", "images")
def _(spark, d):
    from pagequarry.sources import readers

    path = new_path(spark)
    sinks.save_snapshot({"candidates": view(spark, d, "images").select("job_id", "seq", "image_url", "selected", "status", "fingerprint")}, path)
    return readers.restore_snapshot(spark, path)["candidates"].select(F.col("job_id").cast("long").alias("job_id"), "seq", "selected", "status")


def registered() -> tuple[dict, dict]:
    return catalog._QUERIES, catalog._SQL
