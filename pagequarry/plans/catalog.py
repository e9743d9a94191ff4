"""All registered queries over the driver tables, with their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import text, urls
from pagequarry.operators import dedup, downloads, filters, html, links, manifests, metadata, netlog, reports
from pagequarry.plans import fixtures
from pagequarry.plans.fixtures import view, view_sql
from pagequarry.sources import readers
from pagequarry.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            given = ", ".join(f"{v} AS ({view_sql(v)})" for v in views.split())
            _SQL[name] = f"WITH {given} {sql}" if given and not sql.lstrip().upper().startswith("WITH") else (f"WITH {given}, " + sql.lstrip()[5:] if given else sql)
        return f

    return add


def queries() -> dict[str, Query]:
    from pagequarry.plans import file_queries, media_queries, site_queries  # noqa: F401  they register themselves

    return dict(media_queries.registered()[0])


def oracle_sql() -> dict[str, str]:
    from pagequarry.plans import file_queries, media_queries, site_queries  # noqa: F401  they register themselves

    return dict(media_queries.registered()[1])


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_pages(spark, f"{sf_dir}/pages.parquet")


# --- SQL twins of the URL functions


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _path(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)', 1)"


def _host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def _origin(u: str) -> str:
    return f"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)"


def _params(u: str) -> str:
    return f"list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '')"


def _strip(u: str, names: list[str]) -> str:
    kept = f"list_filter({_params(u)}, lambda p: NOT list_contains([{_quoted(names)}], lower(regexp_extract(p, '^([^=]*)', 1))))"
    return f"regexp_extract({u}, '^([^?#]*)', 1) || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


def _image_key(u: str) -> str:
    whole = f"regexp_replace(regexp_replace({u}, '#.*$', ''), '(?i)^([^?]*/)thumb_([^/?]+)(\\?|$)', '\\1\\2\\3')"
    return f"CASE WHEN len({_params(whole)}) > 0 AND len(list_filter({_params(whole)}, lambda p: NOT list_contains([{_quoted(urls.RESIZE)}], lower(regexp_extract(p, '^([^=]*)', 1))))) = 0 THEN regexp_extract({whole}, '^([^?]*)', 1) ELSE {whole} END"


def _video_key(u: str) -> str:
    kept = f"list_filter({_params(u)}, lambda p: NOT list_contains([{_quoted(urls.TRACKING + urls.VOLATILE)}], lower(regexp_extract(p, '^([^=]*)', 1))))"
    pairs = f"list_sort(list_transform({kept}, lambda p: lower(regexp_extract(p, '^([^=]*)', 1)) || '=' || regexp_extract(p, '=(.*)$', 1)))"
    return f"CASE WHEN starts_with({u}, 'blob:') THEN {u} ELSE {_origin(u)} || {_path(u)} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END END"


def _ext(u: str) -> str:
    return f"CASE WHEN NOT starts_with({u}, 'blob:') THEN nullif(lower(regexp_extract({_path(u)}, '\\.([A-Za-z0-9]{{2,5}})$', 1)), '') END"


def _percent(c: str) -> str:
    out = f"url_encode({c})"
    for ch in "/,!$&'()*+;=:@[]|^%":
        out = f"replace({out}, '%{ord(ch):02X}', '{ch if ch != chr(39) else chr(39) * 2}')"
    return out


LINKS_SQL = f"""raw AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages),
abs AS (SELECT page_id, {_origin("url")} || {_percent("regexp_replace(trim(href), '#.*$', '')")} AS link FROM raw
  WHERE starts_with(trim(href), '/')),
links AS (SELECT DISTINCT page_id, link FROM abs WHERE NOT coalesce({_ext("link")} IN ({_quoted(urls.NON_HTML)}), false)
  AND NOT regexp_matches({_path("link")}, '{links.ACTION}') AND NOT regexp_matches({_path("link")}, '{links.LOGIN}'))"""

# --- pages and links


@_register("links_per_host", f"WITH {LINKS_SQL} SELECT {_host('p.url')} AS host, count(DISTINCT {_strip('l.link', urls.TRACKING)}) AS n_links FROM links l JOIN pages p USING (page_id) GROUP BY 1")
def _(spark, d):
    return links.links_per_host(_pages(spark, d))


@_register("page_links", f"WITH {LINKS_SQL} SELECT page_id, link FROM links")
def _(spark, d):
    return links.page_links(_pages(spark, d))


@_register("element_links", f"WITH {LINKS_SQL} SELECT page_id, count(*) AS n FROM links GROUP BY page_id")
def _(spark, d):
    return links.extract_links(html.html_elements(_pages(spark, d), tags={"a"})).groupBy("page_id").agg(F.count("*").alias("n"))


@_register("page_elements", "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(a|meta|script)[\\s>]', 1)) AS tag FROM pages) SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL")
def _(spark, d):
    return html.html_elements(_pages(spark, d)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


_JOBS = f"jobs AS (SELECT page_id % 10 AS job_id, min(url) AS root_url FROM pages GROUP BY 1)"  # noqa: F541


def _jobs(pages: DataFrame) -> DataFrame:
    return pages.groupBy((F.col("page_id") % 10).alias("job_id")).agg(F.min("url").alias("root_url"))


_EDGES = "n AS (SELECT count(*) AS n FROM pages), edges AS (SELECT a.url AS src_url, b.url AS dst_url FROM pages a, n, (SELECT unnest([0, 1, 2]) AS k) k JOIN pages b ON b.page_id = (a.page_id * 7 + k.k) % n.n)"


def _edges(pages: DataFrame) -> DataFrame:
    n = pages.agg(F.count("*").alias("n"))
    a = pages.select(F.col("url").alias("src_url"), "page_id").crossJoin(F.broadcast(n)).select("src_url", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (F.col("page_id") * 7 + k) % F.col("n"))).alias("to"))
    return a.join(pages.select(F.col("page_id").alias("to"), F.col("url").alias("dst_url")), "to").select("src_url", "dst_url")


def _domain(u: str) -> str:
    h = f"string_split({_host(u)}, '.')"
    return f"CASE WHEN len({h}) <= 2 THEN {_host(u)} WHEN regexp_matches({h}[-1], '^[a-z]{{2}}$') AND list_contains([{_quoted(urls.SECOND_LEVELS)}], {h}[-2]) THEN array_to_string({h}[-3:], '.') ELSE array_to_string({h}[-2:], '.') END"


@_register("scope_site", f"WITH {_EDGES}, {_JOBS} SELECT j.job_id, count(*) AS n FROM edges e CROSS JOIN jobs j WHERE {_domain('e.dst_url')} = {_domain('j.root_url')} GROUP BY 1")
def _(spark, d):
    pages = _pages(spark, d)
    site = urls.registrable_domain
    roots = _jobs(pages).withColumn("site", site(F.col("root_url")))
    found = _edges(pages).withColumn("site", site(F.col("dst_url"))).join(roots, "site").select("job_id", "dst_url")
    return links.in_scope(found, _jobs(pages), "site", "dst_url").groupBy("job_id").agg(F.count("*").alias("n"))


_CANON = lambda u: _strip(u, urls.TRACKING)


@_register(
    "frontier_d2",
    f"""WITH RECURSIVE {_EDGES}, {_JOBS}, e AS (SELECT DISTINCT {_CANON('src_url')} AS s, {_CANON('dst_url')} AS t FROM edges),
walk AS (SELECT job_id, {_CANON('root_url')} AS url, 0 AS depth FROM jobs UNION SELECT w.job_id, e.t, w.depth + 1 FROM walk w JOIN e ON e.s = w.url WHERE w.depth < 2)
SELECT job_id, url, min(depth) AS depth FROM walk GROUP BY 1, 2""",
)
def _(spark, d):
    pages = _pages(spark, d)
    return links.expand_frontier(_edges(pages), _jobs(pages))


_ROBOTS = "User-agent: *\nDisallow: /de\nAllow: /de/1\nDisallow: /fr/*5\nDisallow: /en/25$\nDisallow:\nCrawl-delay: 2\nUser-agent: bot\nDisallow: /"


def _robots(spark, d):
    """A body per origin; the delay differs."""
    delay = (F.length("origin") % 3 * 0.5 + 0.5).cast("string")
    return _pages(spark, d).select(urls.origin_of(F.col("url")).alias("origin")).distinct().withColumn("body", F.replace(F.lit(_ROBOTS), F.lit("delay: 2"), F.concat(F.lit("delay: "), delay)))


_PATHQ = f"({_path('url')} || regexp_extract(url, '(\\?[^#]*)', 1))"


@_register(
    "robots_allowed",
    f"""WITH m AS (SELECT page_id, {_PATHQ} AS p FROM pages) SELECT page_id,
  coalesce(list_sort([x for x in [CASE WHEN starts_with(p, '/de') THEN struct_pack(n := 3, a := false) END, CASE WHEN starts_with(p, '/de/1') THEN struct_pack(n := 5, a := true) END,
   CASE WHEN regexp_matches(p, '^/fr/.*5.*') THEN struct_pack(n := length(p), a := false) END, CASE WHEN p = '/en/25' THEN struct_pack(n := 6, a := false) END] if x is not null], 'DESC')[1].a, true) AS allowed FROM m""",
)
def _(spark, d):
    return links.robots_allowed(_pages(spark, d), links.parse_robots(_robots(spark, d))).select("page_id", "allowed")


@_register("crawl_delay_floor", f"SELECT max(least(greatest((length({_origin('url')}) % 3 * 0.5 + 0.5) * 1000, 800), 1800)) AS delay_ms FROM pages")
def _(spark, d):
    return links.crawl_delay_floor(links.parse_robots(_robots(spark, d)), 800, 1800)


# --- candidates: URLs, dedup, records


@_register(
    "url_keys",
    f"""SELECT seq, {_CANON('image_url')} AS canonical, {_image_key('image_url')} AS variant_key, {_ext('image_url')} AS ext, {_host('image_url')} AS host, {_origin('image_url')} AS origin,
  {_domain('source_page_url')} AS domain, nullif(regexp_replace(image_url, '(?i)^([^?#]*/)thumb_([^/?#]+)([?#]|$)', '\\1\\2\\3'), image_url) AS full_url, coalesce(nullif(regexp_extract({_path('image_url')}, '([^/]+)/*$', 1), ''), {_path('image_url')}) AS basename FROM images""",
    "images",
)
def _(spark, d):
    u = F.col("image_url")
    return view(spark, d, "images").select("seq", urls.canonical_url(u).alias("canonical"), urls.image_variant_key(u).alias("variant_key"), urls.extension_from_url(u).alias("ext"), urls.hostname_of(u).alias("host"), urls.origin_of(u).alias("origin"), urls.registrable_domain(F.col("source_page_url")).alias("domain"), urls.expand_thumb_url(u).alias("full_url"), urls.url_basename(u).alias("basename"))


@_register("video_keys", f"SELECT seq, {_video_key('video_url')} AS variant_key, CASE WHEN starts_with(video_url, 'blob:') THEN video_url ELSE {_origin('video_url')} || {_path('video_url')} END AS path_key, starts_with(video_url, 'blob:') AS is_blob, regexp_matches(video_url, '^https?://[^/?#]') AS is_http FROM videos", "videos")
def _(spark, d):
    u = F.col("video_url")
    return view(spark, d, "videos").select("seq", urls.video_variant_key(u).alias("variant_key"), urls.video_variant_key(u, "path").alias("path_key"), urls.is_blob_url(u).alias("is_blob"), urls.is_http_url(u).alias("is_http"))


def _first_sql(source: str, keys: str, order: str, cols: str = "*") -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS _n FROM {source}) WHERE _n = 1"


@_register("dedup_images", _first_sql("images", f"job_id, {_image_key('image_url')}", "seq", "job_id, seq, image_url"), "images")
def _(spark, d):
    return dedup.dedup_images(view(spark, d, "images").select("job_id", "seq", "image_url"))


@_register("dedup_pages", _first_sql("images", f"job_id, {_CANON('source_page_url')}", "seq", "job_id, seq, source_page_url"), "images")
def _(spark, d):
    return dedup.dedup_pages(view(spark, d, "images").select("job_id", "seq", "source_page_url"), "source_page_url")


@_register("dedup_fingerprints", "SELECT job_id, seq, CASE WHEN fingerprint IS NOT NULL AND seq > min(seq) OVER (PARTITION BY job_id, fingerprint) THEN 'skipped' ELSE status END AS status FROM images", "images")
def _(spark, d):
    return dedup.dedup_by_fingerprint(view(spark, d, "images").select("job_id", "seq", "fingerprint", "status")).drop("fingerprint")


_PRIORITY = "CASE source_type WHEN 'youtube' THEN 3 WHEN 'hls-js' THEN 2 WHEN 'sniff' THEN 2 WHEN 'video' THEN 1 ELSE 0 END"


@_register("dedup_videos", f"WITH k AS (SELECT *, regexp_replace(video_url, '#.*$', '') AS u FROM videos), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, u ORDER BY {_PRIORITY} DESC, seq) AS _n, min(seq) OVER (PARTITION BY page_id, u) AS place FROM k) SELECT page_id, seq, video_url, source_type, place FROM r WHERE _n = 1", "videos")
def _(spark, d):
    return dedup.dedup_videos_by_priority(view(spark, d, "videos").select("page_id", "seq", "video_url", "source_type"))


@_register("merge_sources", "WITH b AS (SELECT job_id, seq, video_url, CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS s FROM videos), r AS (SELECT *, row_number() OVER (PARTITION BY job_id, video_url ORDER BY s, seq) AS _n FROM b) SELECT job_id, seq, video_url FROM r WHERE _n = 1", "videos")
def _(spark, d):
    v = view(spark, d, "videos").select("job_id", "seq", "video_url")
    return dedup.merge_sources(v.where("seq % 2 = 0"), v.where("seq % 2 = 1"))


@_register("new_video_candidates", f"WITH k AS (SELECT job_id, seq, video_url, {_video_key('video_url')} AS variant_key FROM videos), known AS (SELECT DISTINCT job_id, variant_key FROM k WHERE seq % 5 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY job_id, variant_key ORDER BY seq) AS _n FROM k WHERE seq % 5 <> 0) SELECT job_id, seq, video_url, variant_key FROM r WHERE _n = 1 AND NOT EXISTS (SELECT 1 FROM known n WHERE n.job_id = r.job_id AND n.variant_key = r.variant_key)", "videos")
def _(spark, d):
    v = view(spark, d, "videos").select("job_id", "seq", "video_url")
    return dedup.add_video_candidates(v.where("seq % 5 = 0"), v.where("seq % 5 <> 0"))


@_register("image_candidates", f"SELECT sha1(job_id || '|' || {_image_key('image_url')}) AS id, seq, {_CANON('image_url')} AS canonical_url, {_host('image_url')} AS source_domain, CAST(nullif(width, 0) AS DOUBLE) / nullif(height, 0) AS aspect_ratio, {_ext('image_url')} AS extension FROM images", "images")
def _(spark, d):
    hits = view(spark, d, "images").withColumn("alt", F.lit(None).cast("string"))
    return dedup.build_image_candidates(hits).select("id", "seq", "canonical_url", "source_domain", "aspect_ratio", "extension")


@_register("video_candidates", f"SELECT sha1(job_id || '|' || {_video_key('video_url')}) AS id, seq, container, is_manifest, is_drm, starts_with(video_url, 'blob:') AS is_blob FROM videos", "videos")
def _(spark, d):
    raw = view(spark, d, "videos").withColumn("source_page_url", F.lit("https://p.example.com/"))
    return dedup.build_video_candidates(raw).select("id", "seq", "container", "is_manifest", "is_drm", "is_blob")


@_register("cap_images", "SELECT job_id, seq, count(*) OVER (PARTITION BY job_id) > 100 AS limit_images_reached FROM images QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) <= 100", "images")
def _(spark, d):
    return links.cap_images(view(spark, d, "images").select("job_id", "seq"), 100)


@_register("cap_pages", "SELECT job_id, seq, depth, count(*) OVER (PARTITION BY job_id) > 50 AS limit_reached FROM images QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY depth, seq) <= 50", "images")
def _(spark, d):
    return links.cap_pages(view(spark, d, "images").select("job_id", "seq", "depth"), 50)


@_register("page_index", "WITH f AS (SELECT job_id, source_page_url, min(seq) AS s FROM images GROUP BY 1, 2) SELECT job_id, source_page_url, row_number() OVER (PARTITION BY job_id ORDER BY s) AS page_no FROM f", "images")
def _(spark, d):
    return links.page_index(view(spark, d, "images"))


# --- filters, sorting, selection

_F = filters.ImageFilter(min_width=300, min_size_kb=50, max_aspect=1.5, exclude_formats=("gif",), exclude_svg=True, exclude_tiny=True)
_CONDS = "coalesce(width >= 300, false), coalesce(file_size >= 51200, false), coalesce(aspect_ratio <= 1.5, false), coalesce(extension, '') <> 'gif', coalesce(extension, '') <> 'svg' AND NOT contains(coalesce(mime_type, ''), 'svg'), coalesce(width IS NOT NULL AND height IS NOT NULL AND NOT (width <= 16 AND height <= 16), false)"


def _both(mode: str) -> str:
    return "(" + f" {mode} ".join(f"({c.strip()})" for c in _CONDS.replace(", coalesce", "; coalesce").split("; ")) + ")"


@_register("image_filter_and", f"SELECT seq FROM images WHERE {_both('AND')}", "images")
def _(spark, d):
    return view(spark, d, "images").where(filters.image_filter(_F)).select("seq")


@_register("image_filter_or", "SELECT seq FROM images WHERE coalesce(width >= 1900, false) OR coalesce(file_size >= 3072000, false) OR coalesce(extension, '') IN ('bmp')", "images")
def _(spark, d):
    f = filters.ImageFilter(min_width=1900, min_size_kb=3000, include_formats=("bmp",), mode="OR")
    return view(spark, d, "images").where(filters.image_filter(f)).select("seq")


_DEAD = "NOT (container = 'unknown' AND coalesce(file_size, 0) = 0 AND NOT is_manifest AND NOT is_blob AND NOT is_live)"


@_register("video_filter", f"SELECT seq FROM videos WHERE {_DEAD} AND coalesce(duration_sec >= 60, false) AND coalesce(bitrate_kbps >= 500, false) AND container NOT IN ('ts') AND NOT is_drm AND NOT is_blob", "videos")
def _(spark, d):
    f = filters.VideoFilter(min_duration=60, min_bitrate=500, exclude_containers=("ts",), exclude_drm=True, exclude_blobs=True, exclude_ads=True)
    return view(spark, d, "videos").where(filters.video_filter(f)).select("seq")


@_register("match_counts", f"SELECT job_id, count(*) AS found, count(*) FILTER (WHERE {_both('AND')}) AS matched, count(*) FILTER (WHERE selected) AS selected FROM images GROUP BY 1", "images")
def _(spark, d):
    return filters.match_counts(view(spark, d, "images"), filters.image_filter(_F))


@_register("selection_changes", "SELECT seq, coalesce(file_size >= 500000, false) AS selected FROM images WHERE coalesce(file_size >= 500000, false) <> selected", "images")
def _(spark, d):
    return filters.selection_changes(view(spark, d, "images"), F.col("file_size") >= 500_000).select("seq", "selected")


@_register("facets", "WITH s AS (SELECT job_id, source_domain AS value, row_number() OVER (PARTITION BY job_id ORDER BY min(seq)) AS place FROM images GROUP BY 1, 2), e AS (SELECT job_id, extension AS value, row_number() OVER (PARTITION BY job_id ORDER BY extension) AS place FROM images WHERE extension IS NOT NULL GROUP BY 1, 2), p AS (SELECT job_id, depth, row_number() OVER (PARTITION BY job_id ORDER BY depth) AS place FROM images GROUP BY 1, 2) SELECT job_id, 'domain' AS facet, value, place FROM s WHERE place <= 100 UNION ALL SELECT job_id, 'extension', value, place FROM e UNION ALL SELECT job_id, 'depth', CAST(depth AS STRING), place FROM p", "images")
def _(spark, d):
    return filters.facets(view(spark, d, "images"))


@_register("sort_page", "SELECT seq, width, height FROM images ORDER BY coalesce(width, 0) * coalesce(height, 0) DESC, seq LIMIT 60 OFFSET 40", "images")
def _(spark, d):
    return filters.page_of(filters.sort_candidates(view(spark, d, "images"), "resolution", "desc"), 40, 60).select("seq", "width", "height")


@_register("visible_videos", f"SELECT seq, is_blob FROM videos WHERE {_DEAD} AND NOT is_drm ORDER BY is_blob, coalesce(duration_sec, -1) ASC, seq LIMIT 200", "videos")
def _(spark, d):
    f = filters.video_filter(filters.VideoFilter(exclude_drm=True))
    return filters.visible(view(spark, d, "videos"), f, "duration", "asc").limit(200).select("seq", "is_blob")


@_register("search_videos", "SELECT seq FROM videos WHERE contains(lower(video_url), 'v3.') OR contains(lower(source_type), 'v3.') OR contains(lower(container), 'v3.')", "videos")
def _(spark, d):
    return filters.search(view(spark, d, "videos"), " V3. ").select("seq")


@_register("media_classes", "SELECT CASE WHEN is_live THEN 'live' WHEN coalesce(duration_sec, 0) >= 1800 OR coalesce(segment_count, 0) >= 400 THEN 'broadcast' WHEN duration_sec > 0 AND duration_sec <= 15 AND file_size > 0 AND file_size < 1500000 THEN 'sticker' ELSE 'video' END AS class, count(*) AS n FROM videos GROUP BY 1", "videos")
def _(spark, d):
    c = filters.media_class(F.col("duration_sec"), F.col("segment_count"), F.col("file_size"), F.col("is_live"))
    return view(spark, d, "videos").groupBy(c.alias("class")).agg(F.count("*").alias("n"))


# --- metadata


def _responses(spark, d):
    r = view(spark, d, "responses")
    names = ["content_type", "content_length", "content_range", "content_disposition"]
    pairs = F.filter(F.array(*[F.struct(F.lit(n.replace("_", "-")).alias("key"), F.col(n).alias("value")) for n in names]), lambda e: e["value"].isNotNull())
    return r.select("url", "seq", "method", "status", F.map_from_entries(pairs).alias("headers"), "final_url")


_ONE = lambda m: f"(SELECT * FROM responses WHERE method = '{m}' QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)"
_MIME = lambda a: f"trim(regexp_extract(lower({a}.content_type), '^([^;]*)', 1))"
_SIZE = lambda a: f"coalesce(try_cast(nullif(regexp_extract({a}.content_range, '/([0-9]+)$', 1), '') AS BIGINT), try_cast({a}.content_length AS BIGINT))"


@_register("resolve_headers", f"SELECT i.seq, coalesce({_MIME('h')}, {_MIME('g')}) AS header_mime, coalesce({_SIZE('h')}, {_SIZE('g')}) AS header_size, coalesce(h.content_disposition, g.content_disposition) AS disposition, coalesce(h.status, g.status) AS http_status FROM images i LEFT JOIN {_ONE('HEAD')} h ON h.url = i.image_url LEFT JOIN {_ONE('GET')} g ON g.url = i.image_url", "images responses")
def _(spark, d):
    out = metadata.resolve_headers(view(spark, d, "images").select("seq", "image_url"), _responses(spark, d))
    return out.select("seq", "header_mime", "header_size", "disposition", "http_status")


@_register("http_classes", "SELECT CASE WHEN status IN (401, 403, 404) THEN 'permanent' WHEN status = 429 OR status >= 500 THEN 'retryable' ELSE 'ok' END AS class, count(*) AS n FROM responses GROUP BY 1", "responses")
def _(spark, d):
    return view(spark, d, "responses").groupBy(metadata.classify_http_status(F.col("status")).alias("class")).agg(F.count("*").alias("n"))


@_register("sniff_images", "SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE width END AS width, CASE WHEN id % 3 = 2 THEN NULL ELSE height END AS height, CASE WHEN id % 3 = 2 THEN 'unknown' ELSE 'raster' END AS kind, sha1(unhex(hex_body)) AS print FROM heads", "heads")
def _(spark, d):
    body = F.unhex("hex_body")
    s = view(spark, d, "heads").select("id", metadata.sniff_image(body, F.col("mime")).alias("s"), metadata.fingerprint(body).alias("print"))
    return s.select("id", F.col("s.width").cast("long").alias("width"), F.col("s.height").cast("long").alias("height"), "s.kind", "print")


@_register("detect_formats", "SELECT id, CASE id % 3 WHEN 2 THEN 'webm' WHEN 1 THEN 'ts' ELSE 'mp4' END AS container, CASE id % 3 WHEN 2 THEN 'video/webm' WHEN 1 THEN 'video/mp2t' ELSE 'video/mp4' END AS mime, CAST(CASE id % 3 WHEN 2 THEN 0.97 WHEN 1 THEN 0.85 ELSE 0.5 END AS DOUBLE) AS confidence FROM heads", "heads")
def _(spark, d):
    f = metadata.detect_format(F.unhex("hex_body"), F.lit("https://x.example.com/a.mp4"), F.lit(None).cast("string"))
    return view(spark, d, "heads").select("id", f.alias("f")).select("id", "f.container", "f.mime", "f.confidence")


@_register("video_figures", "SELECT seq, CASE WHEN duration_sec > 0 AND duration_sec <= 172800 THEN duration_sec END AS duration, CAST(floor(file_size * 8.0 / (CASE WHEN duration_sec > 0 THEN duration_sec END * 1000) + 0.5) AS BIGINT) AS kbps, CASE WHEN http_status IN (401, 403) THEN true ELSE false END AS hotlink, CASE WHEN container = 'unknown' AND coalesce(file_size, 0) = 0 AND NOT is_manifest AND NOT is_blob AND NOT is_live THEN 'failed' ELSE 'ready' END AS status, CAST(nullif(regexp_extract(video_url, 'clen=([0-9]+)', 1), '') AS BIGINT) AS clen FROM videos", "videos")
def _(spark, d):
    v = metadata.video_status_after_meta(view(spark, d, "videos"))
    return v.select("seq", metadata.sane_duration(F.col("duration_sec")).alias("duration"), metadata.bitrate_kbps(F.col("file_size"), F.col("duration_sec")).alias("kbps"), "hotlink", "status", metadata.query_param_meta(F.col("video_url"), F.lit(None).cast("long"), F.lit(None).cast("string"))["size"].alias("clen"))


# --- manifests

_V = "unnest([struct_pack(n := 0, u := 'https://m.example.com/' || k || '/low.m3u8', b := p + 1000, w := 640, h := 360, l := '640x360'), struct_pack(n := 1, u := 'https://x.example.com/' || k || '/hi.m3u8', b := p * 2 + 1000, w := 1280, h := 720, l := '1280x720'), struct_pack(n := 2, u := 'https://m.example.com/abs.m3u8', b := p + 500, w := NULL, h := NULL, l := CAST(floor((p + 500) / 1000 + 0.5) AS BIGINT) || 'kbps')])"


@_register("hls_master", f"SELECT url, v.n AS variant_no, v.u AS variant_url, v.b AS bandwidth, v.w AS width, v.h AS height, v.l AS label, CASE WHEN k % 4 = 0 THEN 'https://m.example.com/' || k || '/audio.m3u8' END AS audio_url FROM (SELECT url, k, {_V} AS v FROM hls_master)", "hls_master")
def _(spark, d):
    return manifests.hls_variants(view(spark, d, "hls_master")).select("url", "variant_no", "variant_url", "bandwidth", "width", "height", "label", "audio_url")


@_register("best_variants", "SELECT url, CASE WHEN p > 0 THEN 'https://x.example.com/' || k || '/hi.m3u8' ELSE 'https://m.example.com/' || k || '/low.m3u8' END AS variant_url, greatest(p * 2, p) + 1000 AS bandwidth FROM hls_master", "hls_master")
def _(spark, d):
    return manifests.best_variant(manifests.hls_variants(view(spark, d, "hls_master"))).select("url", "variant_url", "bandwidth")


_ITEMS = "WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS k FROM lineitem)"


@_register(
    "hls_segments",
    f"""{_ITEMS}, s AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN l_partkey % 90 + 10 END AS len, CASE WHEN l_orderkey % 2 = 0 AND l_linenumber % 3 = 1 THEN 1000 END AS off,
  max(CASE WHEN l_linenumber = 2 THEN k * 2 + 1 WHEN l_linenumber = 5 AND l_orderkey % 3 = 0 THEN k * 2 END) OVER (PARTITION BY l_orderkey ORDER BY k) AS mark FROM i),
r AS (SELECT *, sum(CASE WHEN off IS NOT NULL OR k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY k) AS run FROM s)
SELECT 'https://m.example.com/' || l_orderkey || '.m3u8' AS url, 'https://s.example.com/seg_' || l_partkey || '.ts' AS seg_url, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS duration, l_orderkey % 50 + k AS seq,
  CASE WHEN mark % 2 = 1 THEN 'AES-128' END AS key_method, len AS range_length,
  CASE WHEN len IS NOT NULL THEN coalesce(first_value(off) OVER (PARTITION BY l_orderkey, run ORDER BY k), 0) + coalesce(sum(len) OVER (PARTITION BY l_orderkey, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS range_start FROM r""",
)
def _(spark, d):
    seg = manifests.parse_hls_media(fixtures.hls_media(spark, d)).where("not is_init")
    return seg.select("url", "seg_url", "duration", "seq", "key_method", "range_length", "range_start")


@_register("hls_info", f"{_ITEMS} SELECT 'https://m.example.com/' || l_orderkey || '.m3u8' AS url, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS total_duration, count(*) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS segment_count, l_orderkey % 2 = 0 AS is_vod, bool_or(l_linenumber = 2) AS is_encrypted, false AS is_drm, l_orderkey % 5 = 0 AS is_fmp4 FROM i GROUP BY l_orderkey")
def _(spark, d):
    return manifests.hls_info(fixtures.hls_media(spark, d)).drop("is_master")


@_register("dash_variants", "SELECT url, 'https://d.example.com/' || k || '/v' || (k % 3) || '/init.mp4' AS variant_url, k * 10 AS bandwidth, '640x360' AS label, false AS is_audio_only FROM dash", "dash")
def _(spark, d):
    return manifests.parse_dash(view(spark, d, "dash")).select("url", "variant_url", "bandwidth", "label", "is_audio_only")


@_register("dash_info", "SELECT url, k % 5 = 0 AS is_live, CAST(n * 60 + 3 AS DOUBLE) AS duration, k % 7 = 0 AS is_drm FROM dash", "dash")
def _(spark, d):
    return manifests.dash_info(view(spark, d, "dash"))


@_register("dash_segments", "WITH c AS (SELECT *, CAST(ceil((n * 60 + 3) / 30.0) AS BIGINT) AS total FROM dash) SELECT url, 0 AS seg_no, 'https://d.example.com/' || k || '/v' || (k % 3) || '/init.mp4' AS seg_url FROM c UNION ALL SELECT url, i, 'https://d.example.com/' || k || '/v' || (k % 3) || '/c_' || lpad(CAST(i + 2 AS STRING), CAST(greatest(4, length(CAST(i + 2 AS STRING))) AS INT), '0') || '.m4s' FROM (SELECT *, unnest(range(1, total + 1)) AS i FROM c)", "dash")
def _(spark, d):
    return manifests.dash_segments(manifests.dash_representations(view(spark, d, "dash"))).select("url", F.col("seg_no").cast("long").alias("seg_no"), "seg_url")


@_register("segment_plan", f"{_ITEMS} SELECT 'https://m.example.com/' || l_orderkey || '.m3u8' AS url, count(*) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n, count(*) FILTER (WHERE l_orderkey % 2 = 0) AS ranged FROM i GROUP BY l_orderkey")
def _(spark, d):
    seg = manifests.parse_hls_media(fixtures.hls_media(spark, d)).withColumn("is_audio", F.lit(False))
    return manifests.segment_plan(seg).groupBy("url").agg((F.max("fetch_no") + 1).cast("long").alias("n"), F.count("range_header").alias("ranged"))


# --- request logs


@_register("resource_log", f"WITH k AS (SELECT tab_id, seq, url AS video_url, {_ext('url')} AS e, transfer_size FROM requests), f AS (SELECT *, row_number() OVER (PARTITION BY tab_id, video_url ORDER BY seq) AS _n FROM k WHERE e IN ({_quoted(netlog.MEDIA)}) AND NOT (e NOT IN ('m3u8', 'mpd') AND transfer_size > 0 AND transfer_size < 50000)) SELECT tab_id, seq, video_url, CASE e WHEN 'm3u8' THEN 'hls' WHEN 'ts' THEN 'ts' ELSE 'mp4' END AS container, e = 'm3u8' AS is_manifest FROM f WHERE _n = 1", "requests")
def _(spark, d):
    return netlog.filter_resource_log(view(spark, d, "requests"))


_NET = """net AS (SELECT *, contains(url, 'googlevideo.com/videoplayback') AS yt, try_cast(nullif(regexp_extract(url, 'itag=([0-9]+)', 1), '') AS INT) AS itag FROM requests
 WHERE (type = 'media' OR regexp_matches(url, '(?i)\\.(mp4|webm|mkv|mov|m4v|ts|m3u8|mpd)(\\?|$)') OR regexp_matches(url, '(?i)videoplayback|/hls/|/live/|/stream/')) AND NOT contains(url, 'youtube.com/s/search/audio/') AND NOT (contains(url, 'googlevideo.com/videoplayback') AND regexp_matches(url, '[?&]itag=(324|325|326|327|328|329)\\b'))),
c AS (SELECT tab_id, ts, seq, CASE WHEN yt THEN regexp_replace(url, '&range=[^&]*', '') ELSE url END AS video_url, CASE WHEN yt THEN 'yt-' || regexp_extract(url, '[?&]id=([^&]*)', 1) || '-' || itag ELSE url END AS storage_key,
 CASE itag WHEN 18 THEN '360p' WHEN 22 THEN '720p' WHEN 140 THEN 'M4A 128k' END AS quality, coalesce(itag = 140, false) AS audio_only, CASE WHEN contains(url, '.m3u8') THEN 'hls' WHEN coalesce(itag = 140, false) THEN 'webm' ELSE 'mp4' END AS container FROM net)"""


@_register("network_candidates", f"WITH {_NET} SELECT tab_id, seq, video_url, storage_key, quality, audio_only, container FROM c", "requests")
def _(spark, d):
    c = netlog.network_candidates(netlog.filter_network_log(view(spark, d, "requests")))
    return c.select("tab_id", "seq", "video_url", "storage_key", "quality", "audio_only", "container")


@_register("latest_per_key", f"WITH {_NET} SELECT tab_id, storage_key, seq FROM c QUALIFY row_number() OVER (PARTITION BY tab_id, storage_key ORDER BY ts DESC, seq DESC) = 1", "requests")
def _(spark, d):
    c = netlog.network_candidates(netlog.filter_network_log(view(spark, d, "requests")))
    return netlog.latest_per_key(c).select("tab_id", "storage_key", "seq")


@_register("sample_per_host", f"SELECT {_host('url')} AS host, seq FROM requests QUALIFY row_number() OVER (PARTITION BY {_host('url')} ORDER BY seq) <= 10", "requests")
def _(spark, d):
    return netlog.sample_per_host(view(spark, d, "requests")).select("host", "seq")


@_register("bounded_findings", "WITH o AS (SELECT tab_id, url, min(seq) AS seq FROM requests GROUP BY 1, 2) SELECT tab_id, url, seq FROM o QUALIFY row_number() OVER (PARTITION BY tab_id ORDER BY seq DESC) <= 20", "requests")
def _(spark, d):
    return netlog.bounded_findings(view(spark, d, "requests").select("tab_id", "url", "seq"), 20, "tab_id")


@_register("fresh_findings", "SELECT a.tab_id AS page_id, a.url, a.seq FROM requests a WHERE a.seq % 2 = 0 AND NOT EXISTS (SELECT 1 FROM requests b WHERE b.seq % 2 = 1 AND b.tab_id = a.tab_id AND b.url = a.url)", "requests")
def _(spark, d):
    r = view(spark, d, "requests").select(F.col("tab_id").alias("page_id"), "url", "seq")
    return netlog.fresh_findings(r.where("seq % 2 = 0"), r.where("seq % 2 = 1"))


@_register("redacted_headers", "SELECT user_id, '[hidden]' AS cookie, 'https://p.example.com' AS referer, left(repeat(event_type, 40), 120) AS x FROM (SELECT DISTINCT user_id, event_type FROM events)")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type").distinct()
    h = netlog.redact_headers(F.create_map(F.lit("Cookie"), F.lit("a=b"), F.lit("Referer"), F.lit("https://p.example.com/x?y"), F.lit("X"), F.repeat("event_type", 40)))
    return e.select("user_id", h.alias("h")).select("user_id", F.col("h")["cookie"].alias("cookie"), F.col("h")["referer"].alias("referer"), F.col("h")["x"].alias("x"))


@_register("media_urls", "SELECT DISTINCT tab_id, regexp_replace(url, '#.*$', '') AS media_url FROM requests WHERE regexp_matches(url, '\\.(mp4|m3u8)') OR contains(url, 'videoplayback?')", "requests")
def _(spark, d):
    r = view(spark, d, "requests").select(F.col("tab_id").cast("string").alias("url"), F.concat(F.lit('{"u":"'), F.replace("url", F.lit("/"), F.lit("\\/")), F.lit('"}')).alias("body"))
    return html.scan_media_urls(r).select(F.col("url").cast("long").alias("tab_id"), "media_url").distinct()


# --- plans


@_register("plan_until_total", "SELECT job_id, seq, coalesce(sum(coalesce(file_size, 0)) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 20000000 AS keep FROM images", "images")
def _(spark, d):
    return downloads.plan_until_total(view(spark, d, "images").select("job_id", "seq", "file_size"), 20_000_000).drop("file_size")


@_register("unique_paths", "WITH f AS (SELECT job_id, seq, 'images/' || 'depth_' || depth AS folder, coalesce(title, 'image') || '.jpg' AS filename FROM images), k AS (SELECT *, row_number() OVER (PARTITION BY job_id, folder, lower(filename) ORDER BY seq) - 1 AS k FROM f) SELECT job_id, seq, folder || '/' || CASE WHEN k = 0 THEN filename ELSE replace(filename, '.jpg', '') || ' (' || k || ').jpg' END AS path FROM k", "images")
def _(spark, d):
    i = view(spark, d, "images")
    named = downloads.target_folder(i, "depth", "images").withColumn("filename", F.concat(text.sanitize_filename(F.coalesce("title", F.lit(""))), F.lit(".jpg")))
    return downloads.uniquify_paths(named).select("job_id", "seq", "path")


@_register("download_routes", "SELECT seq, CASE WHEN status = 'downloaded' THEN 'none' WHEN status = 'failed' AND coalesce(error_kind, '') = 'metadata' THEN 'metadata' ELSE 'download' END AS action, CASE WHEN status = 'failed' THEN CASE WHEN coalesce(error_kind, '') = 'metadata' OR file_size IS NULL THEN 'metadata' ELSE 'download' END END AS retry FROM images", "images")
def _(spark, d):
    i = downloads.route_downloads(view(spark, d, "images")).withColumnRenamed("action", "first")
    return downloads.route_retries(i).select("seq", F.col("first").alias("action"), F.col("action").alias("retry"))


_OK = "(retryable AND retry_count <= 2)"


@_register("retry_times", f"SELECT seq, CASE WHEN {_OK} THEN failed_at + CAST(least(500 * pow(2.0, least(sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq) - 1, 20)), 10000) AS BIGINT) END AS image_at, CASE WHEN {_OK} THEN failed_at + CAST(least(2000 * pow(2.0, retry_count - 1), 30000) AS BIGINT) END AS video_at FROM tasks", "tasks")
def _(spark, d):
    t = view(spark, d, "tasks").select("job_id", "seq", "retryable", "retry_count", "failed_at")
    a = downloads.retry_at(t, "image").withColumnRenamed("retry_at", "image_at")
    return downloads.retry_at(a, "video").select("seq", "image_at", F.col("retry_at").alias("video_at"))


@_register("next_tasks", "SELECT job_id, seq, priority FROM tasks WHERE status = 'pending' AND coalesce(retry_at, 0) <= 2000 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY priority DESC, created_at, seq) <= 8", "tasks")
def _(spark, d):
    return downloads.next_tasks(view(spark, d, "tasks"), 2000, 8).select("job_id", "seq", "priority")


@_register("waits", "SELECT job_id, coalesce(greatest(min(CASE WHEN status = 'pending' THEN coalesce(retry_at, 0) END) - 100, 0), 0) AS wait_ms FROM tasks GROUP BY 1", "tasks")
def _(spark, d):
    return downloads.ms_until_ready(view(spark, d, "tasks"), 100)


@_register("file_names", "SELECT seq, CASE WHEN regexp_matches(n, '(?i)\\.[a-z0-9]{2,5}$') OR extension IS NULL THEN n ELSE n || '.' || extension END AS name FROM (SELECT seq, extension, regexp_extract(image_url, '([^/]+?)(\\?.*)?$', 1) AS n FROM images)", "images")
def _(spark, d):
    null = F.lit(None).cast("string")
    n = downloads.image_filename(null, F.col("image_url"), null, F.col("title"), F.col("extension"), F.lit("image"))
    return view(spark, d, "images").select("seq", n.alias("name"))


@_register("failure_classes", "SELECT code, code IN ('rate_limited', 'server') AS retryable, count(*) AS n FROM (SELECT CASE WHEN status IN (401, 403) THEN 'forbidden' WHEN status = 404 THEN 'not_found' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'server' ELSE 'unknown' END AS code FROM responses) GROUP BY 1, 2", "responses")
def _(spark, d):
    f = downloads.classify_failure(F.col("status"), F.lit(None).cast("string"))
    return view(spark, d, "responses").select(f.alias("f")).groupBy(F.col("f.code").alias("code"), F.col("f.retryable").alias("retryable")).agg(F.count("*").alias("n"))


@_register("skip_reasons", "SELECT CASE WHEN is_drm THEN 'drm' WHEN is_blob THEN 'mse_blob' END AS reason, count(*) AS n FROM videos GROUP BY 1", "videos")
def _(spark, d):
    r = downloads.video_skip_reason(F.col("is_drm"), F.col("is_blob"), F.lit(False))
    return view(spark, d, "videos").groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


# --- reports


@_register("scan_summary", "SELECT job_id, count(*) AS candidates, count(*) FILTER (WHERE is_drm) AS drm, count(*) FILTER (WHERE is_manifest) AS manifests, count(*) FILTER (WHERE is_blob) AS blobs, count(*) FILTER (WHERE container = 'hls') AS hls, count(*) FILTER (WHERE source_type = 'sniff') AS sniffed FROM videos GROUP BY 1", "videos")
def _(spark, d):
    s = reports.scan_summary(view(spark, d, "videos"))
    n = lambda c, k: F.coalesce(F.col(c)[k], F.lit(0)).alias
    return s.select("job_id", "candidates", "drm", "manifests", "blobs", n("by_container", "hls")("hls"), n("by_source", "sniff")("sniffed"))


@_register("task_counts", "SELECT job_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in reports.TASK_STATUSES) + " FROM tasks GROUP BY 1", "tasks")
def _(spark, d):
    return reports.task_counts(view(spark, d, "tasks"))


@_register("job_stats", "SELECT job_id, count(*) AS images, count(*) FILTER (WHERE status = 'downloaded') AS downloaded, CAST(sum(CASE WHEN status = 'downloaded' THEN coalesce(file_size, 0) ELSE 0 END) AS BIGINT) AS bytes, count(*) FILTER (WHERE status = 'failed') AS errors, count(DISTINCT source_page_url) AS pages FROM images GROUP BY 1", "images")
def _(spark, d):
    i = view(spark, d, "images").withColumn("bytes_downloaded", F.lit(None).cast("long"))
    return reports.job_stats(i, i.select("job_id", "source_page_url").distinct(), i, i.where("status = 'failed'")).select("job_id", "images", "downloaded", "bytes", "errors", "pages")


@_register("download_summary", "SELECT job_id, count(*) FILTER (WHERE status = 'downloading') AS active, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'downloaded') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, CAST(coalesce(sum(file_size) FILTER (WHERE status = 'downloaded'), 0) AS BIGINT) AS volume FROM images GROUP BY 1", "images")
def _(spark, d):
    return reports.download_summary(view(spark, d, "images"))


@_register("progress", "SELECT job_id, CAST(least(floor(100.0 * count(*) FILTER (WHERE status IN ('done', 'failed', 'skipped')) / count(*) + 0.5), 100) AS INT) AS percent, CAST(floor(count(*) FILTER (WHERE status IN ('pending', 'retry')) * 1300.0 / 2 + 0.5) AS BIGINT) AS eta_ms FROM tasks GROUP BY 1", "tasks")
def _(spark, d):
    return reports.progress(view(spark, d, "tasks"), 800, 1800, 2)


@_register("error_tail", "SELECT job_id, seq FROM logs WHERE level = 'error' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) <= 50", "logs")
def _(spark, d):
    return reports.error_tail(view(spark, d, "logs").where("level = 'error'"), 50).select("job_id", "seq")


@_register("log_filter", "SELECT seq FROM logs WHERE level IN ('warn', 'error') AND category IN ('cat1', 'cat3') AND (contains(lower(message), '7') OR coalesce(contains(lower(ref), '7'), false))", "logs")
def _(spark, d):
    return reports.filter_logs(view(spark, d, "logs"), "warn", ["cat1", "cat3"], "7").select("seq")


@_register("log_tail", "SELECT job_id, seq FROM logs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) <= 40", "logs")
def _(spark, d):
    v = view(spark, d, "logs")
    return reports.log_tail(v.where("seq % 2 = 0"), v.where("seq % 2 = 1"), 40).select("job_id", "seq")


@_register("log_lines", "SELECT '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z] [' || upper(level) || '] [' || category || '] ' || message AS value FROM logs", "logs")
def _(spark, d):
    return reports.format_log(view(spark, d, "logs"))


@_register("history", "SELECT page_id AS job_id, url AS root_url FROM pages ORDER BY page_id * 7 % 1009 DESC, page_id LIMIT 50")
def _(spark, d):
    h = _pages(spark, d).select(F.col("page_id").alias("job_id"), F.col("url").alias("root_url"), (F.col("page_id") * 7 % 1009).alias("started_at"))
    return reports.history_append(h.where("job_id % 2 = 0"), h.where("job_id % 2 = 1")).drop("started_at")


@_register("patched", "SELECT id, arg_max(width, ts) FILTER (WHERE width IS NOT NULL) AS width, arg_max(status, ts) FILTER (WHERE status IS NOT NULL) AS status, arg_max(message, ts) FILTER (WHERE message IS NOT NULL) AS message FROM patches GROUP BY 1", "patches")
def _(spark, d):
    return jobs.apply_patches(view(spark, d, "patches"))


@_register("observation_window", "SELECT tab_id AS page_id, url, min(ts) AS ts FROM (SELECT r.*, min(ts) OVER (PARTITION BY tab_id) AS s FROM requests r) WHERE ts <= s + INTERVAL 100000 SECOND GROUP BY 1, 2", "requests")
def _(spark, d):
    r = view(spark, d, "requests").select(F.col("tab_id").alias("page_id"), "url", "ts")
    return jobs.within_observation_window(r, r.groupBy("page_id").agg(F.min("ts").alias("started_at")), 100_000_000)


@_register("readable_figures", "SELECT seq, CASE WHEN width IS NULL OR height IS NULL OR width = 0 OR height = 0 THEN '—' ELSE width || '×' || height END AS size, CASE WHEN file_size IS NULL THEN '—' WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN (CAST(floor(file_size / 1024.0 * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(file_size / 1024.0 * 10 + 0.5) AS BIGINT) % 10) || ' KB' ELSE (CAST(floor(file_size / 1048576.0 * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(file_size / 1048576.0 * 10 + 0.5) AS BIGINT) % 10) || ' MB' END AS bytes FROM images", "images")
def _(spark, d):
    return view(spark, d, "images").select("seq", text.format_resolution(F.col("width"), F.col("height")).alias("size"), text.format_bytes(F.col("file_size")).alias("bytes"))
