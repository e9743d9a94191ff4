"""Views of media, requests, manifests and tasks derived from the driver tables.

The driver tables hold no pictures or manifests, so each view is one SELECT over a table, in SQL that reads the same to Spark
and DuckDB: the queries run on it through Spark and their twins through DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EXT = "CASE o_orderkey % 8 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'svg' WHEN 5 THEN 'JPEG' WHEN 6 THEN 'bmp' ELSE 'avif' END"
_IMAGE_URL = f"""'https://cdn' || CAST(o_custkey % 7 AS STRING) || '.example.com/img/' || CASE WHEN o_orderkey % 11 = 0 THEN 'thumb_' ELSE '' END
  || CAST(o_orderkey % 900 AS STRING) || '.' || {_EXT}
  || CASE WHEN o_orderkey % 13 = 0 THEN '?w=300&id=' || CAST(o_orderkey % 4 AS STRING) WHEN o_orderkey % 3 = 1 THEN '?w=' || CAST(o_orderkey % 5 * 100 AS STRING) || '&q=80'
     WHEN o_orderkey % 5 = 2 THEN '?id=' || CAST(o_orderkey % 9 AS STRING) || '&utm_source=x' ELSE '' END"""

VIEWS = {
    "images": f"""SELECT o_custkey % 20 AS job_id, o_orderkey AS seq, {_IMAGE_URL} AS image_url,
  'https://' || CASE WHEN o_custkey % 3 = 0 THEN 'www.' ELSE '' END || 'site' || CAST(o_custkey % 13 AS STRING) || '.co.uk/p/' || CAST(o_orderkey % 50 AS STRING) AS source_page_url,
  'site' || CAST(o_custkey % 130 AS STRING) || '.example.com' AS source_domain,
  CASE WHEN o_orderkey % 10 IN (3, 7) THEN NULL ELSE CAST(floor(o_totalprice / 7) AS BIGINT) % 2000 END AS width,
  CASE WHEN o_orderkey % 10 IN (3, 7) THEN NULL ELSE CAST(floor(o_totalprice / 3) AS BIGINT) % 1500 END AS height,
  CASE WHEN o_orderkey % 7 = 4 THEN NULL ELSE CAST(floor(o_totalprice * 10) AS BIGINT) END AS file_size,
  CASE WHEN o_orderkey % 8 = 5 THEN NULL ELSE lower({_EXT}) END AS extension,
  CASE WHEN o_orderkey % 8 = 4 THEN 'image/svg+xml' END AS mime_type,
  CASE WHEN o_orderkey % 10 IN (3, 7) THEN NULL ELSE CAST(CAST(floor(o_totalprice / 7) AS BIGINT) % 2000 AS DOUBLE) / 1000 END AS aspect_ratio,
  o_orderkey % 3 AS depth, o_orderkey % 4 = 0 AS selected,
  CASE o_orderkey % 6 WHEN 0 THEN 'discovered' WHEN 1 THEN 'ready' WHEN 2 THEN 'downloaded' WHEN 3 THEN 'failed' WHEN 4 THEN 'queued' ELSE 'skipped' END AS status,
  CASE WHEN o_orderkey % 4 = 1 THEN 'metadata' WHEN o_orderkey % 4 = 2 THEN 'download' END AS error_kind,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'picture ' || CAST(o_custkey % 40 AS STRING) END AS title,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'f' || CAST(o_custkey % 200 AS STRING) END AS fingerprint
FROM {{orders}}""",
    "videos": """SELECT user_id % 20 AS job_id, user_id % 40 AS page_id, event_id AS seq,
  CASE WHEN event_id % 17 = 0 THEN 'blob:https://v.example.com/' || CAST(event_id AS STRING) ELSE
  'https://v' || CAST(user_id % 5 AS STRING) || '.example.com/media/' || CAST(event_id % 300 AS STRING) || CASE event_id % 5 WHEN 0 THEN '.m3u8' WHEN 1 THEN '.mp4' WHEN 2 THEN '.mpd' WHEN 3 THEN '.webm' ELSE '' END
  || '?token=' || CAST(event_id % 7 AS STRING) || '&Itag=' || CAST(event_id % 3 AS STRING) || '&clen=' || CAST(event_id * 10 AS STRING) || CASE WHEN event_id % 2 = 0 THEN '#t=5' ELSE '' END END AS video_url,
  CASE event_id % 11 WHEN 0 THEN 'hls' WHEN 1 THEN 'mp4' WHEN 2 THEN 'dash' WHEN 3 THEN 'webm' WHEN 4 THEN 'ts' WHEN 5 THEN 'mkv' ELSE 'unknown' END AS container,
  CASE event_type WHEN 'view' THEN 'video' WHEN 'click' THEN 'youtube' WHEN 'purchase' THEN 'hls-js' WHEN 'signup' THEN 'coub' ELSE 'sniff' END AS source_type,
  event_id % 11 IN (0, 2) AS is_manifest, event_id % 23 = 0 AS is_drm, event_id % 17 = 0 AS is_blob, event_id % 29 = 0 AS is_live,
  CASE WHEN event_id % 6 = 1 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS file_size,
  CASE WHEN event_id % 5 = 3 THEN NULL ELSE CAST(event_id % 5000 AS DOUBLE) END AS duration_sec,
  CAST(CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_id % 1920 END AS INT) AS width, CAST(CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_id % 1080 END AS INT) AS height,
  CASE WHEN event_id % 4 = 2 THEN NULL ELSE event_id % 6000 END AS bitrate_kbps, event_id % 700 AS segment_count,
  CASE event_id % 12 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 ELSE 200 END AS http_status
FROM {events}""",
    "requests": """SELECT user_id AS tab_id, event_id AS seq, ts,
  CASE event_id % 6 WHEN 0 THEN 'https://r' || CAST(user_id % 4 AS STRING) || '.googlevideo.com/videoplayback?id=v' || CAST(user_id % 9 AS STRING) || '&itag=' || CAST(CASE event_id % 5 WHEN 0 THEN 18 WHEN 1 THEN 22 WHEN 2 THEN 140 WHEN 3 THEN 325 ELSE 999 END AS STRING) || '&range=0-' || CAST(event_id AS STRING) || '&mime=audio%2Fwebm'
  WHEN 1 THEN 'https://cdn.example.com/v/' || CAST(event_id % 50 AS STRING) || '.mp4' WHEN 2 THEN 'https://cdn.example.com/hls/' || CAST(event_id % 40 AS STRING) || '.m3u8?x=1'
  WHEN 3 THEN 'https://www.youtube.com/s/search/audio/open.mp3' WHEN 4 THEN 'https://cdn.example.com/page/' || CAST(event_id % 30 AS STRING) || '.html' ELSE 'https://s' || CAST(event_id % 3 AS STRING) || '.example.com/seg/' || CAST(event_id % 60 AS STRING) || '.ts' END AS url,
  CASE WHEN event_id % 7 = 0 THEN 'media' ELSE 'xhr' END AS type, CAST(floor(value * 1000) AS BIGINT) AS transfer_size,
  CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN NULL ELSE 200 END AS status
FROM {events}""",
    "tasks": """SELECT o_custkey % 20 AS job_id, o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'scan' WHEN 1 THEN 'metadata' WHEN 2 THEN 'download' ELSE 'discovery' END AS type,
  1000 - 300 * (o_orderkey % 3) AS priority, o_orderkey % 3 AS depth, o_orderkey % 1000 AS created_at,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5000 END AS retry_at, CAST(o_orderkey % 4 AS INT) AS retry_count, o_orderkey % 5 <> 0 AS retryable, o_orderkey % 100000 AS failed_at,
  CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' WHEN 4 THEN 'running' ELSE 'skipped' END AS status
FROM {orders}""",
    "logs": """SELECT user_id % 20 AS job_id, event_id AS seq, ts, CASE event_id % 5 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warn' WHEN 3 THEN 'error' ELSE 'info' END AS level,
  'cat' || CAST(event_id % 11 AS STRING) AS category, 'Event ' || event_type || ' of ' || CAST(user_id AS STRING) AS message, CASE WHEN event_id % 3 = 0 THEN 'ref' || CAST(event_id % 100 AS STRING) END AS ref
FROM {events}""",
    "patches": """SELECT user_id AS id, ts, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN event_id % 2000 END AS width, CASE WHEN event_id % 4 = 1 THEN event_type END AS status, CASE WHEN event_id % 5 = 2 THEN 'm' || CAST(event_id AS STRING) END AS message
FROM {events}""",
    "responses": f"""SELECT {_IMAGE_URL} AS url, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'HEAD' ELSE 'GET' END AS method,
  CAST(CASE o_orderkey % 10 WHEN 0 THEN 206 WHEN 1 THEN 301 WHEN 2 THEN 401 WHEN 3 THEN 403 WHEN 4 THEN 404 WHEN 5 THEN 429 WHEN 6 THEN 500 WHEN 7 THEN 503 WHEN 8 THEN NULL ELSE 200 END AS INT) AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Image/PNG; charset=x' WHEN 1 THEN 'image/jpeg' ELSE 'text/html' END END AS content_type,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey * 3 AS STRING) END AS content_length,
  CASE WHEN o_orderkey % 6 = 0 THEN 'bytes 0-100/' || CAST(o_orderkey * 7 AS STRING) END AS content_range,
  CASE WHEN o_orderkey % 7 = 0 THEN 'attachment; filename="a b' || CAST(o_orderkey % 30 AS STRING) || '.jpg"' WHEN o_orderkey % 7 = 1 THEN 'inline; filename*=UTF-8''''%D1%84.png' END AS content_disposition, CAST(NULL AS STRING) AS final_url
FROM {{orders}}""",
    "heads": """SELECT p_partkey AS id, p_size + 10 AS width, p_partkey % 1000 + 1 AS height,
  CASE p_partkey % 3 WHEN 0 THEN '89504E470D0A1A0A0000000D49484452' || lpad(hex(CAST(p_size + 10 AS BIGINT)), 8, '0') || lpad(hex(CAST(p_partkey % 1000 + 1 AS BIGINT)), 8, '0') || '0806000000'
  WHEN 1 THEN '474946383961' || substr(lpad(hex(CAST(p_size + 10 AS BIGINT)), 4, '0'), 3, 2) || substr(lpad(hex(CAST(p_size + 10 AS BIGINT)), 4, '0'), 1, 2) || substr(lpad(hex(CAST(p_partkey % 1000 + 1 AS BIGINT)), 4, '0'), 3, 2) || substr(lpad(hex(CAST(p_partkey % 1000 + 1 AS BIGINT)), 4, '0'), 1, 2) || 'F70000'
  ELSE '1A45DFA3010203040506070809' END AS hex_body,
  CASE p_partkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' END AS mime
FROM {part}""",
    "hls_master": """SELECT 'https://m.example.com/' || CAST(o_orderkey AS STRING) || '/master.m3u8' AS url, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p,
  '#EXTM3U' || chr(10) || CASE WHEN o_orderkey % 4 = 0 THEN '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",DEFAULT=YES,URI="audio.m3u8"' || chr(10) ELSE '' END
  || '#EXT-X-STREAM-INF:BANDWIDTH=' || CAST(CAST(floor(o_totalprice) AS BIGINT) + 1000 AS STRING) || ',RESOLUTION=640x360,CODECS="avc1,mp4a"' || CASE WHEN o_orderkey % 4 = 0 THEN ',AUDIO="a"' ELSE '' END || chr(10) || 'low.m3u8' || chr(10)
  || '#EXT-X-STREAM-INF:BANDWIDTH=' || CAST(CAST(floor(o_totalprice) AS BIGINT) * 2 + 1000 AS STRING) || ',RESOLUTION=1280x720' || chr(10) || 'https://x.example.com/' || CAST(o_orderkey AS STRING) || '/hi.m3u8' || chr(10)
  || '#EXT-X-STREAM-INF:BANDWIDTH=' || CAST(CAST(floor(o_totalprice) AS BIGINT) + 500 AS STRING) || chr(10) || '#EXT-X-OTHER' || chr(10) || '/abs.m3u8' || chr(10) AS body
FROM {orders}""",
    "media_pages": """SELECT o_orderkey AS page_id, 'https://site' || CAST(o_custkey % 13 AS STRING) || '.example.com/d/' || CAST(o_orderkey AS STRING) || '.html' AS url,
  replace('<html><head><meta property="og:image" content="/og/KEY.jpg"><link rel="x image_src" href="/ls/KEY.png"></head><body><img src="/i/KEY.jpg" alt="Alt ' || CAST(o_orderkey % 40 AS STRING) || '"><img srcset="/s/KEY-1.jpg 400w, /s/KEY-2.jpg 800w" src="/s/KEY-0.jpg" title="T">'
  || '<img data-src="/z/KEY.webp"><picture><source srcset="/p/KEY.avif"></picture><a href="/a/KEY.bmp">x</a><a href="/a/KEY.html">y</a><input type="IMAGE" src="/n/KEY.ico"><div style="background:url(/b/KEY.tiff)"></div><img src="/img/thumb_KEY.jpg"><p>/media/r/KEY.jpg</p>'
  || '<video src="/v/KEY.mp4" poster="/o/KEY.jpg" title="V KEY"><source src="/v/KEY.m3u8" type="application/x-mpegurl"></video><div style="background-image:url(/w/KEY.webm)"></div><iframe src="/d/KEY.html"></iframe></body></html>', 'KEY', CAST(o_orderkey AS STRING)) AS html
FROM {orders}""",
    "site_pages": """SELECT o_orderkey AS page_id, CASE o_orderkey % 5 WHEN 0 THEN 'https://m.vk.com/v' WHEN 1 THEN 'https://www.netflix.com/w' WHEN 2 THEN 'https://www.youtube.com/watch' WHEN 3 THEN 'https://x.com/s' ELSE 'https://book.ru/b' END AS url,
  replace(CASE o_orderkey % 5 WHEN 0 THEN '<script>var p = {{"hls":"https:' || chr(92) || '/' || chr(92) || '/cdn.example.com' || chr(92) || '/KEY.m3u8","url720":"https://cdn.example.com/KEY.mp4?a=1' || chr(92) || 'u0026b=2"}}</script>'
  WHEN 2 THEN '<script>var ytInitialPlayerResponse = {{"a":"}}","streamingData":{{"hlsManifestUrl":"https://y.example.com/KEY.m3u8","formats":[{{"url":"https://y.example.com/KEY?itag=18","mimeType":"video/mp4","height":360}}],"adaptiveFormats":[{{"mimeType":"video/webm","height":720,"signatureCipher":"s"}}]' || CASE WHEN o_orderkey % 3 = 0 THEN ',"licenseInfos":["w"]' ELSE '' END || '}}}};</script>'
  ELSE '<script>x = {{"url": "https://video.twimg.com/KEY.mp4", "hlsManifestUrl": "https://cdn.example.com/no.m3u8"}}</script>' END, 'KEY', CAST(o_orderkey AS STRING)) AS html
FROM {orders}""",
    "dash": """SELECT 'https://d.example.com/' || CAST(p_partkey AS STRING) || '/m.mpd' AS url, p_partkey AS k, p_size AS n,
  '<?xml version="1.0"?><MPD type="' || CASE WHEN p_partkey % 5 = 0 THEN 'dynamic' ELSE 'static' END || '" mediaPresentationDuration="PT' || CAST(p_size AS STRING) || 'M3S"><Period><AdaptationSet mimeType="video/mp4">'
  || CASE WHEN p_partkey % 7 = 0 THEN '<ContentProtection schemeIdUri="urn:uuid:edef8ba9-79d6"/>' ELSE '' END
  || '<SegmentTemplate initialization="$RepresentationID$/init.mp4" media="$RepresentationID$/c_$Number%04d$.m4s" timescale="10" duration="300" startNumber="3"/><Representation id="v' || CAST(p_partkey % 3 AS STRING) || '" bandwidth="' || CAST(p_partkey * 10 AS STRING) || '" width="640" height="360"/></AdaptationSet></Period></MPD>' AS body
FROM {part}""",
}
SPREAD = {"hls_master", "dash", "media_pages"}
TABLES = ["orders", "events", "part", "lineitem", "pages", "customer"]


def dealt_out(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    if name in SPREAD:  # a small file, each row of which becomes a text: dealt out before it grows
        used = {t: dealt_out(df) for t, df in used.items()}
    return spark.sql(text, **used)


def view_sql(name: str) -> str:
    return VIEWS[name].format(**{t: t for t in TABLES})


def hls_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, body of one media playlist per order: a segment per line item, with keys, ranges and an init map by moduli."""
    from pyspark.sql import functions as F

    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_linenumber")
    one = F.concat_ws(
        "\n",
        F.when(n == 2, F.concat(F.lit('#EXT-X-KEY:METHOD=AES-128,URI="https://k.example.com/'), (F.col("l_partkey") % 5).cast("string"), F.lit('",IV=0xAB'))),
        F.when((n == 5) & (F.col("l_orderkey") % 3 == 0), "#EXT-X-KEY:METHOD=NONE"),
        F.concat(F.lit("#EXTINF:"), F.col("l_quantity").cast("int").cast("string"), F.lit(",")),
        F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("#EXT-X-BYTERANGE:"), (F.col("l_partkey") % 90 + 10).cast("string"), F.when(n % 3 == 1, "@1000").otherwise(""))),
        F.concat(F.lit("https://s.example.com/seg_"), F.col("l_partkey").cast("string"), F.lit(".ts")),
    )
    lines = items.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", one.alias("text")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "\n")
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-TARGETDURATION:9\n#EXT-X-MEDIA-SEQUENCE:"), (F.col("l_orderkey") % 50).cast("string"), F.lit("\n"), F.when(F.col("l_orderkey") % 5 == 0, '#EXT-X-MAP:URI="https://s.example.com/init.mp4"\n').otherwise(""))
    end = F.when(F.col("l_orderkey") % 2 == 0, "\n#EXT-X-ENDLIST").otherwise("")
    return lines.groupBy("l_orderkey").agg(body.alias("b")).select(F.concat(F.lit("https://m.example.com/"), F.col("l_orderkey").cast("string"), F.lit(".m3u8")).alias("url"), F.concat(head, "b", end).alias("body"))
