"""Media candidates from request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.operators.dedup import first_by, last_by, top_by
from pagequarry.operators.filters import UI_SOUND

MEDIA = ["mp4", "webm", "ogv", "mov", "m4v", "mkv", "ts", "m3u8", "mpd", "flv", "avi"]
# Stream numbers, their label, whether they are sound only.
ITAGS = {18: ("360p", False), 22: ("720p", False), 137: ("1080p", False), 248: ("1080p", False), 399: ("1080p", False), 136: ("720p", False), 247: ("720p", False), 398: ("720p", False), 135: ("480p", False), 244: ("480p", False), 397: ("480p", False), 134: ("360p", False), 243: ("360p", False), 396: ("360p", False), 133: ("240p", False), 242: ("240p", False), 395: ("240p", False), 140: ("M4A 128k", True), 251: ("Opus 160k", True), 250: ("Opus 70k", True), 249: ("Opus 50k", True)}
ITAGS |= {n: ("1440p+", False) for n in range(256, 273)}


def filter_resource_log(requests: DataFrame) -> DataFrame:
    """Media of a page's resource timings: one row per page and full URL, the first; media files under 50,000 bytes go."""
    u = F.col("url")
    ext = urls.extension_from_url(u)
    playback = u.rlike(r"(?i)googlevideo\.com/(videoplayback|api/manifest)")
    manifest = u.rlike(r"(?i)/api/manifest/(hls_playlist|dash)/")
    small = ~ext.isin("m3u8", "mpd") & (F.coalesce("transfer_size", F.lit(0)) > 0) & (F.col("transfer_size") < 50_000) & ~playback & ~manifest
    kept = requests.where(urls.is_http_url(u) & ext.isNotNull() & (ext.isin(MEDIA) | playback) & ~small)
    container = F.when((ext == "m3u8") | u.rlike("(?i)hls_playlist"), "hls").when((ext == "mpd") | u.rlike("(?i)api/manifest/dash"), "dash").when(ext.isin("webm", "ts", "mkv", "flv"), ext).otherwise("mp4")
    out = kept.select("tab_id", "seq", urls.normalize_playback_url(u).alias("video_url"), container.alias("container"), (ext.isin("m3u8", "mpd") | manifest).alias("is_manifest"))
    return first_by(out, ["tab_id", "video_url"], ["seq"])


def filter_network_log(requests: DataFrame) -> DataFrame:
    """Requests that may be media: by type, extension or known path; without sounds, storyboards and preview streams."""
    u = F.col("url")
    media = (F.coalesce("type", F.lit("")) == "media") | u.rlike(r"(?i)\.(mp4|webm|mkv|mov|m4v|ts|m3u8|mpd)(\?|$)") | u.rlike(r"(?i)videoplayback|/hls/|/live/|/stream/|\.mmcdn\.com")
    sound = u.rlike(UI_SOUND) | u.rlike("(?i)/ui_sound|/sound_effects?/")
    board = u.rlike(r"(?i)googlevideo\.com/videoplayback") & (u.rlike(r"(?i)[?&](sq=|sigh=)") | u.rlike(r"[?&]itag=(324|325|326|327|328|329)\b"))
    return requests.where(media & ~sound & ~board)


def itag_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in ITAGS.items()], "itag int, quality string, audio_only boolean")


def network_candidates(requests: DataFrame) -> DataFrame:
    """Candidates of filter_network_log(): clean URL, storage_key, quality label, audio_only, container.

    The table of stream numbers is constant and of 38 rows, so it is sent to the tasks.
    """
    u = F.col("url")
    yt = u.rlike(r"(?i)googlevideo\.com/videoplayback")
    clean = F.when(yt, urls.normalize_playback_url(u)).otherwise(u)
    itag = F.when(yt, urls.param(u, "itag"))
    key = F.when(yt, F.concat_ws("-", F.lit("yt"), F.coalesce(urls.param(u, "id"), F.lit("")), F.coalesce(itag, F.lit("0")))).otherwise(u)
    df = requests.withColumns({"video_url": clean, "storage_key": key, "itag": itag.try_cast("int")})
    df = df.join(F.broadcast(itag_table(requests.sparkSession)), "itag", "left")
    hls, dash = u.rlike(r"(?i)\.m3u8(\?|$)|/hls/"), u.rlike(r"(?i)\.mpd(\?|$)|/dash/")
    audio = F.coalesce("audio_only", F.lit(False))
    webm = u.rlike(r"(?i)\.webm(\?|$)") | (audio & F.contains("video_url", F.lit("mime=audio%2Fwebm")))
    return df.select("tab_id", "ts", "seq", "video_url", "storage_key", "quality", audio.alias("audio_only"), F.when(hls, "hls").when(dash, "dash").when(webm, "webm").otherwise("mp4").alias("container"), (hls | dash).alias("is_manifest"))


def latest_per_key(df: DataFrame) -> DataFrame:
    return last_by(df, ["tab_id", "storage_key"], ["ts", "seq"])


def redact_headers(headers: Column) -> Column:
    """Cookies and authorization hidden, the referer cut to its origin, other values to 120 characters."""
    return F.transform_values(
        F.transform_keys(headers, lambda k, v: F.lower(k)),
        lambda k, v: F.when(k.isin("cookie", "authorization"), "[hidden]").when(k == "referer", urls.origin_of(v)).otherwise(F.left(v, F.lit(120))),
    )


def sample_per_host(df: DataFrame, n: int = 10, url: str = "url") -> DataFrame:
    """The first n requests of each host."""
    return top_by(df.withColumn("host", urls.hostname_of(F.col(url))), ["host"], [F.col("seq")], n)


def bounded_findings(df: DataFrame, n: int = 500, key: str = "page_id") -> DataFrame:
    """The newest n distinct findings of each page."""
    once = first_by(df.withColumn("url", urls.without_fragment(F.col("url"))), [key, "url"], ["seq"])
    return top_by(once, [key], [F.desc("seq")], n)


def fresh_findings(after: DataFrame, before: DataFrame) -> DataFrame:
    bare = lambda df: df.withColumn("url", urls.without_fragment(F.col("url")))
    return bare(after).join(bare(before).select("page_id", "url").distinct(), ["page_id", "url"], "left_anti")
