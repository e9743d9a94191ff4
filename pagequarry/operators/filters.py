"""Filters with three-valued logic, sorting, selection and facets of image and video candidates.

A predicate whose input is unknown does not pass, under AND as under OR; without predicates all rows pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import urls

TINY, PIXEL = 16, 2
UI_SOUND = r"(?i)youtube\.com/s/search/audio/|failure\.mp3|no_input\.mp3|open\.mp3|success\.mp3"
AD_URL = r"ads?\.|doubleclick|googlesyndication|adservice|adnxs|adsrv|tribalfusion|outbrain"
# Hosts whose videos are protected.
HEAVY_DRM = ["netflix.com", "disneyplus.com", "hulu.com", "primevideo.com", "hbomax.com", "max.com", "paramountplus.com", "appletv.com", "peacocktv.com", "crunchyroll.com"]


@dataclass(frozen=True)
class ImageFilter:
    min_width: int = 0
    min_height: int = 0
    min_size_kb: float = 0
    min_aspect: float = 0
    max_aspect: float = 0
    include_formats: tuple[str, ...] = ()
    exclude_formats: tuple[str, ...] = ()
    exclude_svg: bool = False
    exclude_tiny: bool = False
    exclude_pixels: bool = False
    mode: str = "AND"


@dataclass(frozen=True)
class VideoFilter:
    min_width: int = 0
    min_height: int = 0
    min_duration: float = 0
    max_duration: float = 0
    min_bitrate: float = 0
    min_size_mb: float = 0
    include_containers: tuple[str, ...] = ()
    exclude_containers: tuple[str, ...] = ()
    exclude_manifests: bool = False
    exclude_drm: bool = False
    exclude_blobs: bool = False
    exclude_iframes: bool = False
    exclude_ads: bool = False
    mode: str = field(default="AND")


def combine(conditions: list[Column], mode: str = "AND") -> Column:
    if not conditions:
        return F.lit(True)
    known = [F.coalesce(c, F.lit(False)) for c in conditions]
    return reduce((lambda a, b: a & b) if mode == "AND" else (lambda a, b: a | b), known)


def image_filter(f: ImageFilter) -> Column:
    """For columns width, height, file_size, aspect_ratio, extension, mime_type."""
    w, h, ext = F.col("width"), F.col("height"), F.coalesce("extension", F.lit(""))
    within = lambda n: (w <= n) & (h <= n)
    both = w.isNotNull() & h.isNotNull()
    options = [
        (f.min_width > 0, w >= f.min_width),
        (f.min_height > 0, h >= f.min_height),
        (f.min_size_kb > 0, F.col("file_size") >= f.min_size_kb * 1024),
        (f.min_aspect > 0, F.col("aspect_ratio") >= f.min_aspect),
        (f.max_aspect > 0, F.col("aspect_ratio") <= f.max_aspect),
        (bool(f.include_formats), ext.isin(list(f.include_formats))),
        (bool(f.exclude_formats), ~ext.isin(list(f.exclude_formats))),
        (f.exclude_svg, (ext != "svg") & ~F.coalesce("mime_type", F.lit("")).contains("svg")),
        (f.exclude_tiny, both & ~within(TINY)),
        (f.exclude_pixels, both & ~within(PIXEL)),
    ]
    return combine([c for on, c in options if on], f.mode)


def looks_like_ad(url: Column) -> Column:
    low = F.lower(url)
    return low.rlike(AD_URL) | low.rlike(UI_SOUND) | F.regexp_replace(urls.hostname_of(low), r"^www\.", "").isin(HEAVY_DRM)


def not_dead() -> Column:
    """Neither an empty stub of unknown format nor a sound of the user interface; for the columns of a video."""
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    stub = (F.col("container") == "unknown") & (F.coalesce("file_size", F.lit(0)) == 0) & ~flag("is_manifest") & ~flag("is_blob") & ~flag("is_live")
    return ~stub & ~F.col("video_url").rlike(UI_SOUND)


def video_filter(f: VideoFilter) -> Column:
    """For columns video_url, container, width, height, duration_sec, bitrate_kbps, file_size, source_type and the flags."""
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    options = [
        (f.min_width > 0, F.col("width") >= f.min_width),
        (f.min_height > 0, F.col("height") >= f.min_height),
        (f.min_duration > 0, F.col("duration_sec") >= f.min_duration),
        (f.max_duration > 0, F.col("duration_sec") <= f.max_duration),
        (f.min_bitrate > 0, F.col("bitrate_kbps") >= f.min_bitrate),
        (f.min_size_mb > 0, F.col("file_size") >= f.min_size_mb * 1048576),
        (bool(f.include_containers), F.col("container").isin(list(f.include_containers))),
        (bool(f.exclude_containers), ~F.col("container").isin(list(f.exclude_containers))),
        (f.exclude_manifests, ~flag("is_manifest")),
        (f.exclude_drm, ~flag("is_drm")),
        (f.exclude_blobs, ~flag("is_blob")),
        (f.exclude_iframes, F.coalesce("source_type", F.lit("")) != "iframe-player"),
        (f.exclude_ads, ~looks_like_ad(F.col("video_url"))),
    ]
    return not_dead() & combine([c for on, c in options if on], f.mode)


def _sort_key(key: str, df: DataFrame) -> Column:
    url = F.col("image_url" if "image_url" in df.columns else "video_url")
    if key == "resolution":
        return F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))
    if key == "name":
        first = [F.nullif(F.col(c), F.lit("")) for c in ("title", "alt") if c in df.columns]
        return F.collate(F.lower(F.coalesce(*first, urls.url_basename(url))), "ru")
    if key in ("url", "page"):
        return url if key == "url" else F.col("source_page_url")
    return F.coalesce(F.col({"fileSize": "file_size", "duration": "duration_sec", "bitrate": "bitrate_kbps"}.get(key, key)), F.lit(-1))


def sort_candidates(df: DataFrame, key: str, direction: str = "desc") -> DataFrame:
    """Sorted by key, missing numbers as -1 (resolution: 0), names without case in Russian order; ties in order of seq."""
    if key == "selected":
        return df.orderBy(F.coalesce("selected", F.lit(False)).desc(), "seq")
    by = _sort_key(key, df)
    return df.orderBy(by.desc() if direction == "desc" else by.asc(), "seq")


def visible(df: DataFrame, condition: Column, key: str, direction: str = "desc") -> DataFrame:
    """Filtered and sorted; blob rows last."""
    kept = df.where(condition)
    by = _sort_key(key, df)
    blob = [F.coalesce("is_blob", F.lit(False))] if "is_blob" in df.columns else []
    return kept.orderBy(*blob, by.desc() if direction == "desc" else by.asc(), "seq")


def page_of(df: DataFrame, offset: int, n: int) -> DataFrame:
    return df.offset(offset).limit(n)


def search(df: DataFrame, q: str, columns: tuple[str, ...] = ("title", "video_url", "source_domain", "source_type", "container")) -> DataFrame:
    text = q.strip().lower()
    found = [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text)), F.lit(False)) for c in columns if c in df.columns]
    return df.where(reduce(lambda a, b: a | b, found)) if text else df


def select_where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.withColumn("selected", F.coalesce(predicate, F.lit(False)))


def selection_changes(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows whose selection changes, with the new value."""
    new = F.coalesce(predicate, F.lit(False))
    return df.where(~new.eqNullSafe(F.col("selected"))).withColumn("selected", new)


def match_counts(df: DataFrame, condition: Column, by: str = "job_id") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("found"), F.count_if(condition).alias("matched"), F.count_if(F.coalesce("selected", F.lit(False))).alias("selected"))


def facets(df: DataFrame, domains: int = 100, by: str = "job_id") -> DataFrame:
    """facet, value, place: the first `domains` source domains in order of appearance, extensions and depths in their order."""
    seen = df.groupBy(by, F.col("source_domain").alias("value")).agg(F.min("seq").alias("first"))
    first = seen.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("first"))).where(F.col("place") <= domains)
    out = first.select(by, F.lit("domain").alias("facet"), "value", "place")
    for facet, col in (("extension", "extension"), ("depth", "depth")):
        some = df.where(F.col(col).isNotNull()).select(by, F.col(col).alias("v")).distinct()
        ranked = some.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("v")))
        out = out.unionByName(ranked.select(by, F.lit(facet).alias("facet"), F.col("v").cast("string").alias("value"), "place"))
    return out


def media_class(duration: Column, segments: Column, size: Column, live: Column) -> Column:
    long_ = (F.coalesce(duration, F.lit(0)) >= 1800) | (F.coalesce(segments, F.lit(0)) >= 400)
    sticker = (duration > 0) & (duration <= 15) & (size > 0) & (size < 1_500_000)
    return F.when(F.coalesce(live, F.lit(False)), "live").when(long_, "broadcast").when(F.coalesce(sticker, F.lit(False)), "sticker").otherwise("video")
