"""First-wins and last-wins deduplication by explicit order keys.

Dedup by key first finds the smallest order key per group with a map-side combined aggregate and meets the rows again by it,
so that a key that most rows share neither fills one task's window nor travels with its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import urls

# How rich a source of a page's videos is; what isn't listed counts 0.
PRIORITY = {3: ["youtube", "instagram", "tiktok", "twitter", "facebook", "vk", "ok", "rutube", "vimeo", "bilibili", "reddit"], 2: ["hls-js", "dash-js", "jwplayer", "video-js", "shaka", "plyr", "clappr", "wistia", "brightcove", "kaltura", "vidyard", "mediael", "flowplayer", "iframe-player", "sniff"], 1: ["video", "source", "currentSrc"]}


def first_by(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The first row of each group by the order columns (which tell rows of a group apart)."""
    named = [F.col(k).alias(f"_k{i}") if isinstance(k, str) else k.alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[F.struct(*order).alias("o"), F.struct(*df.columns).alias("r")])
    best = df.select(*named, row.alias("x")).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("x.r", "x.o").alias("r"))
    return best.select("r.*")


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    best = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def dedup_pages(df: DataFrame, url: str = "url") -> DataFrame:
    return first_by(df, ["job_id", urls.canonical_url(F.col(url))], ["seq"])


def dedup_visited(df: DataFrame) -> DataFrame:
    """Pages by their final URL after redirects."""
    return first_by(df, ["job_id", urls.canonical_url(F.coalesce("final_url", "url"))], ["seq"])


def dedup_images(df: DataFrame, url: str = "image_url") -> DataFrame:
    return first_by(df, ["job_id", urls.image_variant_key(F.col(url))], ["seq"])


def dedup_by_fingerprint(meta: DataFrame) -> DataFrame:
    """All rows; of those with one fingerprint in a job, all but the first get status "skipped". Null ones are exempt."""
    first = meta.where(F.col("fingerprint").isNotNull()).groupBy("job_id", "fingerprint").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.coalesce(F.col("seq") > F.col("first"), F.lit(False))
    return meta.join(first, ["job_id", "fingerprint"], "left").withColumn("status", F.when(later, "skipped").otherwise(F.col("status"))).select(*meta.columns)


def source_priority(c: Column) -> Column:
    out = F.lit(0)
    for level, names in PRIORITY.items():
        out = F.when(c.isin(names), level).otherwise(out)
    return out


def dedup_videos_by_priority(df: DataFrame) -> DataFrame:
    """Per page and URL without fragment, the richest source, the first of equals; place is where the URL first came."""
    keyed = df.withColumn("_u", urls.without_fragment(F.col("video_url")))
    best = F.max_by(F.struct(*df.columns), F.struct(source_priority(F.col("source_type")), -F.col("seq")))
    return keyed.groupBy("page_id", "_u").agg(best.alias("r"), F.min("seq").alias("place")).select("r.*", "place")


def merge_sources(dom: DataFrame, net: DataFrame) -> DataFrame:
    """Rows of the page, then of the network, each URL once per job, the page's first."""
    both = dom.withColumn("_s", F.lit(0)).unionByName(net.withColumn("_s", F.lit(1)))
    return first_by(both, ["job_id", "video_url"], ["_s", "seq"]).drop("_s")


def add_video_candidates(known: DataFrame, raw: DataFrame) -> DataFrame:
    """New candidates: one per job and variant key, none whose key is known."""
    key = urls.video_variant_key(F.col("video_url"))
    have = known.select("job_id", key.alias("variant_key")).distinct()
    new = first_by(raw.withColumn("variant_key", key), ["job_id", "variant_key"], ["seq"])
    return new.join(have, ["job_id", "variant_key"], "left_anti").select(*raw.columns, "variant_key")


def build_image_candidates(hits: DataFrame) -> DataFrame:
    """Candidate records from hits (job_id, seq, image_url, source_page_url, depth, width, height, alt, title)."""
    key = urls.image_variant_key(F.col("image_url"))
    return hits.select(
        F.sha1(F.concat_ws("|", "job_id", key)).alias("id"),
        "job_id",
        "seq",
        "image_url",
        urls.canonical_url(F.col("image_url")).alias("canonical_url"),
        "source_page_url",
        urls.hostname_of(F.col("image_url")).alias("source_domain"),
        "depth",
        "width",
        "height",
        F.try_divide(F.nullif("width", F.lit(0)), F.nullif("height", F.lit(0))).alias("aspect_ratio"),
        urls.extension_from_url(F.col("image_url")).alias("extension"),
        "alt",
        "title",
        F.lit(False).alias("selected"),
        F.lit("discovered").alias("status"),
    )


def build_video_candidates(raw: DataFrame) -> DataFrame:
    """Candidate records from raw videos (job_id, seq, video_url, source_page_url, container, is_manifest, is_drm)."""
    url = F.col("video_url")
    return raw.select(
        F.sha1(F.concat_ws("|", "job_id", urls.video_variant_key(url))).alias("id"),
        "job_id",
        "seq",
        "video_url",
        urls.canonical_url(url).alias("canonical_url"),
        "source_page_url",
        urls.hostname_of(F.col("source_page_url")).alias("source_domain"),
        F.coalesce("container", F.lit("unknown")).alias("container"),
        F.coalesce("is_manifest", F.lit(False)).alias("is_manifest"),
        F.coalesce("is_drm", F.lit(False)).alias("is_drm"),
        urls.is_blob_url(url).alias("is_blob"),
        F.lit("discovered").alias("status"),
    )


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group. Spark limits each task's groups to n rows before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
