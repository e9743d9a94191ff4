"""Input tables: pages, recorded responses, manifests, media heads; snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.sources import heads

MAX_PAGE, HEAD = 8 << 20, heads.HEAD


def read_pages(spark: SparkSession, path: str, max_body: int | None = None) -> DataFrame:
    """Parquet of pages; with max_body (MAX_PAGE for the usual cap), html is cut there."""
    pages = spark.read.parquet(path)
    return pages if max_body is None else pages.withColumn("html", F.left("html", F.lit(max_body)))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Parquet of responses; header names in lower case (of names that differ in case only, the last)."""
    df = spark.read.parquet(path)
    entries = F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    once = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))
    return df.withColumn("headers", once)


def read_manifests(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """url (the file), body: one row per text file. path: files or folders, with wildcards or not; of folders all files below, or
    those with a name like `name`. A folder's subfolders are listed by tasks, those of a wildcard one by one by the driver."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("body"))


def read_media_heads(spark: SparkSession, path: str, n: int = HEAD, offset: int = 0) -> DataFrame:
    """url (the file), size, body: n bytes of each file, from an offset on; no more is read of it."""
    spark.dataSource.register(heads.MediaHeads)
    return spark.read.format("media_heads").option("n", n).option("offset", offset).load(path)


def restore_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a snapshot: candidates unselected, their status kept only if downloaded or failed, else ready; seen keys
    and fingerprints rebuilt from them."""
    c = spark.read.parquet(f"{path}/candidates")
    status = F.when(F.col("status").isin("downloaded", "failed"), F.col("status")).otherwise("ready")
    c = c.withColumns({"selected": F.lit(False), "status": status})
    url = "image_url" if "image_url" in c.columns else "video_url"
    key = urls.image_variant_key(F.col(url)) if url == "image_url" else urls.video_variant_key(F.col(url))
    out = {"candidates": c, "seen_keys": c.select("job_id", key.alias("variant_key")).distinct()}
    if "fingerprint" in c.columns:
        out["seen_fingerprints"] = c.where("fingerprint is not null").select("job_id", "fingerprint").distinct()
    return out
