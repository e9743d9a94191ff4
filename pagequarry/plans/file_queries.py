"""Registered queries over files that Spark writes from the driver tables and reads back: readers, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.tables import new_path
from pagequarry.operators import manifests
from pagequarry.plans.catalog import _register
from pagequarry.plans.fixtures import view
from pagequarry.sources import readers
from pagequarry.streaming import jobs

GROUPS = 20


@_register("recorded_responses", "SELECT seq, method, status, content_type, CAST(content_length AS BIGINT) AS content_length, content_disposition FROM responses", "responses")
def _(spark, d):
    path, r = new_path(spark), view(spark, d, "responses")
    header = lambda name: F.when(F.col("seq") % 2 == 0, F.lit(name.upper())).otherwise(F.lit(name))
    headers = F.create_map(*[x for name in ("content-type", "content-length", "content-disposition") for x in (header(name), F.col(name.replace("-", "_")))])
    r.select("seq", "url", "method", "status", headers.alias("headers")).write.parquet(path)
    h = F.col("headers")
    told = readers.read_responses(spark, path)
    return told.select("seq", "method", "status", h["content-type"].alias("content_type"), h["content-length"].cast("long").alias("content_length"), h["content-disposition"].alias("content_disposition"))


@_register("manifest_files", "SELECT s_suppkey AS k, n AS variant_no, CASE n WHEN 0 THEN 1000 + s_suppkey ELSE 9000 END AS bandwidth, CASE n WHEN 0 THEN '720p.m3u8' ELSE 'v' || s_suppkey || '.m3u8' END AS name FROM supplier, (SELECT unnest([0, 1]) AS n)")
def _(spark, d):
    k = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH="), (F.col("s_suppkey") + 1000).cast("string"), F.lit("\n720p.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=9000\nv"), k, F.lit(".m3u8"))
    path = new_path(spark)
    # A file for each row: dealt out by key, so that all tasks write, and moved into place by them, not one by one by the driver.
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("k"), body.alias("value"))
    spread = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    spread.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("k").text(path)
    found = manifests.parse_hls_master(readers.read_manifests(spark, path, "*.txt"))
    key = F.regexp_extract("url", "/k=([0-9]+)/", 1).cast("long")
    return found.select(key.alias("k"), F.col("variant_no").cast("long").alias("variant_no"), "bandwidth", F.regexp_extract("variant_url", "([^/]*)$", 1).alias("name"))


@_register("media_head_files", f"WITH t AS (SELECT p_partkey % {GROUPS} AS g, string_agg(lpad(CAST(p_partkey AS VARCHAR), 9, '0') || chr(10), '' ORDER BY p_partkey) AS body FROM part GROUP BY 1) SELECT g, CAST(length(body) AS BIGINT) AS size, substr(body, 6, 64) AS head FROM t")
def _(spark, d):
    path = new_path(spark)
    parts = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % GROUPS).alias("g"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("value"))
    parts.repartition("g").sortWithinPartitions("g", "value").write.partitionBy("g").text(path)
    heads = readers.read_media_heads(spark, f"{path}/*/*.txt", 64, 5)
    return heads.select(F.regexp_extract("url", "/g=([0-9]+)/", 1).cast("long").alias("g"), "size", F.decode("body", "UTF-8").alias("head"))


def _arriving(spark: SparkSession, df: DataFrame, order: str, files: int = 3) -> tuple[DataFrame, str]:
    """df as a stream of a few files, in order, one to a micro-batch; and a folder for checkpoints."""
    path = new_path(spark, "arriving")
    bounds = df.approxQuantile(order, [k / files for k in range(1, files)], 0.05)
    part = sum((F.col(order) > b).cast("int") for b in bounds) if bounds else F.lit(0)
    for k in range(files):
        df.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), new_path(spark, "checkpoint")


_MEDIA = "NOT contains(url, 'open.mp3') AND NOT contains(url, 'itag=325') AND (type = 'media' OR contains(url, 'videoplayback') OR regexp_matches(url, '\\.(mp4|m3u8|ts)(\\?|$)'))"


@_register("streamed_candidates", f"SELECT DISTINCT tab_id, CASE WHEN contains(url, 'videoplayback') THEN 'yt-' || regexp_extract(url, '[?&]id=([^&]*)', 1) || '-' || regexp_extract(url, '[?&]itag=([^&]*)', 1) ELSE url END AS storage_key FROM requests WHERE {_MEDIA}", "requests")
def _(spark, d):
    stream, checkpoint = _arriving(spark, view(spark, d, "requests"), "seq")
    path = new_path(spark)
    jobs.run_to_end(jobs.stream_candidates(stream, "3650 days").select("tab_id", "storage_key"), path, checkpoint)
    return spark.read.parquet(path)


@_register("streamed_logs", "SELECT seq, level, category, message FROM logs WHERE level <> 'debug' AND category <> 'cat3'", "logs")
def _(spark, d):
    stream, checkpoint = _arriving(spark, view(spark, d, "logs"), "seq")
    path = new_path(spark)
    jobs.append_logs(jobs.stream_logs(stream, "info", [f"cat{k}" for k in range(11) if k != 3]), path, checkpoint)
    return spark.read.parquet(path).select("seq", "level", "category", "message")


@_register("streamed_patches", "SELECT id, coalesce(arg_max(width, ts) FILTER (WHERE width IS NOT NULL), id) AS width, coalesce(arg_max(status, ts) FILTER (WHERE status IS NOT NULL), 'new') AS status, count(*) AS patches FROM patches WHERE id % 3 <> 1 GROUP BY 1", "patches")
def _(spark, d):
    patches = view(spark, d, "patches").select("id", "ts", "seq", "width", "status")
    known = patches.where("id % 3 <> 1").select("id").distinct().select("id", F.col("id").alias("width"), F.lit("new").alias("status"))
    stream, checkpoint = _arriving(spark, patches, "seq")
    path = new_path(spark)
    jobs.run_to_end(jobs.upsert_stream(stream, known), path, checkpoint)
    told = spark.read.parquet(path)
    return told.groupBy("id").agg(*[F.max_by(c, "patches").alias(c) for c in ("width", "status", "patches")])
