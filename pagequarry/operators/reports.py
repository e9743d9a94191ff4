"""Summaries, counts, tails and history of jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.operators.dedup import top_by

TASK_STATUSES = ["pending", "running", "done", "failed", "retry", "skipped"]
LEVELS = {"debug": 0, "info": 1, "warn": 2, "error": 3}


def _map_of(pairs: Column) -> Column:
    return F.map_from_entries(F.array_sort(pairs))


def scan_summary(cands: DataFrame) -> DataFrame:
    """One row per job: candidates, by_source and by_container (maps), drm, manifests, blobs. Counted per (job, source,
    container) first, so the maps are made of few rows."""
    flag = lambda n: F.count_if(F.coalesce(F.col(n), F.lit(False))).alias(n)
    small = cands.groupBy("job_id", "source_type", "container").agg(F.count("*").alias("n"), flag("is_drm"), flag("is_manifest"), flag("is_blob"))
    totals = small.groupBy("job_id").agg(F.sum("n").alias("candidates"), F.sum("is_drm").alias("drm"), F.sum("is_manifest").alias("manifests"), F.sum("is_blob").alias("blobs"))
    maps = [small.groupBy("job_id", c).agg(F.sum("n").alias("n")).groupBy("job_id").agg(_map_of(F.collect_list(F.struct(F.coalesce(c, F.lit("unknown")), "n"))).alias(f"by_{name}")) for c, name in (("source_type", "source"), ("container", "container"))]
    return reduce(lambda a, b: a.join(b, "job_id"), maps, totals)


def counts_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def task_counts(tasks: DataFrame) -> DataFrame:
    """One row per job: tasks in all and by status."""
    return tasks.groupBy("job_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in TASK_STATUSES])


def job_stats(jobs: DataFrame, pages: DataFrame, cands: DataFrame, errors: DataFrame) -> DataFrame:
    """Per job: pages, images, downloaded, bytes (actual size, else the planned one) and errors; jobs without rows have 0."""
    p = pages.groupBy("job_id").agg(F.count("*").alias("pages"))
    done = F.col("status") == "downloaded"
    c = cands.groupBy("job_id").agg(F.count("*").alias("images"), F.count_if(done).alias("downloaded"), F.sum(F.when(done, F.coalesce("bytes_downloaded", "file_size", F.lit(0))).otherwise(0)).alias("bytes"))
    e = errors.groupBy("job_id").agg(F.count("*").alias("errors"))
    out = reduce(lambda a, b: a.join(b, "job_id", "left"), [p, c, e], jobs.select("job_id").distinct())
    return out.fillna(0, ["pages", "images", "downloaded", "bytes", "errors"])


def download_summary(cands: DataFrame) -> DataFrame:
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    volume = F.coalesce(F.sum(F.when(F.col("status") == "downloaded", F.col("file_size"))), F.lit(0)).cast("long")
    return cands.groupBy("job_id").agg(is_("downloading").alias("active"), is_("queued").alias("queued"), is_("downloaded").alias("done"), is_("failed").alias("failed"), is_("skipped").alias("skipped"), volume.alias("volume"))


def progress(tasks: DataFrame, min_delay: float, max_delay: float, concurrency: int) -> DataFrame:
    """Per job: percent done (at most 100) and eta_ms = queued * mean delay / concurrency, rounded."""
    done, queued = F.count_if(F.col("status").isin("done", "failed", "skipped")), F.count_if(F.col("status").isin("pending", "retry"))
    percent = F.least(F.floor(F.try_divide(done * 100.0, F.count("*")) + 0.5), F.lit(100)).cast("int")
    eta = F.floor(queued * ((min_delay + max_delay) / 2) / max(1, concurrency) + 0.5).cast("long")
    return tasks.groupBy("job_id").agg(percent.alias("percent"), eta.alias("eta_ms"))


def history_append(history: DataFrame, jobs: DataFrame, n: int = 50) -> DataFrame:
    """The newest n jobs of both by started_at; a job that comes again replaces its old entry."""
    both = history.withColumn("_new", F.lit(0)).unionByName(jobs.withColumn("_new", F.lit(1)))
    one = both.groupBy("job_id").agg(F.max_by(F.struct(*both.columns), "_new").alias("r")).select("r.*").drop("_new")
    return one.orderBy(F.desc("started_at"), "job_id").limit(n)


def history_search(history: DataFrame, text: str) -> DataFrame:
    return history.where(F.contains(F.lower("root_url"), F.lit(text.strip().lower())))


def error_tail(errors: DataFrame, n: int = 500) -> DataFrame:
    return top_by(errors, ["job_id"], [F.desc("ts"), F.desc("seq")], n)


def level_rank(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p]), c)


def filter_logs(logs: DataFrame, level: str = "debug", categories: list[str] | None = None, q: str = "") -> DataFrame:
    """Rows of at least the level, in the categories if there are any, with q in message or ref."""
    out = logs.where(level_rank(F.col("level")) >= LEVELS[level])
    if categories:
        out = out.where(F.col("category").isin(categories))
    text = q.strip().lower()
    if text:
        out = out.where(F.contains(F.lower("message"), F.lit(text)) | F.coalesce(F.contains(F.lower("ref"), F.lit(text)), F.lit(False)))
    return out


def log_tail(a: DataFrame, b: DataFrame, n: int = 200) -> DataFrame:
    """The newest n rows per job of two logs."""
    return top_by(a.unionByName(b), ["job_id"], [F.desc("ts"), F.desc("seq")], n)


def format_log(logs: DataFrame) -> DataFrame:
    """One text line per row: [ISO time] [LEVEL] [category] message."""
    ms = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return logs.select(F.format_string("[%s] [%s] [%s] %s", ms, F.upper("level"), "category", "message").alias("value"))


def outgoing_hosts(links: DataFrame) -> DataFrame:
    return links.groupBy(urls.hostname_of(F.col("link")).alias("host")).agg(F.count("*").alias("n"))
