"""Download plans: routes, byte budgets, file names, folders, retries, queue order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import text, urls
from pagequarry.functions.arrays import fold_append
from pagequarry.functions.scans import scan_sorted
from pagequarry.functions.tables import blocks_in_order, keep
from pagequarry.operators.dedup import top_by
from pagequarry.operators.links import page_index

#: Rows of a block of a download plan.
BUDGET_BLOCK = 20_000


def route_downloads(cands: DataFrame) -> DataFrame:
    """action: none (downloaded), metadata (it failed there), download."""
    failed_meta = (F.col("status") == "failed") & (F.coalesce("error_kind", F.lit("")) == "metadata")
    return cands.withColumn("action", F.when(F.col("status") == "downloaded", "none").when(failed_meta, "metadata").otherwise("download"))


def plan_budget(df: DataFrame, max_bytes: int, rows: int = BUDGET_BLOCK) -> DataFrame:
    """df (job_id, seq, file_size) with keep: in order of seq, a row is kept if it still fits into the job's budget; unknown
    sizes always are and count nothing. A skipped row leaves room for later ones, so this is a fold, not a running sum.

    Jobs that fit as a whole are settled by their sums. The others' rows are dealt into blocks of about `rows` in order; a block's
    sum and smallest size tell, with what is left before it, whether it fits as a whole or not at all. Only where neither
    holds are its rows gone through, one such block of each job a round, to learn what is left after it. Such blocks are few: each
    takes from the budget until nothing that it holds fits. At last every block is decided by itself, side by side with all
    others, from what is left before it; so a job of any length is spread over tasks. Rows that agree in job_id and seq come in any
    order; a null job is a job.
    """
    size = F.coalesce(F.col("file_size"), F.lit(0)).cast("long")
    total = df.groupBy("job_id").agg(F.sum(size).alias("_total"))
    known = df.join(total.withColumnRenamed("job_id", "_job"), F.col("job_id").eqNullSafe(F.col("_job")))
    fits = known.where(F.col("_total") <= max_bytes).select(*df.columns, F.lit(True).alias("keep"))
    over = known.where(F.col("_total") > max_bytes).select(*df.columns, size.alias("_size"), F.struct("job_id").alias("_key"))
    dealt = blocks_in_order(over, ["job_id", "seq"], rows, "_block")
    own = F.when(F.col("_size") <= max_bytes, F.col("_size"))  # what is larger never counts
    sums = keep(dealt.groupBy("_key", "_block").agg(F.coalesce(F.sum(own), F.lit(0)).alias("total"), F.min(F.when(own > 0, own)).alias("least")))
    opened = None
    while True:
        told = sums.withColumn("after", F.lit(None).cast("long")) if opened is None else sums.join(opened, ["_key", "_block"], "left")
        before = keep(_left_before(told, max_bytes))
        due = before.where("stuck").select("_key", "_block", "left")
        if due.isEmpty():
            break
        through = dealt.select("_key", "_block", "seq", "_size").join(due, ["_key", "_block"]).groupBy("_key", "_block").agg(F.array_sort(F.collect_list(F.struct("seq", "_size"))).alias("r"), F.first("left").alias("left"))
        after = F.aggregate("r", F.col("left"), lambda left, x: F.when(x["_size"] <= left, left - x["_size"]).otherwise(left))
        opened = keep(through.select("_key", "_block", after.alias("after")) if opened is None else opened.unionByName(through.select("_key", "_block", after.alias("after"))))

    def decide() -> Callable[[tuple], bool]:
        left = None

        def one(row: tuple) -> bool:
            nonlocal left
            left = row[1] if left is None else left
            keep = row[0] <= left
            left -= row[0] if keep else 0
            return keep

        return one

    started = dealt.join(before.select("_key", "_block", "left"), ["_key", "_block"])
    decided = scan_sorted(started, ["_key", "_block"], ["seq"], ["_size", "left"], decide, "keep", "boolean")
    return fits.unionByName(decided.select(*df.columns, "keep"))


def _left_before(sums: DataFrame, max_bytes: int) -> DataFrame:
    """_key, _block, left, stuck: what is left of a job's budget before each block of sums (_key, _block, total, least, after), up to
    the first block that has to be gone through. after: what is left after it, if that is known. One row of three numbers per block."""
    row = F.struct("_block", "total", "least", "after")
    state = F.struct(F.lit(max_bytes).cast("long").alias("left"), F.lit(False).alias("stuck"))

    def step(s, x):
        whole, none = x["total"] <= s["left"], x["least"].isNull() | (x["least"] > s["left"])
        after = F.coalesce(x["after"], F.when(whole, s["left"] - x["total"]).when(none, s["left"]))
        stuck = s["stuck"] | after.isNull()
        out = F.struct(x["_block"].alias("_block"), s["left"].alias("left"), after.isNull().alias("stuck"))
        said = F.when(s["stuck"], F.array().cast("array<struct<_block:int,left:bigint,stuck:boolean>>")).otherwise(F.array(out))
        return F.struct(F.coalesce(after, s["left"]).alias("left"), stuck.alias("stuck")), said

    told = sums.groupBy("_key").agg(F.array_sort(F.collect_list(row)).alias("b"))
    return told.select("_key", F.explode(fold_append(F.col("b"), state, step, "struct<_block:int,left:bigint,stuck:boolean>")).alias("x")).select("_key", "x.*")


def plan_until_total(df: DataFrame, max_bytes: int) -> DataFrame:
    """df with keep: true until the rows before hold more than max_bytes."""
    before = F.sum(F.coalesce(F.col("file_size"), F.lit(0))).over(W.partitionBy("job_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("keep", F.coalesce(before, F.lit(0)) <= max_bytes)


def video_skip_reason(is_drm: Column, is_blob: Column, needs_signature: Column) -> Column:
    return F.when(is_drm, "drm").when(is_blob, "mse_blob").when(needs_signature, "signature")


def image_filename(disposition: Column, url: Column, alt: Column, title: Column, ext: Column, fallback: Column) -> Column:
    """Name from the disposition, the URL, alt, title, else the fallback; with the extension if it has none."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    base = F.coalesce(blank(urls.content_disposition_filename(disposition)), blank(F.coalesce(F.try_url_decode(urls.url_basename(url)), urls.url_basename(url))).alias("b"), blank(alt), blank(title), fallback)
    clean = text.sanitize_filename(base, "image")
    return F.when(clean.rlike(r"(?i)\.[a-z0-9]{2,5}$") | ext.isNull(), clean).otherwise(F.concat_ws(".", clean, ext))


def video_filename(template: str, today: str, disposition: Column, title: Column, domain: Column, width: Column, height: Column, duration: Column, bitrate: Column, container: Column, label: Column | None = None) -> Column:
    """Disposition or template; quality is the size, else the bitrate; manifests get their variant's label before the extension."""
    ext = F.when(container == "hls", "ts").when(container.isin("dash", "unknown"), "mp4").otherwise(container)
    size = F.when((width > 0) & (height > 0), F.concat(width.cast("string"), F.lit("x"), height.cast("string")))
    quality = F.coalesce(size, F.when(bitrate > 0, F.concat(bitrate.cast("string"), F.lit("kbps"))))
    named = text.apply_filename_template(template, today, title, domain, width, height, duration, quality, ext, container)
    told = urls.content_disposition_filename(disposition)
    out = F.when(told.isNotNull(), text.sanitize_filename(told, "video")).otherwise(named)
    if label is None:
        return out
    return F.when(container.isin("hls", "dash") & label.isNotNull(), F.regexp_replace(out, r"(\.[^.]*)?$", F.concat(F.lit("__"), text.sanitize_filename(label, "video"), F.lit("$1")))).otherwise(out)


def target_folder(df: DataFrame, mode: str, root: str) -> DataFrame:
    """df with folder by mode: flat, page (number of the page in the job), domain, depth."""
    if mode == "page":
        pages = page_index(df)
        return df.join(pages, ["job_id", "source_page_url"]).withColumn("folder", F.concat(F.lit(f"{root}/page_"), F.lpad(F.col("page_no").cast("string"), 3, "0"))).drop("page_no")
    part = {"flat": F.lit(None).cast("string"), "domain": text.sanitize_filename(F.col("source_domain"), "image"), "depth": F.concat(F.lit("depth_"), F.col("depth").cast("string"))}[mode]
    return df.withColumn("folder", F.concat_ws("/", F.lit(root), part))


def uniquify_paths(df: DataFrame) -> DataFrame:
    """df (folder, filename, seq) with path: the second of equal names is "name (1).ext" and so on, in order of seq."""
    k = F.row_number().over(W.partitionBy("job_id", "folder", F.lower("filename")).orderBy("seq")) - 1
    stem, ext = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 2)
    name = F.when(k == 0, F.col("filename")).otherwise(F.concat(stem, F.lit(" ("), k.cast("string"), F.lit(")"), ext))
    return df.withColumn("path", F.concat_ws("/", "folder", name))


def route_retries(cands: DataFrame) -> DataFrame:
    """action of failed rows: metadata if it failed there or the size is missing, else download; others null."""
    meta = (F.coalesce("error_kind", F.lit("")) == "metadata") | F.col("file_size").isNull()
    return cands.withColumn("action", F.when(F.col("status") == "failed", F.when(meta, "metadata").otherwise("download")))


def retry_at(failures: DataFrame, policy: str = "image", max_retries: int = 2) -> DataFrame:
    """failures (job_id, seq, failed_at ms, retry_count, retryable) with retry_at in ms, null where there is no retry.

    image: 500 * 2**n ms, n counting the job's retries from 0, 10 s at most; video: 2000 * 2**(count - 1), 30 s at most.
    """
    ok = F.col("retryable") & (F.col("retry_count") <= max_retries)
    if policy == "image":
        n = F.sum(ok.cast("int")).over(W.partitionBy("job_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)) - 1
        wait = F.least(500 * F.pow(F.lit(2.0), F.least(n, F.lit(20))), F.lit(10_000.0))
    else:
        wait = F.least(2000 * F.pow(F.lit(2.0), F.least(F.col("retry_count"), F.lit(20)) - 1), F.lit(30_000.0))
    return failures.withColumn("retry_at", F.when(ok, F.col("failed_at") + wait.cast("long")))


def next_tasks(tasks: DataFrame, now: int, n: int) -> DataFrame:
    """The first n ready tasks of each job by priority, then age."""
    ready = (F.col("status") == "pending") & (F.coalesce("retry_at", F.lit(0)) <= now)
    return top_by(tasks.where(ready), ["job_id"], [F.desc("priority"), F.col("created_at"), F.col("seq")], n)


def ms_until_ready(tasks: DataFrame, now: int) -> DataFrame:
    """Per job, the wait for the next pending task: 0 if one is ready; jobs without pending tasks have 0 too."""
    due = F.min(F.when(F.col("status") == "pending", F.coalesce("retry_at", F.lit(0))))
    return tasks.groupBy("job_id").agg(F.coalesce(F.greatest(due - now, F.lit(0)), F.lit(0)).cast("long").alias("wait_ms"))


def classify_failure(status: Column, message: Column) -> Column:
    """code and retryable from an HTTP status and an error message."""
    m = F.lower(F.coalesce(message, F.lit("")))
    code = (
        F.when(status.isin(401, 403), "forbidden").when(status == 404, "not_found").when(status == 429, "rate_limited").when(status >= 500, "server")
        .when(m.rlike("timeout|timed out"), "timeout").when(m.rlike("network|connection|reset|dns"), "network").when(m.rlike("cancel"), "canceled").when(m.rlike("disk|space|quota"), "disk").otherwise("unknown")
    )
    return F.struct(code.alias("code"), code.isin("rate_limited", "server", "timeout", "network").alias("retryable"))
