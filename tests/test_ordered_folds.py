"""Budgets and back-off over blocks: one job that holds most rows gives what a pass over all its rows gives."""

import random

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import tables
from pagequarry.operators import downloads
from pagequarry.streaming import jobs


def greedy(rows, most):
    left, out = {}, {}
    for job, seq, size in sorted(rows, key=lambda r: r[1]):
        fits = (size or 0) <= left.setdefault(job, most)
        left[job] -= (size or 0) * fits
        out[job, seq] = fits
    return out


@pytest.mark.parametrize("sizes", [[None, 0, 1, 5, 60, 400], [90, 95, 101, 3], [1, 1000], [None, 2000]])
def test_budget_over_blocks(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(None if s % 50 == 0 else 2 if s % 9 == 0 else 1, s, rng.choice(sizes)) for s in range(400)]
    df = spark.createDataFrame(rows, "job_id int, seq long, file_size long")
    for block in (1, 7, 60, 1000):
        got = downloads.plan_budget(df, 500, rows=block)
        assert got.columns == ["job_id", "seq", "file_size", "keep"]
        assert {(r.job_id, r.seq): r.keep for r in got.collect()} == greedy(rows, 500)


def test_falling_sizes_open_block_after_block(spark):
    rows = [(1, s, 200 - s) for s in range(200)] + [(1, 200 + s, 1) for s in range(20)]
    got = downloads.plan_budget(spark.createDataFrame(rows, "job_id int, seq long, file_size long"), 1010, rows=20)
    assert {(r.job_id, r.seq): r.keep for r in got.collect()} == greedy(rows, 1010)


def test_budget_of_nothing(spark):
    none = spark.createDataFrame([], "job_id int, seq long, file_size long")
    assert downloads.plan_budget(none, 5).count() == 0 and jobs.backoff(none.selectExpr("job_id", "'p' AS kind", "seq", "1 AS status"), 1, 9).count() == 0


def test_most_rows_of_one_job_are_spread(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, 2).otherwise(1).alias("job_id"), F.lit(5).alias("seq"), "id")
    blocks = tables.blocks_in_order(df, ["job_id", "seq"], 100).groupBy("block").agg(F.count("*").alias("n"), F.min("job_id").alias("a"), F.max("job_id").alias("b")).orderBy("block").collect()
    assert len(blocks) > 15 and max(r.n for r in blocks) < 600
    assert [(r.a, r.b) for r in blocks] == sorted((r.a, r.b) for r in blocks)


def test_backoff_over_blocks(spark):
    rng = random.Random(3)
    rows = [(None if s % 40 == 0 else 1, "kq"[s % 3 == 0], s, rng.choice([429, 503, 200, 301, 404, None, 500])) for s in range(600)]
    want = {}
    for job, kind, _, s in rows:
        f = want.get((job, kind), 1.0)
        f = f * 1.4 if s is None else f * 2 if s in (429, 503) else max(f * 0.75, 1.0) if 200 <= s < 400 else f
        want[job, kind] = min(f, 60)
    df = spark.createDataFrame(rows, "job_id int, kind string, seq long, status int")
    for block, fan in ((5, 2), (50, 3), (10_000, 1000)):
        got = jobs.backoff_maps(df, 60.0, block, fan).select("job_id", "kind", jobs._clamp(F.col("m"), F.lit(1.0)).alias("f"))
        assert {(r.job_id, r.kind): pytest.approx(r.f, rel=1e-12) for r in got.collect()} == want


def test_state_of_the_stream_is_a_map(spark, tmp_path):
    rows = [(1, "page", s, [429, None, 200, 503, 404][s * 7 % 5]) for s in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "job_id long, kind string, seq int, status int").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("job_id long, kind string, seq int, status int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    q = jobs.backoff_stream(s, 1000, 60_000).writeStream.format("memory").queryName("maps").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    told = [r.factor for r in spark.table("maps").collect()]
    batch = jobs.backoff(spark.createDataFrame(rows, "job_id long, kind string, seq int, status int"), 1000, 60_000).first().factor
    assert len(told) == 4 and told[-1] == pytest.approx(batch)
