import random
import struct  # noqa: F401

from pyspark.sql import functions as F

from pagequarry.operators import downloads, links
from pagequarry.sources import readers, sinks
from pagequarry.streaming import jobs


def test_budget_is_a_fold(spark):
    rng = random.Random(1)
    rows = [(j, s, rng.choice([None, 10, 60, 90])) for j in range(4) for s in range(30)]
    got = {(r.job_id, r.seq): r.keep for r in downloads.plan_budget(spark.createDataFrame(rows, "job_id int, seq int, file_size long").withColumn("seq", F.col("seq").cast("long")), 200).collect()}
    for j in range(4):
        total = 0
        for _, s, size in (r for r in rows if r[0] == j):
            fits = total + (size or 0) <= 200
            total += (size or 0) * fits
            assert got[j, s] == fits


def test_long_jobs_pass_once(spark):
    """One job of 200,000 rows, and rows without a job: a row's size is below the budget, so what is left gets ever smaller."""
    ids = spark.range(200_000).select(F.when(F.col("id") % 100 > 0, 1).alias("job_id"), F.col("id").alias("seq"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("file_size"))
    got = {(r.job_id, r.seq): (r.file_size, r.keep) for r in downloads.plan_budget(ids, 50_000).collect()}
    assert len(got) == 200_000
    for job in (1, None):
        total = 0
        for s in range(200_000):
            if (job, s) in got:
                size, keep = got[job, s]
                assert keep == (total + size <= 50_000)
                total += size * keep
    e = ids.select("job_id", F.lit("page").alias("kind"), "seq", F.element_at(F.array(*[F.lit(x) for x in (429, 200, 404, None)]), (F.pmod(F.xxhash64("seq"), F.lit(4)) + 1).cast("int")).alias("status"))
    want = {}
    for r in sorted(e.collect(), key=lambda r: r.seq):
        f = want.get(r.job_id, 1.0)
        want[r.job_id] = min(f * 1.4 if r.status is None else f * 2 if r.status == 429 else max(f * 0.75, 1.0) if r.status == 200 else f, 60)
    assert {r.job_id: r.factor for r in jobs.backoff(e, 1000, 60_000).collect()} == want


def test_retry_and_backoff(spark):
    f = spark.createDataFrame([(1, s, 0, 1, s != 2) for s in range(7)], "job_id int, seq int, failed_at long, retry_count int, retryable boolean")
    assert [r.retry_at for r in downloads.retry_at(f).orderBy("seq").collect()] == [500, 1000, None, 2000, 4000, 8000, 10000]
    e = spark.createDataFrame([(1, "page", i, s) for i, s in enumerate([429, 429, 200])], "job_id long, kind string, seq int, status int")
    assert jobs.backoff(e, 1000, 60_000).first().factor == 3.0
    many = spark.createDataFrame([(1, "page", i, s) for i, s in enumerate([429] + [200] * 6)], "job_id long, kind string, seq int, status int")
    assert jobs.backoff(many, 1000, 60_000).first().factor == 1.0


def test_queue_order(spark):
    rows = [(1, i, p, c, r, "pending") for i, (p, c, r) in enumerate([(10, 1, None), (50, 3, None), (50, 2, None), (99, 0, 5000)])]
    t = spark.createDataFrame(rows, "job_id int, seq int, priority int, created_at int, retry_at long, status string")
    assert [r.seq for r in downloads.next_tasks(t, 1000, 5).orderBy(F.desc("priority"), "created_at").collect()] == [2, 1, 0]


def test_frontier(spark):
    edges = spark.createDataFrame([(f"https://x.com/{a}", f"https://x.com/{b}") for a, b in [("0", "1"), ("0", "2"), ("1", "3"), ("3", "4"), ("2", "0")]] + [("https://x.com/0", "https://y.com/q")], "src_url string, dst_url string")
    job = spark.createDataFrame([(1, "https://x.com/0")], "job_id int, root_url string")
    got = {r.url: r.depth for r in links.expand_frontier(edges, job, scope="origin").collect()}
    assert got == {"https://x.com/0": 0, "https://x.com/1": 1, "https://x.com/2": 1, "https://x.com/3": 2}


def test_unique_paths(spark):
    t = spark.createDataFrame([(1, i, "f", n) for i, n in enumerate(["a.jpg", "A.jpg", "b", "b"])], "job_id int, seq int, folder string, filename string")
    assert [r.path for r in downloads.uniquify_paths(t).orderBy("seq").collect()] == ["f/a.jpg", "f/A (1).jpg", "f/b", "f/b (1)"]


def test_sinks_and_snapshot(spark, tmp_path):
    rows = [(1, "a", "https://x/1.jpg", 'p,"q"', 5, None, 7, "image/jpeg", "jpg", 0, "downloaded", True), (2, "b", "https://x/2.jpg", "p", None, None, None, None, None, 1, "queued", False)]
    df = spark.createDataFrame(rows, "job_id int, id string, image_url string, source_page_url string, width int, height int, file_size long, mime_type string, extension string, depth int, status string, selected boolean")
    sinks.write_candidates_csv(df.coalesce(1), str(tmp_path / "c"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert lines == [",".join(sinks.CSV_COLUMNS), 'https://x/1.jpg,"p,""q""",5,,7,jpg,0,downloaded', "https://x/2.jpg,p,,,,,1,queued"]
    sinks.write_candidates_json(df, str(tmp_path / "j"))
    assert any('"width":null' in r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    sinks.write_url_list(df, str(tmp_path / "u"))
    assert [r.value for r in spark.read.text(str(tmp_path / "u")).collect()] == ["https://x/1.jpg"]
    sinks.save_snapshot({"candidates": df}, str(tmp_path / "s"))
    sinks.save_snapshot({"candidates": df.where("job_id = 2")}, str(tmp_path / "s"))
    back = readers.restore_snapshot(spark, str(tmp_path / "s"))
    assert {(r.id, r.status, r.selected) for r in back["candidates"].collect()} == {("a", "downloaded", False), ("b", "ready", False)}
    assert back["seen_keys"].count() == 2


def test_frontier_with_a_cap(spark):
    """Levels read tables only; rejected pages hold their place; order of arrival decides."""
    edges = spark.createDataFrame([("https://x.com/0", f"https://x.com/{n}", s) for s, n in enumerate("edcba")] + [("https://x.com/e", "https://x.com/z", 9)], "src_url string, dst_url string, seq int")
    job = spark.createDataFrame([(1, "https://x.com/0"), (2, "https://x.com/e")], "job_id int, root_url string")
    rules = links.parse_robots(spark.createDataFrame([("https://x.com", "User-agent: *\nDisallow: /d")], "origin string, body string"))
    got = links.expand_frontier(edges, job, rules, max_pages=4)
    assert sorted((r.job_id, r.url[-1], r.depth) for r in got.collect()) == [(1, "0", 0), (1, "c", 1), (1, "e", 1), (2, "e", 0), (2, "z", 1)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_many_rules_of_one_host(spark):
    """5,000 literal rules and 50,000 URLs of one host: no plan node makes pairs of them all."""
    n = 5_000
    body = "User-agent: *\n" + "".join(f"{'Allow' if k % 3 else 'Disallow'}: /p/{k}\n" for k in range(n))
    rules = links.parse_robots(spark.createDataFrame([("https://x.com", body)], "origin string, body string"))
    pages = spark.range(50_000).select(F.concat(F.lit("https://x.com/p/"), F.col("id").cast("string")).alias("url"), "id")
    got = links.robots_allowed(pages, rules)
    bad = {r.id for r in got.where("not allowed").collect()}

    def refused(path):
        known = [int(path[:c]) for c in range(1, 5) if path[0] != "0" or path == "0" for _ in [0] if c <= len(path) and int(path[:c]) < n]
        return bool(known) and max(known) % 3 == 0

    assert bad == {k for k in range(50_000) if refused(str(k))}


def test_responses_and_files(spark, tmp_path):
    spark.createDataFrame([({"Content-Type": "x", "A": "1"},)], "headers map<string,string>").write.parquet(str(tmp_path / "r"))
    assert readers.read_responses(spark, str(tmp_path / "r")).first().headers == {"content-type": "x", "a": "1"}
    (tmp_path / "m.m3u8").write_text("#EXTM3U\na")
    (tmp_path / "b.bin").write_bytes(b"x" * 99)
    assert readers.read_manifests(spark, str(tmp_path / "*.m3u8")).first().body == "#EXTM3U\na"
    head = readers.read_media_heads(spark, str(tmp_path / "*.bin"), 10).first()
    assert (head.size, bytes(head.body)) == (99, b"x" * 10)


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_match_their_twins(spark, tmp_path):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}", u, "xhr", 0) for i, u in enumerate(["https://a/x.mp4", "https://a/x.mp4", "https://a/p.html", "https://a/y.m3u8"])]
    r = spark.createDataFrame(rows, "tab_id long, seq int, t string, url string, type string, status int").withColumn("ts", F.to_timestamp("t"))
    r.write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(r.schema).parquet(str(tmp_path / "r"))
    assert sorted(x.video_url for x in _drain(jobs.stream_candidates(stream), "cands").collect()) == ["https://a/x.mp4", "https://a/y.m3u8"]
    e = spark.createDataFrame([(1, "page", i, s) for i, s in enumerate([429, 503, 200])], "job_id long, kind string, seq int, status int")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    assert _drain(jobs.backoff_stream(s, 1000, 60_000), "back", "update").first().factor == jobs.backoff(e, 1000, 60_000).first().factor
    logs = spark.createDataFrame([("info", "c", "m", None), ("debug", "c", "m", None)], "level string, category string, message string, ref string")
    logs.write.parquet(str(tmp_path / "l"))
    assert _drain(jobs.stream_logs(spark.readStream.schema(logs.schema).parquet(str(tmp_path / "l"))), "logs").count() == 1
