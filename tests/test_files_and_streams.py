"""Heads of files without the rest of them; streams that stop, go on and play batches again."""

from pyspark.sql import functions as F

from pagequarry.sources import heads, readers
from pagequarry.streaming import jobs


def test_heads_read_no_more_than_asked(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.bin").write_bytes(bytes(range(200)) * (k + 1))
    with open(tmp_path / "large.bin", "wb") as f:  # more than any reader of whole files could take
        f.write(b"head")
        f.truncate(40 << 30)
    (tmp_path / "_hidden.bin").write_bytes(b"x")
    (tmp_path / "empty.bin").write_bytes(b"")
    got = {r.url.rsplit("/", 1)[1]: (r.size, bytes(r.body)) for r in readers.read_media_heads(spark, str(tmp_path / "*.bin"), 6).collect()}
    assert got == {**{f"f{k}.bin": (200 * (k + 1), bytes(range(6))) for k in range(3)}, "large.bin": (40 << 30, b"head\0\0"), "empty.bin": (0, b"")}
    far = {r.url.rsplit("/", 1)[1]: bytes(r.body) for r in readers.read_media_heads(spark, f"file://{tmp_path}", 5, 198).collect()}
    assert far["f0.bin"] == bytes([198, 199]) and far["f1.bin"] == bytes([198, 199, 0, 1, 2]) and far["empty.bin"] == b""


def test_bytes_are_counted(tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"y" * 100_000)
    read = []

    class Counting:
        def __init__(self, path):
            self.f = open(path, "rb")  # noqa: SIM115

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.f.close()

        def seek(self, n):
            self.f.seek(n)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    class System:
        open_input_file = staticmethod(Counting)

    monkeypatch.setattr(heads, "_opened", lambda path: (System, path, ""))
    reader = heads.HeadReader({"path": str(tmp_path), "n": "77", "offset": "5"})
    (batch,) = reader.read(heads.Files([(str(tmp_path / "a"), 100_000)]))
    assert read == [77] and batch.column(2)[0].as_py() == b"y" * 77


def test_candidates_go_on_from_the_checkpoint(spark, tmp_path):
    kind = "tab_id long, seq int, ts timestamp, url string, type string, status int"

    def arrive(*rows):
        df = spark.createDataFrame([(1, s, t, u, "xhr", 200) for s, t, u in rows], "tab_id long, seq int, t string, url string, type string, status int")
        df.select("tab_id", "seq", F.to_timestamp("t").alias("ts"), "url", "type", "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.run_to_end(jobs.stream_candidates(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive((1, "2024-01-01 10:00:00", "https://a/x.mp4"), (2, "2024-01-01 10:01:00", "https://a/p.html"))
    assert run() == [1]
    arrive((3, "2024-01-01 10:30:00", "https://a/x.mp4"), (4, "2024-01-01 14:00:00", "https://a/y.mp4"))
    arrive((5, "2024-01-01 09:00:00", "https://a/late.mp4"), (6, "2024-01-01 14:05:00", "https://a/y.mp4"))
    assert run() == [1, 4]  # 3 and 6 are known, 5 is too late
    assert run() == [1, 4]
    arrive((7, "2024-01-01 14:10:00", "https://a/x.mp4"), (8, "2024-01-01 14:10:00", "https://a/y.mp4"))
    assert run() == [1, 4, 7]  # by now x is new again


def test_replayed_batches_change_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("info", "a"), ("warn", "b")], "level string, message string")
    write = jobs.append_batch(str(tmp_path / "logs"))
    for number in (0, 1, 0, 1, 1):
        write(batch, number)
    assert spark.read.parquet(str(tmp_path / "logs")).count() == 4


def test_upserts(spark, tmp_path):
    kind = "id long, ts timestamp, seq long, width int, status string"
    known = spark.createDataFrame([(1, None, "new"), (2, 3, None), (4, None, None)], "id long, width int, status string")

    def arrive(*rows):
        df = spark.createDataFrame(rows, "id long, t string, seq long, width int, status string")
        df.select("id", F.to_timestamp("t").alias("ts"), "seq", "width", "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.run_to_end(jobs.upsert_stream(stream, known), str(tmp_path / "out"), str(tmp_path / "state"))
        return {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    arrive((1, "2024-01-01 00:00:02", 2, None, "x"), (1, "2024-01-01 00:00:01", 1, 5, "w"), (9, "2024-01-01 00:00:01", 3, 7, None))
    first = run()
    assert first == {(1, 5, "x", 2)}
    arrive((2, "2024-01-01 00:01:00", 4, None, None), (1, "2024-01-01 00:01:00", 5, None, None), (1, "2024-01-01 00:01:00", 6, 8, None))
    assert run() == first | {(1, 8, "x", 4), (2, 3, None, 1)}
    twin = jobs.apply_patches(spark.read.schema(kind).parquet(str(tmp_path / "in")), known)
    assert {tuple(r) for r in twin.select("id", "width", "status").collect()} == {(1, 8, "x"), (2, None, None)}
