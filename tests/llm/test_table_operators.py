"""Neighbours, transport streams, near duplicates, archives, mixing and the pipeline against plain Python."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import base, mixing, near_dedup, neighbours, queries, transport, warc
from pagequarry.llm.shingles import shingle_sets
from tests.conftest import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_neighbours(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[q])] = [int(i) for i in ids[best]]
    return out


@pytest.mark.parametrize("shape", ["table", "ties", "few"])
def test_neighbours(spark, shape):
    if shape == "table":
        df = spark.read.parquet(f"{DATA}/embeddings.parquet")
        rows = [(r.vec_id, r.embedding) for r in df.collect()]
    else:
        rng = np.random.default_rng(3)
        n = 1500 if shape == "ties" else 12
        rows = [(i, [1.0, 2.0, 0.5] if i % 3 else rng.normal(size=3).tolist()) for i in range(n)]
        odd = [(9001, None), (9002, [0.0, 0.0, 0.0]), (9003, [1.0, None, 2.0]), (9004, [float("nan"), 1.0, 1.0]), (9005, [float("inf"), 1.0, 1.0]), (9020, None), (9006, [1.0, 1.0])]
        df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    want, got = brute_neighbours(rows, 20), {}
    for r in sorted(neighbours.search(df, "vec_id % 20 = 0").collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    recall = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.9
    if shape != "table":
        assert got == want


@pytest.mark.parametrize("spread, least, most", [(0.25, 0.9, 0.45), (1.0, 0.9, 0.9)])
def test_neighbours_left_out(spark, monkeypatch, spread, least, most):
    """Recall on clustered and on scattered vectors in many cells, and the share of vectors that are verified."""
    monkeypatch.setattr(neighbours, "CELL", 64)
    monkeypatch.setattr(neighbours, "ROUNDS", (100, 1_000))
    rng = np.random.default_rng(11)
    x = rng.normal(size=(100, 32))[rng.integers(0, 100, 8_000)] + spread * rng.normal(size=(8_000, 32))
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(neighbours, "count_verified", seen.add)
    got = {}
    for r in neighbours.search(df, "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_neighbours(rows, 20)
    assert sum(len(got[q] & set(want[q])) for q in want) / (20 * len(want)) >= least
    assert 0 < seen.value / (len(rows) * len(want)) <= most


def test_neighbours_of_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [2.0, 9.0]), (2, [2.0, 0.0]), (20, [1.0, 0.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(20, 1, 1, 2.0), (20, 2, 2, 2.0)]


def test_neighbours_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(df, "vec_id % 20 = 0").count() == 0
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 0.01


def test_streams(spark):
    texts = [None, "", "x", "é" * 100, "a" * 64, "b" * 70_000, "b" * 70_000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in transport.media_digest(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r, m = got[i], transport.write_stream(pad)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest()) and len(m) % 188 == 0
    assert got[5].feature == got[6].feature and transport.media_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, *range(160, 180), 345, 350, 16_384, 16_385, 50_000])
def test_stream_round_trip(n):
    raw = random.Random(n).randbytes(n)
    streams, wrong = transport.read_stream(transport.write_stream(raw))
    assert (streams[0].data, streams[0].lost, wrong) == (raw, 0, [])
    assert [u[1] for u in streams[0].units] == [3600 * i for i in range(-(-n // transport.UNIT))]


def test_clashing_columns_of_streams(spark):
    df = spark.createDataFrame([(1, "abc", "m", "n", "p", "f")], "doc_id long, text string, media string, n_bytes string, packets string, feature string")
    stored = transport.store(df)
    assert sorted(stored.columns) == sorted(set(stored.columns)) and stored.first()["n_bytes"] == 3
    out = transport.read(stored)
    assert sorted(out.columns) == sorted(set(out.columns)) and out.first()["packets"] == 1


def test_tables_over_several_packets():
    """A program map of many streams takes several packets; the last stream of it is the one with data."""
    raw = random.Random(5).randbytes(5_000)
    media = transport.write_stream(raw)
    streams = [(0x06, 0x200 + i) for i in range(60)] + [(transport.STREAM_TYPE, transport.DATA_PID)]
    body = (0xE000 | transport.DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + b"".join(bytes([k]) + (0xE000 | i).to_bytes(2, "big") + b"\xf0\x00" for k, i in streams)
    tables = transport._table_packets(transport.PMT_PID, transport._section(2, transport.PROGRAM, body))
    assert len(tables) == 2 * 188
    found, wrong = transport.read_stream(media[:188] + tables + media[376:])
    assert wrong == [] and len(found) == 61 and found[-1].data == raw
    _, wrong = transport.read_stream(media[:188] + tables[:188] + media[376:])
    assert wrong == ["section of 256 is broken"]


@pytest.mark.parametrize("at, length", [(188 * 40 + 7, -1), (188 * 40, 5), (188 * 40, 188 * 3 + 11)])
def test_streams_find_packets_again(at, length):
    """After a lost byte, or before stray ones, one packet is missing: from outside, both look like a packet of a wrong length."""
    raw = random.Random(9).randbytes(50_000)
    media = transport.write_stream(raw)
    broken = media[:at] + media[at + 1 :] if length < 0 else media[:at] + bytes(length) + media[at:]
    (s,), wrong = transport.read_stream(broken)
    assert s.lost == 1 and len(raw) - len(s.data) == 184 and s.data[:5_000] == raw[:5_000] and s.data[-40_000:] == raw[-40_000:]
    assert f"{188 + length} bytes outside packets" in wrong


def test_flags_and_times_of_packets():
    media = bytearray(transport.write_stream(bytes(100)))
    both = b"\x00\x00\x01\xe0" + (3 + 10 + 4).to_bytes(2, "big") + b"\x80\xc0\x0a" + bytes([transport._stamp(9000)[0] | 0x10]) + transport._stamp(9000)[1:] + transport._stamp(5400) + b"data"
    clock = (123 << 15 | 0x7E00 | 45).to_bytes(6, "big")
    fill = transport.PACKET - 4 - 1 - 7 - len(both)
    packet = bytes([0x47, 0x41, 0x01, 0x31, 7 + fill, 0x50]) + clock + b"\xff" * fill + both
    (s,), wrong = transport.read_stream(bytes(media) + packet)
    assert wrong == [] and s.units[1] == (100, 9000, True, 5400) and s.clocks == [123 * 300 + 45] and s.data == bytes(100) + b"data"
    plain = b"\x00\x00\x01\xbe\x00\x03xyz"
    fill = transport.PACKET - 4 - 2 - len(plain)
    packet = bytes([0x47, 0x41, 0x01, 0x31, 1 + fill, 0]) + b"\xff" * fill + plain
    (s,), wrong = transport.read_stream(bytes(media) + packet)
    assert wrong == [] and s.units[1] == (100, None, False, None) and s.data[100:] == b"xyz"
    media[2 * 188 + 3] |= 0x80
    assert transport.read_stream(bytes(media))[1] == ["1 scrambled packets"]
    media[2 * 188 + 1] |= 0x80
    assert transport.read_stream(bytes(media))[1] == ["1 packets with the error flag"]


def test_damaged_streams():
    media = transport.write_stream(bytes(90_000))
    assert transport.read_stream(media[: 188 * 40] + media[188 * 41 :])[0][0].lost == 1
    again = transport.read_stream(media[: 188 * 41] + media[188 * 40 :])
    assert again[0][0].lost == 0 and len(again[0][0].data) == 90_000  # a packet sent twice
    assert "no program association" in transport.read_stream(media[188:])[1]
    assert transport.read_stream(b"")[0] == [] and transport.read_stream(b"x" * 400)[1]
    broken = bytearray(media)
    broken[15] ^= 1
    assert "section of 0 is broken" in transport.read_stream(bytes(broken))[1]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, percent):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([None, "", " \t", "one", "ONE", "two words", "two  words", "İ x y z", "i̇ x y z"])]
    for i in range(60):  # a large family of near copies, chained
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = rng.choice("xyz") * 3
        rows.append((100 + i, " ".join(w)))
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit(1)).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, n, percent).collect()}
    assert got == brute_components(rows, n, percent)
    assert near_dedup.near_duplicates(df.limit(0), n, percent).count() == 0
    df = df.withColumns({c: F.lit("clash") for c in ("_id", "id", "hub", "n", "h1", "component_id", "kept", "doc of class")})
    kept = near_dedup.keep_one(df, n, percent)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


@pytest.mark.parametrize("hot", [3, 1 << 14])
def test_join_spread(spark, monkeypatch, hot):
    monkeypatch.setattr(base, "HOT", hot)
    rows = spark.createDataFrame([(i, None if i % 11 == 0 else 7 if i % 3 == 0 else i % 40, "x") for i in range(200)], "id long, k long, name string")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 30, 7)] + [(99, "v99")], "k long, v string")
    for how in ("inner", "left"):
        got = base.join_spread(rows, table, ["k"], "id", how)
        assert got.columns == ["id", "k", "name", "v"]
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "k", how).select("id", "k", "name", "v").collect()))
    assert base.join_spread(rows.limit(0), table, ["k"], "id", "left").count() == 0


def test_frequent_keys_are_spread(spark, monkeypatch):
    """One set, one band key and one component hold most rows: joins go by salts and find the same."""
    for module in (base, near_dedup):
        monkeypatch.setattr(module, "HOT", 4)
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:i] + ["odd"] + words[i + 1 :]) for i in (0, 1, 58, 59)]
    rows = [(i, " ".join(words)) for i in range(20)] + [(20 + i, near[i % 4] + f" end{i % 3}") for i in range(24)] + [(50 + i, t) for i, t in enumerate(["", None, "one two three four", "   ", "one two three four"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 3, 85).collect()} == brute_components(rows, 3, 85)
    star = spark.createDataFrame([(5, i) for i in range(6, 40)] + [(39, 1), (100, 101)], "a long, b long")
    assert {(r.id, r.component) for r in near_dedup.components(star).collect()} == {(i, 1) for i in [1, *range(5, 40)]} | {(100, 100), (101, 100)}


def test_tiles_and_components(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 7)
    rng = random.Random(2)
    rows = [(i, " ".join([f"w{k}" for k in range(40)] + [f"x{rng.randrange(3)}"])) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(df, 3, 85).collect()} == {0}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    assert {(r.id, r.component) for r in near_dedup.components(chain).collect()} == {(i, 0) for i in range(41)} | {(99, 99), (100, 99)}


def test_members_that_fail_their_hub(spark, monkeypatch):
    """Families under one hub: they link among themselves, not with the hub; the result is that of brute force."""
    monkeypatch.setattr(near_dedup, "TILE", 5)
    rng = random.Random(8)
    core, rows = [f"c{k}" for k in range(50)], []
    for family in range(4):
        own = core[: 50 - 9 * family] + [f"f{family}_{k}" for k in range(9 * family)]
        for i in range(13):
            w = list(own)
            w[rng.randrange(50)] = f"x{i}"
            rows.append((100 * family + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 3, 85).collect()} == want
    pairs = spark.createDataFrame([(0, i) for i, _ in rows if i], "hub long, id long")  # one group of all
    texts = df.select(F.col("doc_id").alias("id"), "text")
    label = {r.id: r.component for r in near_dedup.components(near_dedup.links_of_groups(pairs, texts, 3, 85)).collect()}
    assert {i: label.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in want.items()} and len(set(label.values())) > 1


def test_other_thresholds():
    for percent in (50, 70, 90, 95, 100):
        bands, rows = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1.1e-5 and bands * rows <= 400


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "q r s t u v"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in near_dedup.near_duplicates(df, 3, 85).collect())
    assert len(got) == 4 and got[1:] == [(1, 1), (2, 1), (2, 1)]


def test_circulant_signature():
    s = shingle_sets(["a b c d e f g h"], 3)[0]
    first, windows = near_dedup._permutations(16)
    second = windows[:, 0]
    at = first[np.unique(s >> np.uint64(44)).astype(int)]
    want = [min(int(second[(x + k) % near_dedup.SLOTS]) for x in at) for k in range(16)]
    assert near_dedup.signature(s, 16).tolist() == want


def test_shingles_of_long_and_odd_texts():
    long = "Ä b " * 400_000
    assert [len(s) for s in shingle_sets([long, None, "", "x", "A B", "a b"], 3)] == [2, 0, 0, 1, 1, 1]
    one, two = shingle_sets(["A B", "a\tb"], 3)
    assert (one == two).all()


def test_archives(spark):
    rows = [(5, "u", "same"), (3, "u", "same"), (9, "v\r\nx", "é" * 3_000), (-1, None, None), (4, "w", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("headers", F.lit("clash"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.n_problems) for r in warc.archive_pages(df).collect()}
    b32 = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == {
        3: (4, b32("same"), "response", None, 0), 5: (4, b32("same"), "revisit", 3, 0), 9: (6_000, b32("é" * 3_000), "response", None, 0),
        -1: (0, b32(""), "response", None, 0), 4: (0, b32(""), "revisit", -1, 0),
    }
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_archive_reader():
    import zstandard

    record = warc.record_bytes("response", "r", "u", warc.digest(b"abc"), b"abc")
    w = warc.ArchiveWriter(b"WARC/1.1\r\nContent-Length" * 9)
    w.add(record)
    w.add(record.replace(b"Content-Length: 3", b"Content-Length: 9"))
    w.add(record.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"))
    got = list(warc.read_archive(w.bytes()))
    assert [r.problems for r in got] == [[], ["3 bytes of block, not 9", "payload digest differs"], ["payload digest differs"]]
    whole = w.bytes()
    packed = zstandard.ZstdCompressor().compress(w.parts[0][8:])  # a dictionary that is a frame itself
    assert len(list(warc.read_archive(whole[:4] + len(packed).to_bytes(4, "little") + packed + b"".join(w.parts[1:])))) == 3
    assert "cut off" in list(warc.read_archive(whole[:-3]))[-1].problems[0]
    assert list(warc.read_archive(b"")) == [] and list(warc.read_archive(b"not zstd at all"))[0].problems


CLASH = ["size", "dup", "tag", "copies", "skey", "row", "_id", "_copy", "range", "target", "taken", "n", "weight", "of_dup", "of_doc_id", "col", "u", "b", "p"]


def test_many_sources(spark, monkeypatch):
    """Targets by ranges of sources as by one list; rows that repeat are documents of their own."""
    rng = random.Random(9)
    rows = [(i, f"s{rng.randrange(60)}", rng.randrange(1, 9) ** 4) for i in range(400)] + [(None, "s1", 7)] * 30
    df = spark.createDataFrame(rows, "doc_id long, source string, n_words long")
    one = sorted(mixing.mix(df, size="n_words").collect(), key=str)
    monkeypatch.setattr(mixing, "RANGE", 7)
    two = sorted(mixing.mix(df, size="n_words").collect(), key=str)
    assert len(one) == 430 and [(r.doc_id, r.dup, r.copies) for r in one] == [(r.doc_id, r.dup, r.copies) for r in two]
    assert all(abs(a.target - b.target) < 1e-6 for a, b in zip(one, two))
    assert abs(sum({r.skey: r.target for r in one}.values()) - sum(s for *_, s in rows)) < 1e-6
    assert sorted(r.dup for r in one if r.doc_id is None) == list(range(1, 31))


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))), rng.choice(["a", "b", "B", "é", None, "tiny"][: 5 if i % 40 else 6])) for i in range(1_500)]
    df = spark.createDataFrame([*rows, (7, "only words", "a"), (7, "only words", "a"), (8, None, "void")], "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in CLASH})
    out = mixing.mix(df, block=16).collect()
    assert len(out) == 1_503
    size = {}
    for _, t, s in [*rows, (7, "only words", "a"), (7, "only words", "a"), (8, None, "void")]:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
        open_ -= over
    told = {round(r.target, 6) for r in out}
    assert told == {round(x, 6) for x in target.values()}
    for s in order:
        mine = [r for r in out if abs(r.target - target[s]) < 1e-6 and r.source_size == size[s]]
        assert abs(sum(r.taken for r in mine) - target[s]) <= 60
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    assert sorted(out) == sorted(mixing.mix(df.repartition(7), block=16).collect())
    assert mixing.mix(df.limit(0)).count() == 0
    again = mixing.mixed_documents(df, block=16)
    assert again.columns == df.columns and abs(again.count() - sum(r.copies for r in out)) <= 15  # texts are told apart there
    assert again.where("size <> 'clash' or row <> 'clash' or dup <> 'clash'").isEmpty()


def test_expected_copies(spark):
    """Over many seeds a document's mean number of copies is its fraction."""
    df = spark.createDataFrame([(i, 10 + i, "a" if i < 8 else "b") for i in range(16)], "doc_id long, size long, source string")
    total = np.zeros(16)
    for seed in range(12):
        for r in mixing.mix(df, seed=seed, block=4, size="size").collect():
            total[r.doc_id] += r.copies
    share = {r.doc_id: r.target / r.source_size for r in mixing.mix(df, size="size").collect()}
    assert abs(total.mean() / 12 - np.mean(list(share.values()))) < 0.1


def test_registered_queries(spark):
    for name, q in queries.queries().items():
        df = q(spark, DATA)
        assert df.columns and re.match(r"op\d+_", name)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "sentence_pieces"]
    out = corpus_pipeline.run(spark, DATA)
    assert 0 < out.count() <= 3 * docs.count() and out.where("n_pieces <> size(ids)").count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == docs.columns, name
        assert stage(spark, docs.limit(0), DATA).count() == 0
