"""The sharded model against plain Python without sampling; the sampler against exact probabilities."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagequarry.llm import pitman_yor as m
from pagequarry.llm.base import table
from pagequarry.llm.queries import op11_pitman_yor_scores
from tests.conftest import DATA

WORD = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def plain(docs):
    """Rows of the contract, and the score with every dish at one table."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    seen = [tokens(t) for i, t in docs if not held(i)]
    count = Counter(x for t in seen for x in t)
    pair = Counter(p for t in seen for p in zip([None, *t], t))
    tables, customers = Counter(u for u, _ in pair), Counter(w for _, w in pair)
    n, v = sum(count.values()), len(count)
    discount = lambda c: m._discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    d, e = discount(pair), discount(customers)
    share = lambda w: (max(customers[w] - e, 0) + (1 + e * v) / (v + 1)) / (1 + sum(customers.values()))
    p = lambda u, w: (max(pair[u, w] - d, 0) + (1 + d * tables[u]) * share(w)) / (1 + count[u])
    rows = []
    for i, text in docs:
        t = tokens(text)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)
        rows.append((i, held(i), len(t), sum(count[x] > 0 for x in t), n, base, sum(math.log10(p(*q)) for q in zip([None, *t], t))))
    return sorted(rows, key=repr)


def rows_of(df):
    return sorted((tuple(r[k] for k in COLUMNS) for r in df.collect()), key=repr)


def close(a, b, last):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], rel=1e-9, abs=1e-9)
        assert not last or x[6] == pytest.approx(y[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("small", [False, True])
def test_without_sampling(spark, monkeypatch, small):
    monkeypatch.setattr(m, "STEPS", (0, 0, 0))
    if small:
        monkeypatch.setattr(m, "BLOCK", 3_000)
        monkeypatch.setattr(m, "WORD_SHARD", 40_000)
        monkeypatch.setattr(m, "PAIR_SHARD", 9_000)
    rng = random.Random(5)
    words = ["a", "B", "b", "der", "Öl", "öl", "x1", " ", "\x00", "end."]
    docs = [(i, " ".join(rng.choices(words, range(1, 11), k=rng.randrange(40)))) for i in range(700)]
    docs += [(7, "a a a"), (7, "a a a"), (None, "b a"), (None, None), (800, None), (801, ""), (802, " \t\n"), (803, "only here " * 3), (804, "long " * 9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS kind", "2 AS held").repartition(3)
    close(rows_of(m.score_documents(df)), plain(docs), True)


def test_query(spark):
    got = op11_pitman_yor_scores(spark, DATA)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    rows = rows_of(got)
    close(rows, plain([(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()]), False)
    assert rows == rows_of(op11_pitman_yor_scores(spark, DATA))
    apart = [r for r in rows if r[1]]
    assert sum(r[6] for r in apart) > sum(r[5] for r in apart) and sum(r[6] for r in rows) > sum(r[5] for r in rows)


def test_few_documents(spark):
    some = spark.createDataFrame([(2, "a b"), (11, "c")], "doc_id long, text string").where(m.held_out(m.F.col("doc_id")))
    for r in rows_of(m.score_documents(some)):
        assert r[1:] == (True, r[2], 0, 0, 0.0, 0.0)
    assert m.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_seating_has_the_right_distribution():
    """One dish of five customers, many times over: tables of the chain against the exact probabilities of all partitions."""
    d, strength, share, many, n = 0.6, 1.5, 0.2, 5, 4_000
    weight = defaultdict(float)

    def seat(sizes, left, p):
        if not left:
            weight[len(sizes)] += p
            return
        seat([*sizes, 1], left - 1, p * (strength + d * len(sizes)) * share)
        for i, s in enumerate(sizes):
            seat([*sizes[:i], s + 1, *sizes[i + 1 :]], left - 1, p * (s - d))

    seat([], many, 1.0)
    s = m.Seating(np.arange(n), np.full(n, many), np.arange(n), np.ones(n, np.int64))
    rng, seen = np.random.default_rng(1), Counter()
    for k in range(120):
        s.step(rng, np.full(n, share), d, strength)
        c, t = s.counts()
        assert (c == many).all() and (t == s.tables).all() and (np.diff(s.dish) >= 0).all() and s.size.min() > 0
        if k >= 40:
            seen.update(t.tolist())
    for t, w in weight.items():
        assert seen[t] / (80 * n) == pytest.approx(w / sum(weight.values()), abs=0.01)


def test_resizing_keeps_the_counts():
    rng = np.random.default_rng(2)
    s = m.Seating(np.array([0, 0, 1, 2, 2, 2]), np.array([3, 4, 1, 2, 2, 9]), np.zeros(3, np.int64), np.array([6]))
    for many in ([7, 5, 1], [2, 9, 30], [1, 1, 1], [4, 2, 8]):
        s.resize(np.array(many))
        assert s.counts()[0].tolist() == many and s.tables[0] == len(s.dish) and s.size.min() > 0
        s.step(rng, np.full(3, 0.1), 0.5, 1.0)
        assert s.counts()[0].tolist() == many
