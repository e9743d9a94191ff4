"""Clustering against plain Python in exact integers."""

import math
import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from pagequarry.llm import centroids as c
from pagequarry.llm.base import table
from pagequarry.llm.queries import op12_centroid_clusters, oracle_sql
from tests.conftest import DATA

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, width=64, scale=256, k=40, rounds=5):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cent = [list(v) for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, m), j) for j, m in enumerate(cent)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(cent)):
            mine = [v for (_, v), (_, i) in zip(kept, own) if i == j]
            if mine:
                cent[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    total = sum(d for d, _ in own)
    by = {j: sum(d for d, i in own if i == j) for j in range(len(cent))}
    return sorted(((i, j, d, by[j], total, sha256(",".join(map(str, cent[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own)), key=repr)


def rows_of(df):
    return sorted((tuple(r[k] for k in COLUMNS) for r in df.collect()), key=repr)


def test_query(spark):
    got = op12_centroid_clusters(spark, DATA)
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    mine = rows_of(got)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{DATA}/embeddings.parquet')")
    assert mine == sorted(con.sql(f"select {', '.join(COLUMNS)} from ({oracle_sql()['op12_centroid_clusters']})").fetchall(), key=repr)
    assert mine == plain([(r["vec_id"], r["embedding"]) for r in table(spark, DATA, "embeddings").collect()])


def test_odd_vectors(spark):
    rng = random.Random(4)
    base = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(4)]
    rows = [(n, [x + rng.gauss(0, 0.1) for x in rng.choice(base)]) for n in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(None, [0.0] * 5), (None, [1.0] * 5), (900, None), (901, [1.0] * 4), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS apex", "3 AS cluster").repartition(5)
    assert rows_of(c.cluster(df, 5, 256, 12)) == plain(rows, 5, 256, 12)
    assert rows_of(c.cluster(df.limit(3), 5, 256, 12))[0][2] == 0  # each its own centroid
    same = spark.createDataFrame([(n, [0.5] * 5) for n in range(50)], "vec_id long, embedding array<double>")
    assert rows_of(c.cluster(same, 5, 256, 12)) == plain([(n, [0.5] * 5) for n in range(50)], 5, 256, 12)
    assert c.cluster(df.limit(0), 5).count() == 0
    big = spark.createDataFrame([(1, [1e30] * 5), (2, [-1e30] * 5)], "vec_id long, embedding array<double>")
    assert {r[2] for r in rows_of(c.cluster(big, 5, 256, 1, rounds=1))} == {5 * c.LARGEST**2}


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_bounds_hold_and_prune(spread):
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.standard_normal((30, 64)).repeat(40, axis=0) + spread * rng.standard_normal((1200, 64)))).astype(np.int64)
    simplex = c.Simplex(c.pick_pivots(x, c.PIVOTS))
    assert len(simplex.pivots) == c.PIVOTS
    apex, m = simplex.apexes(x), x[::40]
    true = np.array([c.squares(x, y) for y in m]).T
    flat = ((apex[:, None, :-1] - simplex.apexes(m)[None, :, :-1]) ** 2).sum(axis=2)
    height = apex[:, -1:], simplex.apexes(m)[None, :, -1]
    assert (flat + (height[0] - height[1]) ** 2 <= true * (1 + 1e-9) + 1).all() and (true <= (flat + (height[0] + height[1]) ** 2) * (1 + 1e-9) + 1).all()
    own, far = c.nearest(x, apex, m, simplex)
    assert (far == true.min(axis=1)).all() and (own == true.argmin(axis=1)).all()
    if spread < 1:
        assert c.possible(apex, simplex.apexes(m)).mean() < 0.3
