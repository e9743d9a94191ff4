"""Approximate nearest neighbours by inner product: few stable projections, a kd-tree over them, a chi-square stopping test.

Vectors get one more coordinate so that all have the norm of the longest; then the largest inner product with a query is the
smallest Euclidean distance d to the query scaled to that norm. m Gaussian projections turn d into a projected distance whose
square is d**2 times a chi-square variable of m degrees. A kd-tree over the projections, its splits fitted on a bounded
sample, deals all vectors out to cells. A query goes to the cells in order of their projected distance: first to the
nearest few, whose vectors are verified in the original space and give the k-th best distance so far; then to some more and
at last to all cells that hold a point closer than that with a chance above 1 - confidence by the chi-square test. In a cell the
same test is put to each vector by its own projected distance: only those that pass are verified, the others are left out.
Queries and cells meet in blocks of bounded size by a join on the cell. The number of cells grows with the table; only the
boxes of at most 2 ** DEPTH cells and the projections of at most 2 ** SAMPLE_BITS rows go through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.llm.base import cut

#: Projections, least chance to find each neighbour, rows wanted in a cell, most cells (2 ** DEPTH), rows of a block, queries
#: of a block.
PROJECTIONS, CONFIDENCE, CELL, DEPTH, BLOCK, QUERIES = 8, 0.9, 512, 16, 2_048, 4_096
#: The tree is fitted on a sample of SAMPLE rows or 16 a cell, whichever is more: at most 2 ** SAMPLE_BITS, 64 MB of projections.
SAMPLE, SAMPLE_BITS = 16_384, 20
#: Rows to verify in the first and up to the second round; the third takes all that the test leaves.
ROUNDS = (400, 4_000)
SEED = 7


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile for an even number m of degrees: the distribution is a finite sum then; found by halving."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def fit_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and split of each inner node of a whole binary tree, by the median of the widest axis; node i has 2i+1, 2i+2."""
    axes, splits = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    parts = [points]
    for node in range(2**depth - 1):
        own = parts[node]
        if len(own):
            axes[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            splits[node] = np.median(own[:, axes[node]])
        low = own[:, axes[node]] <= splits[node]
        parts += [own[low], own[~low]]
        parts[node] = own[:0]
    return axes, splits


def cells_of(points: np.ndarray, axes: np.ndarray, splits: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for _ in range(depth):
        node = 2 * node + 2 - (points[np.arange(len(points)), axes[node]] <= splits[node])
    return node - (2**depth - 1)


def count_verified(n: int) -> None:
    """Called with the vectors that a query was held against in a block; tests put an accumulator here."""


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part: not null, without null or non-finite components, not zero, of
    the most frequent length (of the smallest such, if several)."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("v") == (size["n"] if size else -1))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width) if len(column) else np.zeros((0, width))


def search(vectors: DataFrame, is_query: str, k: int = 20, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query among all vectors but itself.

    vectors: vec_id and embedding (of rows that repeat a vec_id, the smallest array counts and the others don't); is_query: an SQL condition on vec_id. score is the inner product in double
    precision on the original vectors; ties go to the smaller vec_id. Fewer than k candidates are all returned; without any,
    a query has no rows. Vectors that usable() leaves out are neither queries nor candidates. The first round looks at
    enough cells to verify k rows at least, so a query always gets k neighbours if there are k.
    """
    spark = vectors.sparkSession
    v = usable(vectors)
    if not v.groupBy("vec_id").count().where("count > 1").isEmpty():
        v = v.groupBy("vec_id").agg(F.min("v").alias("v"))
    norms = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top = v.agg(F.max(norms).alias("m"), F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not top["n"]:
        return spark.createDataFrame([], schema)
    counted = count_verified
    n, d, longest = top["n"], top["d"], math.sqrt(top["m"])
    depth = min(DEPTH, max(0, math.ceil(math.log2(n / CELL))))
    axis = np.random.default_rng(SEED).standard_normal((d + 1, PROJECTIONS))

    def project(x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
        return x @ axis[:d] + more[:, None] * axis[d]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(project(_matrix(b.column(1), d))), pa.list_(pa.float64()))], names=["vec_id", "p"])

    wanted = min(2**SAMPLE_BITS, max(SAMPLE, 16 * 2**depth))
    mark = F.xxhash64("vec_id", F.lit(SEED))
    some = v.where(F.pmod(mark, F.lit(1 << 30)) < F.lit(math.ceil(min(1.0, 1.2 * wanted / n) * (1 << 30))))
    sample = some.orderBy(mark, "vec_id").limit(wanted).mapInArrow(projected, "vec_id bigint, p array<double>").toPandas()
    axes, splits = fit_tree(np.stack(sample["p"].to_numpy()), depth)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = project(_matrix(b.column(1), d))
            cell = cells_of(p, axes, splits, depth)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(p), pa.list_(pa.float64())), pa.array(cell, pa.int64())], names=["vec_id", "v", "p", "cell"])

    data = cut(v.mapInArrow(assign, "vec_id bigint, v array<double>, p array<double>, cell bigint"))
    ends = [f(F.col("p")[i]).alias(f"{name}{i}") for i in range(PROJECTIONS) for name, f in (("low", F.min), ("high", F.max))]
    boxes = data.groupBy("cell").agg(F.count("*").alias("n"), *ends).orderBy("cell").toPandas()  # at most 2 ** DEPTH rows
    low, high = (boxes[[f"{name}{i}" for i in range(PROJECTIONS)]].to_numpy() for name in ("low", "high"))
    ids, rows = boxes["cell"].to_numpy(), boxes["n"].to_numpy()
    blocks = np.maximum(1, -(-rows // BLOCK))
    test = chi_square_quantile(confidence, PROJECTIONS)
    # Cells of more than one block, for a join: at most 2 ** DEPTH rows.
    split = spark.createDataFrame([(int(c), int(t)) for c, t in zip(ids, blocks) if t > 1], "cell bigint, blocks bigint")
    step = max(1, 2**20 // len(ids))  # queries that are held against all boxes at once

    def reach(worst: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Square of the projected distance beyond which the test leaves points out, by the k-th best product so far."""
        return test * np.maximum(2 * longest**2 - 2 * longest * worst / size, 0)

    def plan(number: int):
        """Cells to visit for each query: the nearest by rows, then further ones as long as the test doesn't rule them out."""
        begin = 0 if number == 0 else max(ROUNDS[number - 1], k + 1)
        end = max(ROUNDS[number], k + 1) if number < len(ROUNDS) else n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, min(step, 256)):
                    part = b.slice(at, min(step, 256))
                    q = _matrix(part.column(1), d)
                    size = np.sqrt((q * q).sum(axis=1))
                    p = (q * (longest / size)[:, None]) @ axis[:d]
                    gap = np.zeros((len(q), len(ids)))
                    for a in range(PROJECTIONS):
                        beside = np.maximum(np.maximum(low[None, :, a] - p[:, a, None], p[:, a, None] - high[None, :, a]), 0)
                        gap += beside * beside
                    order = np.argsort(gap, axis=1, kind="stable")
                    have = np.cumsum(rows[order], axis=1)
                    nearer = np.zeros(gap.shape, np.int64)  # rows in the cells before each
                    np.put_along_axis(nearer, order, have - rows[order], axis=1)
                    worst = np.asarray(part.column(2)).astype(float)
                    visit = (nearer >= begin) & (nearer < end)
                    if number:
                        visit &= gap <= reach(worst, size)[:, None]
                    i, c = np.nonzero(visit)
                    times = blocks[c]
                    i, c = np.repeat(i, times), np.repeat(c, times)
                    block = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(worst[i]), pa.array(ids[c]), pa.array(block, pa.int64())], names=["query_id", "q", "worst", "cell", "block"])

        return run

    def verify(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Exact inner products of a block's vectors with its queries, of those that the test leaves; of each query the best k
        that reach its worst so far."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            x, x_id = _matrix(right.column("v").combine_chunks(), d), right.column("vec_id").to_numpy()
            place = project(x)
            length = (place * place).sum(axis=1)
            slack = 1e-9 * longest**2  # distances by products are rounded; points at the edge stay in
            for at in range(0, left.num_rows, 512):
                part = left.slice(at, 512)
                q, q_id, worst = _matrix(part.column("q").combine_chunks(), d), part.column("query_id").to_numpy(), part.column("worst").to_numpy()
                size = np.sqrt((q * q).sum(axis=1))
                p = (q * (longest / size)[:, None]) @ axis[:d]
                far = (p * p).sum(axis=1)[:, None] + length[None] - 2 * (p @ place.T)
                near = (far <= (reach(worst, size) + slack)[:, None]) & (q_id[:, None] != x_id[None, :])
                for i in range(len(q)):
                    c = np.flatnonzero(near[i])
                    if not len(c):
                        continue
                    counted(len(c))
                    about = x[c] @ q[i]
                    kth = np.partition(about, -k)[-k] if len(c) > k else -np.inf
                    c = c[about >= max(kth, worst[i]) - 1e-10 * longest * size[i]]  # this product rounds differently; ties stay in
                    score = (x[c] * q[i]).sum(axis=1)
                    best = np.lexsort((x_id[c], -score))[:k]
                    out.append((np.full(len(best), q_id[i]), x_id[c][best], score[best]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    def visit(queries: DataFrame, number: int) -> DataFrame:
        due = queries.select("query_id", "q", "worst").mapInArrow(plan(number), "query_id bigint, q array<double>, worst double, cell bigint, block bigint")
        due = due.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(asked / QUERIES)))))
        parts = due.select(F.col("cell").alias("of_cell"), F.col("block").alias("of_block"), F.col("part").alias("of_part")).distinct()
        mine = data.join(F.broadcast(split), "cell", "left")
        mine = mine.withColumn("block", F.pmod(mark, F.coalesce("blocks", F.lit(1))))
        mine = mine.join(parts, (F.col("cell") == F.col("of_cell")) & (F.col("block") == F.col("of_block"))).select("vec_id", "v", "of_cell", "of_block", "of_part")
        return due.groupBy("cell", "block", "part").cogroup(mine.groupBy("of_cell", "of_block", "of_part")).applyInArrow(verify, "query_id bigint, vec_id bigint, score double")

    def best(found: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    queries = data.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = queries.count()
    found = cut(best(visit(queries.withColumn("worst", F.lit(float("-inf"))), 0)))
    for number in range(1, len(ROUNDS) + 1):
        worst = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("worst"))
        more = visit(queries.join(worst, "query_id", "left").fillna(float("-inf"), ["worst"]), number)
        found = best(found.drop("rank").unionByName(more))
        found = cut(found) if number < len(ROUNDS) else found
    return found.select("query_id", "rank", "vec_id", "score")
