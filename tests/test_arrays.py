"""Array folds against plain Python."""

import time

from pyspark.sql import functions as F

from pagequarry.functions import arrays


def test_fold_append(spark):
    rows = [(i, list(range(i % 37))) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, x array<long>")
    rising = lambda s, v: (F.greatest(s, v), F.when(v % 3 == 0, F.array(v)).otherwise(F.array().cast("array<bigint>")))
    got = df.select("i", "x", arrays.sums_before(F.col("x")).alias("sums"), arrays.fold_append(F.col("x"), F.lit(0).cast("long"), rising, "bigint").alias("thirds")).collect()
    for r in got:
        if r.x:
            assert r.sums == [sum(r.x[:k]) for k in range(len(r.x))] and r.thirds == [v for v in r.x if v % 3 == 0]
        else:
            assert not r.sums and not r.thirds


def test_long_arrays_take_little_time(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(100_000)).cast("array<long>").alias("x"))
    at = time.time()
    assert df.select(F.size(arrays.sums_before(F.col("x"))).alias("n")).first().n == 100_000
    assert time.time() - at < 30
