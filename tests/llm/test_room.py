"""Disk and memory are given back as soon as they aren't needed."""

import re
import time

import numpy as np

from pagequarry.llm import byte_grams, pieces, quality
from pagequarry.llm.base import cut, keep, table
from tests.conftest import DATA


def _shuffled(spark):
    """Bytes of shuffle files on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_fitting_leaves_no_shuffle_files(spark):
    docs = keep(table(spark, DATA, "documents"))
    before = _shuffled(spark)
    model = quality.fit(docs, table(spark, DATA, "labels"))
    until = time.time() + 20
    while _shuffled(spark) > before and time.time() < until:
        time.sleep(0.5)
    assert _shuffled(spark) <= before and model.limits.count() > 1


def test_fitting_frees_shuffle_files_that_the_driver_refers_to(spark, monkeypatch):
    held, name = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    docs, set_before = keep(table(spark, DATA, "documents")), spark.conf.get(name)
    monkeypatch.setattr(quality, "cut", lambda df: (held.append(df), cut(df))[1])
    monkeypatch.setattr(quality, "free_shuffles", lambda spark: None)
    before = _shuffled(spark)
    quality.fit(docs, table(spark, DATA, "labels"))
    until = time.time() + 20
    while _shuffled(spark) > before and time.time() < until:
        time.sleep(0.5)
    assert _shuffled(spark) <= before and held and spark.conf.get(name) == set_before


def test_texts_and_ids_go_to_the_workers_once(spark):
    """Not beside the row that holds them already."""
    encoded = pieces.encode(table(spark, DATA, "documents"))
    for df, column in ((encoded, "text"), (pieces.decode(encoded), "ids")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        sent = [line for line in plan.splitlines() if " AS r#" in line and "Project" in line and " AS doc#" not in line]
        assert sent and all(len(re.findall(rf"\b{column}#\d+", line)) == 1 for line in sent if f"{column}#" in line)


def test_counts_beyond_32_bits_stay_whole():
    values = byte_grams.filled(np.zeros((2, 3), np.int32), np.array([2, 0]), np.array([[7, 8], [9, 1]]))
    assert values.dtype == np.int32 and values.tolist() == [[8, 0, 7], [1, 0, 9]]
    values = byte_grams.filled(values, np.array([1]), np.array([[1 << 40], [3]]))
    assert values.tolist() == [[8, 1 << 40, 7], [1, 3, 9]]
