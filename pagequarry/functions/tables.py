"""Intermediate tables in the folder that driver and executors share, and rows dealt into ordered blocks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, else spark.checkpoint.dir. A local one is made only where none is set and the driver runs
    the tasks itself; on a cluster that is an error."""
    jvm = spark.sparkContext._jsc.sc()
    if jvm.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not jvm.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return jvm.getCheckpointDir().get()


def new_path(spark: SparkSession, what: str = "files") -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: what is lost with an executor needn't be computed again."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks_in_order(df: DataFrame, order: list[str], rows: int, name: str = "block") -> DataFrame:
    """df with the number of a block: about `rows` rows that follow each other in the given order, all of a block's before those of
    the next. Rows that agree in order may fall into two blocks, so that a run of them is spread as well. Kept as a table."""
    n = max(1, -(-df.count() // rows))
    tie = "_tie" + uuid.uuid4().hex[:8]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *order, tie)
    return keep(dealt.withColumn(name, F.spark_partition_id()).drop(tie))
