"""Shared helpers: tables, lineage cuts and word patterns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which a join spreads them by a salt, and the number of salts.
HOT, SALTS = 1 << 14, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the license contract, after ASCII lower-casing; and words split at ASCII white space.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir. A local one is set only where none is and
    the driver runs the tasks itself (spark.master local); on a cluster that is an error."""
    jvm = spark.sparkContext._jsc.sc()
    if jvm.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not jvm.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return jvm.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: what is lost with an executor needn't be computed again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: smaller than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """rows joined ("inner" or "left") with table, which has one row per keys; the columns of rows, then those of table.

    Keys with over HOT rows are joined by keys and a salt of the column by, so that no task gets all rows of one key. heavy:
    those keys, if they are known; else they are counted. Rows with a null key find nothing.
    """
    if heavy is None:
        heavy = rows.groupBy(*keys).agg(F.count("*").alias("n rows")).where(F.col("n rows") > HOT)
    found = cut(table.join(heavy.select(*keys), keys, "left_semi"))
    own, new = [F.col(f"`{c}`") for c in rows.columns], [F.col(f"`{c}`") for c in table.columns if c not in keys]
    if found.isEmpty():
        return rows.join(table, keys, how).select(*own, *new)
    copies = found.select("*", F.lit(True).alias("is heavy"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt of row"))
    salted = rows.withColumn("salt of row", F.pmod(F.xxhash64(by, F.lit(1)), F.lit(SALTS)).cast("int")).join(copies, [*keys, "salt of row"], "left")
    return salted.where("`is heavy`").select(*own, *new).unionByName(salted.where("`is heavy` is null").select(*own).join(table, keys, how).select(*own, *new))


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go at its end, whatever the driver still refers to. For phases of which only
    checkpoints and tables are used on; a frame that is run twice makes them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files stay on the executors' disks until the driver's JVM collects the frames that they belong to, which may take
    the whole query. After a phase of which only checkpoints and tables are used on, this has them deleted at once."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)  # Py4J lets go of what Python has collected in a thread of its own
        spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns a Python worker's freed memory to the system. Spark uses its workers again, and the C library (glibc; others have
    no such call) keeps most of what is freed, so an executor would go on holding what its largest tasks took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def unused(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column (upper and lower case count as equal, as in Spark)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_row(df: DataFrame) -> Column:
    """All columns of df in one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_columns(df: DataFrame, row: str) -> list[Column]:
    """df's columns again, from the struct named row."""
    return [F.col(row).getField(c).alias(c) for c in df.columns]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else (lower() would change other letters too)."""
    return F.translate(c, UPPER, LOWER)


def n_spaced_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null: 0. One pass, without an array of the words."""
    gone = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.length(F.translate(gone, "\t\n\x0b\x0c\r ", "")).cast("long")
