"""From raw documents to token ids: five stages, each written as Parquet and read again before the next.

Every stage but the last returns the columns of documents. Quality: rows above their language's perplexity threshold go.
Near duplicates (five-word shingles, similarity 0.8): one document of each group stays. Personal data: spans are replaced by
their kind, n_chars follows. Mixing: rows are repeated or left out so that the sources get their weights. Pieces: the
texts become SentencePiece ids; the last stage returns doc_id, lang, source, n_chars, n_pieces, ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import mixing, near_dedup, pieces, pii, quality
from pagequarry.llm.base import shared_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, words=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = pieces.encode(docs)
    return ids.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("sentence_pieces", to_pieces),
]
#: Perplexity quantiles, signatures and the scan have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each stage's result kept as Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
