"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model trained on trusted text.

The model is over six-grams of whole bytes and grows with the corpus; byte_grams keeps its counts sharded and joins them with
blocks of documents. They are taken over every trusted document. A document is kept if its perplexity is at most its
language's threshold: a quantile over the trusted documents of that language, each scored by a model that wasn't trained on
it, times a margin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import byte_grams
from pagequarry.llm.base import cut, free_shuffles, keep, short_shuffles

#: Quantile of the trusted documents' perplexity, and the margin by which a document may exceed it; trusted documents that a
#: threshold needs; ids and languages that are sent to every task, at most (beyond that they are joined by a shuffle).
QUANTILE, MARGIN, MIN_TRUSTED, MAX_IDS, MAX_LANGUAGES = 0.995, 1.15, 20, 2_000_000, 10_000
#: Short texts vary more, so each language has a threshold for texts of fewer than 100, fewer than 400, and more six-grams.
LENGTHS = (100, 400)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, text of the documents labelled as good, and not as toxic if labels has that column. The ids go to the tasks while
    they are few (16 MB at most, by count); beyond that the texts are joined by a shuffle. A label given twice counts once."""
    good = F.col("quality") == 1
    if "toxic" in labels.columns:
        good &= F.coalesce(F.col("toxic"), F.lit(0)) == 0
    ids = labels.where(good).select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    few = ids.limit(MAX_IDS + 1).count() <= MAX_IDS
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("lang", "text")
    return texts if few else keep(texts)  # what a shuffle gives comes in another order when it is made again


@dataclass(frozen=True)
class Model:
    """Sharded counts; per language (null: all others) the largest perplexity that is kept, by length class; bytes of all texts."""

    counts: byte_grams.Model
    limits: DataFrame
    size: int


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model trained on all trusted texts, with its thresholds.

    A text that a model was trained on seems more likely to it than it is. So the trusted texts are also dealt to two folds
    by their content, and the perplexities that the thresholds come from are given by the model of the other fold. Without
    trusted texts every n-gram costs the same and nothing is rejected.
    """
    bytes_of = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")
    size = docs.agg(bytes_of).first()["n"]
    with short_shuffles(docs.sparkSession):  # the counts, and the trusted texts' blocks and messages
        trusted = trusted_texts(docs, labels).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
        known = trusted.agg(bytes_of).first()["n"]
        counts = byte_grams.train(trusted.coalesce(max(1, -(-known // byte_grams.COUNTED))))
        limits = thresholds(byte_grams.perplexity(trusted, counts, "fold", known).select("lang", "n_grams", "perplexity"))
    del trusted
    free_shuffles(docs.sparkSession)  # checkpoints
    return Model(counts, limits, size)


def length_class(n: Column) -> Column:
    return F.when(n < LENGTHS[0], 0).when(n < LENGTHS[1], 1).otherwise(2)


def thresholds(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """for_lang (null: all that have no row), most: array of the largest perplexity that is kept, by length class; from trusted
    documents (lang, n_grams, perplexity).

    A class with fewer than 20 trusted documents of its language takes the language's threshold, then the length's, then the
    common one; without trusted documents nothing is rejected. A language with fewer than 20 has no row.
    """
    good = scored.select(F.coalesce("lang", F.lit("")).alias("lang"), length_class(F.col("n_grams")).alias("size"), "perplexity")
    q = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    sets = good.groupingSets([["lang", "size"], ["lang"], ["size"], []], "lang", "size").agg(F.when(F.count("*") >= MIN_TRUSTED, q * margin).alias("q"))
    by = cut(sets.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("size", F.lit(-1)).alias("s"), "q"))).alias("by")))
    common = by.where("lang is null").agg(F.first("by").alias("all"))  # one row, also of an empty table
    resolved = lambda *maps: F.array(*[F.coalesce(*[F.try_element_at(m, F.lit(k)) for m in maps for k in (s, -1)][:2], *[F.try_element_at(maps[-1], F.lit(k)) for k in (s, -1)], F.lit(float("inf"))) for s in (0, 1, 2)]).alias("most")
    own = by.where("lang is not null").join(F.broadcast(common)).where(F.try_element_at("by", F.lit(-1)).isNotNull()).select(F.col("lang").alias("for_lang"), resolved(F.col("by"), F.col("all")))
    return cut(own.unionByName(common.select(F.lit(None).cast("string").alias("for_lang"), resolved(F.col("all")))))


def with_threshold(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """scored (lang, n_grams, ...) with the threshold of each row."""
    rest = limits.where("for_lang is null").first()["most"]
    own = limits.where("for_lang is not null")
    own = F.broadcast(own) if own.limit(MAX_LANGUAGES + 1).count() <= MAX_LANGUAGES else own
    joined = scored.join(own, F.coalesce("lang", F.lit("")) == F.col("for_lang"), "left")
    most = F.coalesce("most", F.array(*[F.lit(x) for x in rest]))
    return joined.select(*[scored[f"`{c}`"] for c in scored.columns], F.element_at(most, length_class(F.col("n_grams")) + 1).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_grams, perplexity, threshold, kept for every row of docs.

    Null texts count as empty: one six-gram of edges only. Empty documents have the model's perplexity of an empty text.
    Repeated rows are scored each by itself; extra columns are ignored; labels of unknown documents too.
    """
    model = fit(docs, labels)
    scored = byte_grams.perplexity(docs.select("doc_id", "lang", "text"), model.counts, size=model.size).drop("text")
    return with_threshold(scored, model.limits).withColumn("kept", F.col("perplexity") <= F.col("threshold"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns, whatever their names. Each text is shuffled once, to
    its block."""
    model = fit(docs, labels)
    both = docs.select("lang", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("all"))
    scored = with_threshold(byte_grams.perplexity(both, model.counts, size=model.size), model.limits)
    kept = scored.where(F.col("perplexity") <= F.col("threshold"))
    return kept.select(*[F.col("text") if c == "text" else F.col("all").getField(c).alias(c) for c in docs.columns])
