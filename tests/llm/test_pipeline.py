"""Every stage of the pipeline, on what the stage before kept, against plain Python; run() against the chain of stages."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagequarry.llm import mixing, pieces, pii, quality
from pagequarry.llm.base import n_spaced_words, table
from tests.conftest import DATA
from tests.llm.test_table_operators import brute_components


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage is given, and the last one's result, as tables."""
    out, docs = [table(spark, DATA, "documents")], table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality_stage(spark, stages):
    kept = {r.doc_id for r in quality.classify(stages[0], table(spark, DATA, "labels")).where("kept").collect()}
    assert rows(stages[1]) == rows(stages[0].where(F.col("doc_id").isin(list(kept)))) and 0 < len(kept) < stages[0].count()
    good = {r.doc_id for r in table(spark, DATA, "labels").where("quality = 1 and toxic = 0").collect()}
    assert len(kept & good) >= 0.95 * len(good)  # what is rejected is measured on more labels in test_quality_held_out


def test_near_duplicate_stage(stages):
    given = stages[1].collect()
    first = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in given], 5, 80).items() if i == c}
    assert rows(stages[2]) == sorted((tuple(r) for r in given if r.doc_id in first), key=repr) and len(first) < len(given)


def test_personal_data_stage(stages):
    given = {r.doc_id: r for r in stages[2].collect()}
    spans = {r.doc_id: [(k.split(":")[0], int(k.split(":")[1]), int(k.split(":")[2])) for k in r.spans.split(",") if k] for r in pii.pii_digest(stages[2]).collect()}
    done = {r.doc_id: r for r in stages[3].collect()}
    assert set(done) == set(given) and any(spans.values())
    for i, old in given.items():
        at, want = 0, ""
        for kind, s, e in sorted(spans[i], key=lambda x: (x[1], -x[2], pii.KINDS.index(x[0]))):
            want += old.text[at:s] + f"[{kind.upper()}]" if s >= at else ""
            at = max(at, e)
        want = None if old.text is None else want + old.text[at:]
        assert (done[i].text, done[i].lang, done[i].source) == (want, old.lang, old.source) and (want is None or done[i].n_chars == len(want))


def test_mixing_stage(stages):
    given, taken = Counter(map(tuple, stages[3].collect())), Counter(map(tuple, stages[4].collect()))
    assert all(row in given and n <= 3 * given[row] for row, n in taken.items())
    size = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(n_spaced_words(F.col("text"))).alias("n")).collect()}
    largest = {r.source: r.n for r in stages[3].groupBy("source").agg(F.max(n_spaced_words(F.col("text"))).alias("n")).collect()}
    target = {r.source: r.target for r in stages[3].select("source", n_spaced_words(F.col("text")).alias("size")).transform(mixing.source_targets).selectExpr("substring(skey, 2) AS source", "target").collect()}
    for source, n in size(stages[4]).items():
        assert abs(n - target[source]) <= largest[source]


def test_piece_stage(stages):
    lib = pieces.Coder(pieces.model_path()).sp
    want = Counter((r.doc_id, r.lang, r.source, r.n_chars, tuple(lib.encode(r.text or ""))) for r in stages[4].collect())
    assert Counter((r.doc_id, r.lang, r.source, r.n_chars, tuple(r.ids)) for r in stages[5].collect()) == want
    assert stages[5].where("n_pieces <> size(ids)").count() == 0


def test_run_is_the_chain(spark, stages):
    assert rows(corpus_pipeline.run(spark, DATA)) == rows(stages[5])
