"""The corpus pipeline: columns, effect of every stage against its operator, whole run against the stages."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel.llm import language_id, line_quality, source_mixing
from kestrel.llm.common import materialize
from tests.conftest import SF_CHECK
from tests.llm.test_packing import check_pieces
from tests.llm.test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], SF_CHECK), f"t-{name}"))
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_all_stages_but_the_last_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "mixing", "packing"]


def test_each_decision_takes_effect(spark, stages):
    docs, known, good, single, mixed, packed = stages
    sure = language_id.identify(docs).filter("lang_pred != 'und' and score >= 0.5")
    assert ids(known) == ids(sure)
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    assert ids(good) == ids(line_quality.score_quality(known, labels).filter("predicted = 1"))
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    comp = plain_components({i: plain_fingerprint(t) for i, t in texts.items()})
    assert ids(single) == Counter(set(comp.values()))
    assert ids(mixed) == Counter({r["doc_id"]: r["count"] for r in source_mixing.mix_sources(single).groupBy("doc_id").count().collect()})
    once = packed.dropDuplicates(["doc_id", "piece"])
    assert Counter(r["doc_id"] for r in packed.filter("piece = 0").collect()) == ids(mixed)
    per_copy = {r["doc_id"]: r["n"] for r in once.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert set(per_copy) == set(ids(mixed))


def test_clean_documents_stay(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    kept = ids(stages[2])
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.05 * sum(q == 0 for q in labels.values())


def test_packing_of_the_mixture(stages):
    from kestrel.llm import packing
    from kestrel.llm.queries import tokenizer

    single = stages[3]
    rows = packing.pack_tightly(single, **tokenizer()).collect()
    check_pieces(rows, {r["doc_id"]: r["text"] for r in single.collect()}, 2048)


def test_run_is_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF_CHECK).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, stages[-1].select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_edge_tables(spark, edge_docs, no_docs):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, no_docs, SF_CHECK).count() == 0, name
        out = f(spark, edge_docs, SF_CHECK)
        assert out.count() > 0, name
        if name != "packing":
            assert out.columns == edge_docs.columns, name
