"""Session helpers: scratch paths under the checkpoint folder, scan spreading, package shipping."""

from kestrel import session as S
from tests.conftest import SF_SMALL


def test_scratch_paths_live_under_checkpoint_dir(spark):
    base = spark.sparkContext.getCheckpointDir()
    a, b = S.scratch_path(spark, "x"), S.scratch_path(spark, "x")
    assert a.startswith(base) and b.startswith(base) and a != b


def test_small_scans_are_not_spread(spark):
    df = spark.read.parquet(f"{SF_SMALL}/region.parquet")
    assert S.spread(df) is df


def test_sizable_few_partition_scans_are_spread(spark, monkeypatch):
    monkeypatch.setattr(S, "SPREAD_MIN_BYTES", 1)
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = S.spread(df, "doc_id")
    if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert "hashpartitioning(doc_id" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == df.count()


def test_prepare_is_idempotent(spark):
    S.prepare(spark)
    S.prepare(spark)
    assert spark.sparkContext.applicationId in S._SHIPPED
