"""Plan shape: the properties the design relies on at scale, read from the physical plans."""

from pyspark.sql import functions as F

from kestrel.operators import enrich
from kestrel.operators import retrieve as R
from kestrel.plans import fixtures as fx
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_a_partial_window_group_limit(spark):
    plan = _plan(R.keyword_search(fx.chunks(spark, SF_SMALL), fx.benchmark_queries(spark, SF_SMALL, vectors=False), k=5))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_keyword_scores_leave_blocks_bounded(spark):
    cands = R.keyword_candidates(fx.chunks(spark, SF_SMALL), fx.benchmark_queries(spark, SF_SMALL, vectors=False), k=5)
    plan = _plan(cands)
    assert "FlatMapCoGroupsInPandas" in plan
    n_queries = fx.benchmark_queries(spark, SF_SMALL, vectors=False).count()
    n_blocks = cands.sparkSession.range(1).count() * -(-fx.chunks(spark, SF_SMALL).count() // 2048)
    assert cands.count() <= 5 * 5 * n_queries * n_blocks  # a few times k per query and block, not all pairs


def test_knn_never_makes_pairs(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    cands = R.vector_scores(emb, q, k=5, key_col="vec_id", vec_col="embedding")
    plan = _plan(cands)
    assert "FlatMapCoGroupsInPandas" in plan and "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert cands.count() <= 10 * emb.count()


def test_search_function_has_a_group_limit_before_the_shuffle(spark):
    from kestrel.operators import kb_function as KB

    fn = KB.register_search_function(spark, KB.store_inverted_index(spark, fx.chunks(spark, SF_SMALL)))
    plan = _plan(KB.search_with_function(spark, fx.benchmark_queries(spark, SF_SMALL, vectors=False), fn))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_entity_tagging_shuffles_matches_only(spark):
    gaz = spark.createDataFrame([("thble", "thble")], "term string, canonical string")
    plan = _plan(enrich.extract_locations(fx.chunks(spark, SF_SMALL), gaz))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "Python" not in plan


def test_chunking_and_keys_are_narrow(spark):
    plan = _plan(fx.chunks(spark, SF_SMALL))
    assert "Generate posexplode" in plan
    assert "Exchange" not in plan


def test_search_function_sums_scores_where_postings_are_read(spark):
    from kestrel.operators import kb_function as KB

    fn = KB.register_search_function(spark, KB.store_inverted_index(spark, fx.chunks(spark, SF_SMALL)))
    plan = _plan(KB.search_with_function(spark, fx.benchmark_queries(spark, SF_SMALL, vectors=False), fn))
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "chunk_id" in line.split("plan_id")[0]]
    assert any("REPARTITION_BY_NUM" in line for line in dealt)
    assert not any("query_text" in line for line in dealt)  # no exchange by query and chunk
