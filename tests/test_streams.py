"""Streams equal their batch counterparts."""

import pytest

from kestrel.session import scratch_path
from kestrel.streaming import events as E
from tests.conftest import SF_SMALL


def test_router_stream_equals_batch(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    routes = {"click": "delta", "error": "error"}
    stream = E.route_events(E.table_stream(spark, f"{SF_SMALL}/events.parquet", schema), "event_type", routes).select("branch", "event_id")
    got = sorted(tuple(r) for r in E.run_to_completion(stream, "t-router", partition_by=["branch"]).collect())
    batch = E.route_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"), "event_type", routes).select("branch", "event_id")
    assert got == sorted(tuple(r) for r in batch.collect())


def test_a_folder_of_part_files_is_a_stream(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    path = scratch_path(spark, "t-folder")
    ev.repartition(3).write.parquet(path)
    stream = E.route_events(E.table_stream(spark, path, ev.schema, files_per_batch=1), "event_type", {}).select("event_id")
    assert E.run_to_completion(stream, "t-folder").count() == ev.count()


def test_a_stream_without_files_gives_no_rows_and_a_missing_folder_is_an_error(spark):
    schema = "type string, response_id long, seq long, delta string"
    path = scratch_path(spark, "t-none")
    spark.createDataFrame([], schema).write.parquet(path)
    got = E.run_to_completion(E.response_text(E.table_stream(spark, path, spark.read.parquet(path).schema), "response_id", "seq"), "t-none")
    assert got.count() == 0 and got.columns == ["response_id", "n_deltas", "text"]
    with pytest.raises(Exception):
        E.run_to_completion(E.table_stream(spark, path + "-missing", schema), "t-missing")


def test_response_text_waits_for_the_completed_event_and_for_late_deltas(spark):
    d, done = E.EVENT_TEXT_DELTA, E.EVENT_COMPLETED
    batches = [
        [(d, 1, 1, "b"), (d, 2, 0, "x"), (done, 1, 3, None), ("response.other", 1, 9, "?")],
        [(d, 1, 0, "a"), (d, 1, 1, "b"), (d, 3, 0, "open")],  # one delta comes twice
        [(d, 1, 2, None), (done, 2, 1, None), (done, 4, 0, None)],
    ]
    path, schema = scratch_path(spark, "t-deltas"), "type string, response_id long, seq long, delta string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = E.table_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    got = {r["response_id"]: (r["n_deltas"], r["text"]) for r in E.run_to_completion(E.response_text(stream, "response_id", "seq"), "t-deltas").collect()}
    assert got == {1: (3, "ab"), 2: (1, "x"), 4: (0, "")}  # response 3 is still open
