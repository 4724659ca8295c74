"""Streams whose state ends: responses with timers, calls against their outputs."""

import datetime as dt

from kestrel.session import scratch_path
from kestrel.streaming import events as E
from kestrel.streaming import responses as R

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "type string, response_id long, seq long, delta string, at timestamp"


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def run(spark, batches, idle="30 minutes"):
    path = scratch_path(spark, "t-responses")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    with R.with_rocksdb(spark):
        stream = E.table_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
        out = R.response_text_or_timeout(stream, "response_id", "seq", "at", idle=idle)
        return sorted((tuple(r) for r in E.run_to_completion(out, "t-responses").collect()), key=str)


def test_late_repeated_and_never_completed_responses(spark):
    d, done, other = E.EVENT_TEXT_DELTA, E.EVENT_COMPLETED, "response.in_progress"
    batches = [
        [(d, 1, 1, "b", at(0)), (done, 1, 3, None, at(1)), (d, 2, 0, "x", at(1)), (d, 3, 0, "open", at(1)), (done, 5, 0, None, at(1))],
        [(d, 1, 0, "a", at(2)), (d, 1, 1, "b", at(2)), (d, 1, 2, None, at(2)), (done, 2, 1, None, at(2)), (d, 3, 2, "ed", at(3))],
        [(d, 1, 0, "a", at(4)), (d, 2, 0, "x", at(4)), (d, 4, 0, "still going", at(60))],  # what comes again does not begin a response anew
        [(other, None, None, None, at(90))],
        [(other, None, None, None, at(300))],
        [(other, None, None, None, at(301))],  # the watermark of one batch holds from the next one on
    ]
    assert run(spark, batches) == [(1, 3, "ab", True), (2, 1, "x", True), (3, 2, "opened", False), (4, 1, "still going", False), (5, 0, "", True)]


def test_an_open_response_waits_for_the_watermark(spark):
    d = E.EVENT_TEXT_DELTA
    assert run(spark, [[(d, 1, 0, "x", at(0))], [(d, 2, 0, "y", at(20))]]) == []


def test_state_is_empty_at_the_end(spark):
    d, done, other = E.EVENT_TEXT_DELTA, E.EVENT_COMPLETED, "response.in_progress"
    batches = [[(d, i, 0, "x", at(0)) for i in range(20)] + [(done, i, 1, None, at(1)) for i in range(10)], [(other, None, None, None, at(200))], [(other, None, None, None, at(201))]]
    path, left = scratch_path(spark, "t-state"), []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    with R.with_rocksdb(spark):
        stream = E.table_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
        out = R.response_text_or_timeout(stream, "response_id", "seq", "at")
        q = out.writeStream.outputMode("append").option("checkpointLocation", scratch_path(spark, "t-state-ckpt"))
        q = q.foreachBatch(lambda b, i: left.append(b.count())).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sum(left) == 20
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_calls_against_their_outputs(spark):
    item = "struct<type: string, call_id: string, name: string>"
    schema = f"type string, item {item}, at timestamp"
    call = lambda i, m: (E.EVENT_ITEM_DONE, (E.ITEM_FUNCTION_CALL, i, "search"), at(m))
    answer = lambda i, m: (E.EVENT_ITEM_DONE, (R.ITEM_CALL_OUTPUT, i, None), at(m))
    batches = [
        [call("a", 0), call("b", 0), call("c", 1), call("twice", 1), call(None, 1), answer("a", 2)],
        [answer("twice", 3), answer("twice", 4), answer("stranger", 4), call("late", 5), answer("c", 11), answer("c", 30)],
        [answer("late", 16)],  # a minute beyond the bound
        [("response.in_progress", None, at(120))],
        [("response.in_progress", None, at(121))],
    ]
    path = scratch_path(spark, "t-calls")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    read = lambda: E.table_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    out = R.unanswered_calls(read(), "at", within="10 minutes", answers=read())
    got = E.run_to_completion(out, "t-calls").collect()
    assert sorted(r["call_id"] for r in got) == ["b", "late"]


def test_a_null_key_takes_no_rows_from_others(spark):
    d, done, other = E.EVENT_TEXT_DELTA, E.EVENT_COMPLETED, "response.in_progress"
    ids = [None, *range(40)]
    batches = [
        [(d, i, 0, f"a{i}", at(0)) for i in ids] + [(done, i, 2, None, at(1)) for i in ids if i is None or i % 2],
        [(d, i, 1, "b", at(2)) for i in ids] + [(d, i, 0, "again", at(3)) for i in ids],
        [(other, None, None, None, at(200))],
        [(other, None, None, None, at(201))],
    ]
    assert run(spark, batches) == sorted(((i, 2, f"a{i}b", i is None or i % 2 == 1) for i in ids), key=str)


def test_a_timer_that_the_watermark_has_passed_fires_at_once(spark):
    """The watermark jumps by more than the idle time between the batch that an event is not late for and the next."""
    d, other = E.EVENT_TEXT_DELTA, "response.in_progress"
    batches = [[(d, 1, 0, "x", at(0))], [(other, None, None, None, at(100))], [(d, 2, 0, "y", at(96))], [(other, None, None, None, at(300))], [(other, None, None, None, at(301))]]
    assert run(spark, batches) == [(1, 1, "x", False), (2, 1, "y", False)]
