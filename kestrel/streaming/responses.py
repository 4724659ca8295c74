"""Response streams whose state ends: event-time timers, and calls matched with their outputs.

Both need event times and a watermark, and neither keeps a response or a call for longer than a stated time past
its last event.  State lies best in the RocksDB state store, outside the executors' heap; ``with_rocksdb`` sets it for the
start of a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kestrel.streaming.events import EVENT_COMPLETED, EVENT_ITEM_DONE, EVENT_TEXT_DELTA, ITEM_FUNCTION_CALL

# Fixed value: item type of a call's output in the response stream.
ITEM_CALL_OUTPUT = "function_call_output"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store for queries started inside; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _above_watermark(condition: Column, time_col: str) -> Column:
    """The condition (for rows with an event time) as one that names the event time: a plain filter would be moved below
    the watermark, and the events it drops would not move the watermark any more."""
    return F.when(condition, F.unix_millis(F.col(time_col))).isNotNull()


#: Groups of responses (by a hash of their key) that share a row of state.
GROUPS = 1024
STATE = "keys array<string>, totals array<long>, dues array<long>, dones array<boolean>, counts array<int>, seqs array<long>, texts array<string>"


def response_gatherer(idle_ms: int, key: str):
    """Per response: its deltas, until it is complete or has been idle for too long.

    A call with its frames, state and timer takes far longer than the work on a response, so one call takes a group of
    responses, with their state in one row and one timer, at the earliest of theirs.  When the completed event and all
    deltas before it have come, the text is emitted and the deltas are dropped; a mark stays until the timer, so events
    that come again do not begin the response anew.  When the timer fires first, what has come is emitted as
    unfinished.  Either way nothing of the response is left afterwards.
    """

    def gather(group, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        held, at_first = {}, 0  # key: [deltas by number, total, due, done]
        if state.exists:
            *each, seqs, texts = state.get
            for k, total, due, done, n in zip(*each):
                held[k] = [dict(zip(seqs[at_first : at_first + n], texts[at_first : at_first + n])), total, due, done]
                at_first += n
        last, out = {}, []
        for part in () if state.hasTimedOut else batches:
            for k, seq, completed, delta, at in zip(*(part[c].tolist() for c in ("key", "seq", "completed", "delta", "at"))):
                k = k if isinstance(k, str) else None
                one = held.setdefault(k, [{}, None, 0, False])
                last[k] = max(last.get(k, 0), int(at))
                if one[3]:
                    continue
                if completed:
                    one[1] = int(seq)
                else:
                    one[0].setdefault(int(seq), delta if isinstance(delta, str) else "")

        def emit(k, completed: bool) -> None:
            parts = held[k][0]
            out.append((k, len(parts), "".join(parts[i] for i in sorted(parts)), completed))

        for k, at in last.items():
            parts, total, due, done = held[k]
            if not done and total is not None and len(parts) >= total:
                emit(k, True)
                parts, done = {}, True
            held[k] = [parts, total, max(at + idle_ms, due), done]
        now = state.getCurrentWatermarkMs()
        for k in [k for k, one in held.items() if one[2] < now]:
            if not held[k][3]:
                emit(k, False)
            del held[k]
        if held:
            parts, *rest = zip(*held.values())
            state.update((list(held), *map(list, rest), [len(p) for p in parts], [i for p in parts for i in p], [t for p in parts for t in p.values()]))
            state.setTimeoutTimestamp(max(1, min(rest[1])))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "n_deltas", "text", "completed"])

    return gather


def response_text_or_timeout(events: DataFrame, key: str, seq_col: str, time_col: str, idle: str = "30 minutes", delay: str = "5 minutes",
                             type_col: str = "type", delta_col: str = "delta") -> DataFrame:
    """Per response: ``key, n_deltas, text, completed``.

    A response is emitted once: complete, when its completed event and all deltas before that have come, in any order;
    or, with ``completed`` false and the deltas that have come, when the watermark (``delay`` behind the
    newest event of any kind) is more than ``idle`` past its last event.  A delta that comes twice counts once; events of
    other types only move the watermark; a completed response without deltas has an empty text.  Start the query
    inside ``with_rocksdb``.
    """
    key_type = events.schema[key].dataType.simpleString()
    marked = events.withWatermark(time_col, delay)
    slim = marked.where(_above_watermark(F.col(type_col).isin(EVENT_TEXT_DELTA, EVENT_COMPLETED), time_col)).select(
        F.col(key).cast("string").alias("key"), F.col(seq_col).cast("long").alias("seq"), (F.col(type_col) == EVENT_COMPLETED).alias("completed"), F.col(delta_col).alias("delta"),
        F.unix_millis(F.col(time_col)).alias("at"), F.col(time_col).alias("event_time"),
    )
    idle_ms = int(events.sparkSession.sql(f"SELECT CAST(unix_millis(timestamp'1970-01-02 00:00:00Z' + INTERVAL {idle}) - unix_millis(timestamp'1970-01-02 00:00:00Z') AS BIGINT) AS ms").first()["ms"])
    found = slim.withColumn("responses", F.pmod(F.xxhash64("key"), F.lit(GROUPS))).groupBy("responses").applyInPandasWithState(
        response_gatherer(idle_ms, key), f"{key} string, n_deltas long, text string, completed boolean", STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select(F.col(key).cast(key_type).alias(key), "n_deltas", "text", "completed")


def unanswered_calls(events: DataFrame, time_col: str, within: str = "10 minutes", delay: str = "5 minutes", answers: DataFrame | None = None) -> DataFrame:
    """Finished function calls without an output ``within`` that time: ``call_id, name, called_at``.

    A left outer join of two streams, calls and call outputs, on the call's id and the time between them.  Answered
    calls leave the state when they meet their output; the others come out when the watermark has passed the bound.
    ``answers`` is the stream of outputs where it is another one (or a second reader of the same events).  A call
    whose id is null or empty cannot be answered and is left out; several outputs of one call count once.
    """
    answers = events if answers is None else answers
    done = F.col("type") == EVENT_ITEM_DONE
    is_call = done & (F.col("item.type") == ITEM_FUNCTION_CALL) & (F.col("item.call_id") != "")
    calls = events.withWatermark(time_col, delay).where(_above_watermark(is_call, time_col))
    calls = calls.select(F.col("item.call_id").alias("call_id"), F.col("item.name").alias("name"), F.col(time_col).alias("called_at"))
    outputs = answers.withWatermark(time_col, delay).where(_above_watermark(done & (F.col("item.type") == ITEM_CALL_OUTPUT), time_col))
    # Never null: the join would otherwise add a filter on it below the watermark, which other events then no longer move.
    outputs = outputs.select(F.coalesce("item.call_id", F.lit("")).alias("answered_id"), F.col(time_col).alias("answered_at"))
    in_time = F.col("answered_at").between(F.col("called_at"), F.col("called_at") + F.expr(f"INTERVAL {within}"))
    joined = calls.join(outputs, (F.col("call_id") == F.col("answered_id")) & in_time, "left_outer")
    return joined.where(F.col("answered_id").isNull()).select("call_id", "name", "called_at")
