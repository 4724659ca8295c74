"""Typed response-event streams with Structured Streaming.

Sources are file streams (Parquet tables or JSON lines) so that a run is replayable from its
checkpoint after executor or driver loss.  Sinks use ``foreachBatch`` and write each
micro-batch to its own ``batch=<id>`` folder with overwrite, so re-running a batch after a
failure replaces its output instead of duplicating it.

* ``route_events``: split by event type; one write per micro-batch covers every branch
  (the branch is a partition column).
* ``response_text``: the deltas of a response joined in order when the response is completed; the state
  of a response is dropped then.
* ``url_citations`` / ``pending_calls``: stateless parsing of finished output items.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.ground import decode_citation_ref
from kestrel.session import scratch_path

# Event and item type names of the response stream.
EVENT_ITEM_DONE = "response.output_item.done"
EVENT_TEXT_DELTA = "response.output_text.delta"
EVENT_COMPLETED = "response.completed"
ITEM_MESSAGE = "message"
ITEM_FUNCTION_CALL = "function_call"
PART_OUTPUT_TEXT = "output_text"
ANNOTATION_URL = "url_citation"
SEARCH_TOOL = "search_knowledge_base"

EVENT_SCHEMA = """
  type string, response_id bigint, delta string, user_input string,
  item struct<
    type: string, call_id: string, name: string, arguments: string,
    content: array<struct<
      type: string, text: string,
      annotations: array<struct<type: string, url: string, title: string, start_index: int, end_index: int>>>>>
"""


def ntz_to_event_time(col: Column) -> Column:
    """``TIMESTAMP_NTZ`` -> ``TIMESTAMP`` whose UTC rendering equals the wall clock (independent of
    the session time zone), so event-time windows align with calendar days."""
    return F.from_utc_timestamp(col.cast("timestamp"), F.current_timezone())


def run_to_completion(
    stream: DataFrame,
    name: str,
    output_mode: str = "append",
    partition_by: list[str] | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run a streaming frame over everything available now (``availableNow`` trigger), writing each
    micro-batch idempotently under the shared scratch folder; return the written rows as a batch frame."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")

    def write_batch(batch_df: DataFrame, batch_id: int) -> None:
        b = transform(batch_df) if transform else batch_df
        w = b.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{out}/batch={batch_id}")

    q = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", ckpt)
        .foreachBatch(write_batch)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    schema = transform(stream).schema if transform else stream.schema
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):  # no micro-batch was written
        return spark.createDataFrame([], schema)
    done = spark.read.schema(schema).option("basePath", out).option("recursiveFileLookup", not partition_by).parquet(out)
    return done.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def table_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A file stream over a Parquet table: a folder of part files, or a single file (whose folder is watched
    for files of that name).  A path that does not exist raises."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def json_event_stream(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """A stream of JSON-lines events parsed with ``from_json`` (malformed lines -> null fields)."""
    raw = spark.readStream.format("text").load(folder)
    return raw.select(F.from_json("value", schema).alias("e")).select("e.*")


def route_events(events: DataFrame, type_col: str, routes: dict[str, str], default: str = "other") -> DataFrame:
    """Add a ``branch`` column from ``routes`` (event type -> branch), unknown types -> ``default``."""
    branch = F.lit(default)
    for t, b in reversed(list(routes.items())):
        branch = F.when(F.col(type_col) == t, F.lit(b)).otherwise(branch)
    return events.withColumn("branch", branch)


def response_text(events: DataFrame, key: str, seq_col: str, type_col: str = "type", delta_col: str = "delta") -> DataFrame:
    """Per response: ``key, n_deltas, text``, once its ``response.completed`` event has come.

    Text deltas are joined by their sequence number, in whatever order and micro-batch they arrive; events of
    other types, and a delta that comes twice, change nothing.  The completed event's sequence number
    tells how many come before it, so a late delta is waited for.  State is kept per response, as its deltas so
    far, and dropped when the response is emitted; a response is one generation, which bounds it.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    key_type = events.schema[key].dataType.simpleString()
    slim = events.where(F.col(type_col).isin(EVENT_TEXT_DELTA, EVENT_COMPLETED)).select(
        F.col(key).alias("key"), F.col(seq_col).cast("long").alias("seq"), (F.col(type_col) == EVENT_COMPLETED).alias("completed"), F.col(delta_col).alias("delta")
    )

    def gather(group, batches, state: GroupState):
        parts, total = ({}, None)
        if state.exists:
            seqs, texts, total = state.get
            parts = dict(zip(seqs, texts))
        for b in batches:
            for seq, completed, delta in zip(b["seq"], b["completed"], b["delta"]):
                if completed:
                    total = int(seq)
                else:
                    parts[int(seq)] = delta or ""
        if total is not None and len(parts) >= total:
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [group[0]], "n_deltas": [len(parts)], "text": ["".join(parts[i] for i in sorted(parts))]})
        else:
            state.update((list(parts), list(parts.values()), total))

    return slim.groupBy("key").applyInPandasWithState(
        gather, f"{key} {key_type}, n_deltas long, text string", "seqs array<long>, texts array<string>, total long", "append", GroupStateTimeout.NoTimeout
    )


def url_citations(events: DataFrame) -> DataFrame:
    """Finished message items -> last content part (if output text) -> its ``url_citation`` annotations."""
    done = events.where((F.col("type") == EVENT_ITEM_DONE) & (F.col("item.type") == ITEM_MESSAGE))
    last = F.try_element_at(F.col("item.content"), F.lit(-1))
    parts = done.select("response_id", last.alias("last")).where(F.col("last.type") == PART_OUTPUT_TEXT)
    ann = parts.select("response_id", F.posexplode(F.coalesce(F.col("last.annotations"), F.array())).alias("pos", "a"))
    return ann.where(F.col("a.type") == ANNOTATION_URL).select(
        "response_id", "pos", F.col("a.url").alias("url"), F.col("a.start_index").alias("start_index"), F.col("a.end_index").alias("end_index")
    )


def cited_pages(events: DataFrame) -> DataFrame:
    """URL citations of finished messages with what a citation reference stands for: ``source_url`` and ``page``
    of a reference, the URL itself (and no page) of an ordinary address, null for anything else."""
    cites = url_citations(events)
    source, page = decode_citation_ref(F.col("url"))
    plain = F.when(F.col("url").rlike("^https?://"), F.col("url"))
    return cites.select("response_id", "pos", "url", F.coalesce(source, plain).alias("source_url"), page.alias("page"))


def pending_calls(events: DataFrame, tool_name: str = SEARCH_TOOL) -> DataFrame:
    """Finished ``function_call`` items -> ``(response_id, call_id, name, arguments, query, error)``.

    The query is the ``query`` argument, null if that is null; the user input stands in when the arguments are
    empty or hold no such key.  A call to another tool, or arguments that are not a JSON object, give an
    error JSON instead of a query.
    """
    calls = events.where((F.col("type") == EVENT_ITEM_DONE) & (F.col("item.type") == ITEM_FUNCTION_CALL))
    args = F.coalesce(F.col("item.arguments"), F.lit(""))
    keys = F.json_object_keys(args)  # null for anything but a JSON object
    known, blank = F.col("item.name").eqNullSafe(tool_name), F.trim(args) == ""
    bad = ~blank & (keys.isNull() | F.try_parse_json(args).isNull())
    q = F.when(blank | ~F.coalesce(F.array_contains(keys, "query"), F.lit(False)), F.col("user_input")).otherwise(F.get_json_object(args, "$.query"))
    message = F.when(~known, F.concat(F.lit("unknown tool "), F.coalesce(F.col("item.name"), F.lit("null")))).when(bad, F.lit("arguments are not a JSON object"))
    return calls.select(
        "response_id",
        F.col("item.call_id").alias("call_id"),
        F.col("item.name").alias("name"),
        F.col("item.arguments").alias("arguments"),
        F.when(message.isNull(), q).alias("query"),
        F.when(message.isNotNull(), F.to_json(F.struct(message.alias("error")))).alias("error"),
    )
