"""Queries: typed event streams (Structured Streaming, availableNow over file sources)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions.text import html_title
from kestrel.operators.ground import citation_ref
from kestrel.plans import oracle_sql as O
from kestrel.plans.registry import query
from kestrel.session import read_table, scratch_path
from kestrel.streaming import events as E
from kestrel.streaming import responses as R

# Fixed values (test design): event type -> branch of the router.
ROUTES = {"click": "delta", "view": "delta", "purchase": "completed", "error": "error"}
RESPONSE_ID_BASE = 1_000_000


@query(
    "stream_event_router",
    """SELECT CASE event_type WHEN 'click' THEN 'delta' WHEN 'view' THEN 'delta' WHEN 'purchase' THEN 'completed'
                 WHEN 'error' THEN 'error' ELSE 'other' END AS branch, event_id, user_id, event_type FROM events""",
)
def stream_event_router(spark, sf_dir):
    """The events table, rewritten as a folder of part files as large tables are, as a stream split by type
    into branches; one write per micro-batch covers all branches (branch = partition folder)."""
    path = scratch_path(spark, "events-folder")
    events = read_table(spark, sf_dir, "events")
    events.repartition(4).write.parquet(path)
    routed = E.route_events(E.table_stream(spark, path, events.schema, files_per_batch=3), "event_type", ROUTES).select("branch", "event_id", "user_id", "event_type")
    out = E.run_to_completion(routed, "router", partition_by=["branch"])
    return out.select("branch", "event_id", "user_id", "event_type")


@query(
    "stream_delta_concat",
    f"""SELECT conv_id * {RESPONSE_ID_BASE} + turn AS response_id, CAST(ceil(length(text) / 40) AS BIGINT) AS n_deltas, text
FROM conversations WHERE text IS NOT NULL AND length(text) > 0""",
)
def stream_delta_concat(spark, sf_dir):
    """Every conversation turn is a response: its text in deltas of 40 characters, an item event among them,
    and a completed event.  The events lie in hash order over several micro-batches, so deltas arrive out of
    order and partly after the completed event."""
    turns = read_table(spark, sf_dir, "conversations").where(F.length("text") > 0)
    n = F.ceil(F.length("text") / 40).cast("int")
    one = lambda kind, seq, delta: F.struct(F.lit(kind).alias("type"), seq.cast("long").alias("seq"), delta.cast("string").alias("delta"))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(E.EVENT_TEXT_DELTA, i, F.col("text").substr(i * 40 + 1, F.lit(40))))
    closing = F.array(one(E.EVENT_ITEM_DONE, F.lit(0), F.lit(None)), one(E.EVENT_COMPLETED, n, F.lit(None)))
    ev = turns.select((F.col("conv_id") * RESPONSE_ID_BASE + F.col("turn")).alias("response_id"), F.explode(F.concat(parts, closing)).alias("e"))
    path = scratch_path(spark, "delta-events")
    ev.select("response_id", "e.*").repartition(6, F.xxhash64("response_id", "seq", "type")).write.parquet(path)
    stream = E.table_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=2)
    return E.run_to_completion(E.response_text(stream, "response_id", "seq"), "response-text")


def _write_json_events(df, spark, name):
    path = scratch_path(spark, name)
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
    return path


@query(
    "stream_url_citations",
    """SELECT page_id AS response_id, CAST(i AS INTEGER) AS pos, hrefs[i] AS url, CAST((i - 1) * 10 AS INTEGER) AS start_index,
       CAST((i - 1) * 10 + length(hrefs[i]) AS INTEGER) AS end_index
FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS hrefs FROM pages WHERE page_id % 5 <> 0) p,
     LATERAL (SELECT unnest(range(1, len(p.hrefs) + 1)) AS i)""",
)
def stream_url_citations(spark, sf_dir):
    """Each page gives a text delta and a finished message whose output text is annotated with one
    file citation and one URL citation per link of the page; by rule every page with
    ``page_id % 5 = 0`` ends its message with a refusal part (so it yields no citations)."""
    pages = read_table(spark, sf_dir, "pages")
    title = html_title(F.col("html"))
    hrefs = F.regexp_extract_all(F.col("html"), F.lit('<a href="([^"]+)"'), 1)
    ann_t = "struct<type:string,url:string,title:string,start_index:int,end_index:int>"
    url_ann = F.transform(
        hrefs,
        lambda h, i: F.struct(
            F.lit(E.ANNOTATION_URL).alias("type"), h.alias("url"), F.lit(None).cast("string").alias("title"),
            (i * 10).cast("int").alias("start_index"), (i * 10 + F.length(h)).cast("int").alias("end_index"),
        ),
    )
    file_ann = F.array(F.struct(F.lit("file_citation").alias("type"), F.lit(None).cast("string").alias("url"), title.alias("title"),
                                F.lit(0).alias("start_index"), F.length(title).cast("int").alias("end_index")))
    text_part = F.struct(F.lit(E.PART_OUTPUT_TEXT).alias("type"), title.alias("text"), F.concat(file_ann, url_ann).cast(f"array<{ann_t}>").alias("annotations"))
    refusal = F.struct(F.lit("refusal").alias("type"), F.lit("no answer").alias("text"), F.array().cast(f"array<{ann_t}>").alias("annotations"))
    content = F.when(F.col("page_id") % 5 == 0, F.array(text_part, refusal)).otherwise(F.array(text_part))
    done = pages.select(
        F.lit(E.EVENT_ITEM_DONE).alias("type"), F.col("page_id").alias("response_id"),
        F.struct(F.lit(E.ITEM_MESSAGE).alias("type"), content.alias("content")).alias("item"),
    )
    delta = pages.select(F.lit(E.EVENT_TEXT_DELTA).alias("type"), F.col("page_id").alias("response_id"), title.alias("delta"))
    src = _write_json_events(delta.unionByName(done, allowMissingColumns=True), spark, "url-citation-events")
    cites = E.url_citations(E.json_event_stream(spark, src))
    return E.run_to_completion(cites, "url-citations")


@query(
    "stream_cited_pages",
    f"""SELECT page_id AS response_id, CAST(i AS INTEGER) AS pos, u AS url,
       CASE i WHEN 1 THEN url WHEN 2 THEN url END AS source_url, CASE i WHEN 1 THEN CAST(page_id AS VARCHAR) END AS page
FROM (SELECT page_id, url, unnest([1, 2, 3]) AS i,
             unnest(['mcp://searchindex/' || substring(sha256(url), 1, 12) || '_' || {O.b64url('url')} || '_pages_' || CAST(page_id AS VARCHAR), url, 'see ' || url]) AS u
      FROM pages)""",
)
def stream_cited_pages(spark, sf_dir):
    """A finished message per page that cites it three times: by citation reference (decoded to address and page),
    by address, and by a text that is neither."""
    url = F.col("url")
    cite = lambda u: F.struct(F.lit(E.ANNOTATION_URL).alias("type"), u.alias("url"))
    notes = F.array(F.struct(F.lit("file_citation").alias("type"), F.lit(None).cast("string").alias("url")),
                    cite(citation_ref(url, F.col("page_id"))), cite(url), cite(F.concat(F.lit("see "), url)))
    part = F.struct(F.lit(E.PART_OUTPUT_TEXT).alias("type"), F.lit("").alias("text"), notes.alias("annotations"))
    done = read_table(spark, sf_dir, "pages").select(
        F.lit(E.EVENT_ITEM_DONE).alias("type"), F.col("page_id").alias("response_id"),
        F.struct(F.lit(E.ITEM_MESSAGE).alias("type"), F.array(part).alias("content")).alias("item"),
    )
    src = _write_json_events(done, spark, "cited-page-events")
    return E.run_to_completion(E.cited_pages(E.json_event_stream(spark, src)), "cited-pages")


@query(
    "stream_pending_calls",
    f"""SELECT conv_id * {RESPONSE_ID_BASE} + turn AS response_id, 'call_' || conv_id || '_' || turn AS call_id,
  CASE WHEN (conv_id + turn) % 6 = 3 THEN 'web_search' ELSE 'search_knowledge_base' END AS name,
  CASE (conv_id + turn) % 6 WHEN 1 THEN '' WHEN 2 THEN '{{"q": "x"}}' WHEN 4 THEN '{{"query": nul' WHEN 5 THEN '{{"query": null}}'
       ELSE CAST(to_json({{'query': text}}) AS VARCHAR) END AS arguments,
  CASE WHEN (conv_id + turn) % 6 IN (0, 1, 2) THEN text END AS query,
  CASE (conv_id + turn) % 6 WHEN 3 THEN '{{"error":"unknown tool web_search"}}' WHEN 4 THEN '{{"error":"arguments are not a JSON object"}}' END AS error
FROM conversations WHERE role = 'user'""",
)
def stream_pending_calls(spark, sf_dir):
    """User turns become finished function-call items (other turns are message items).  By rule on
    ``(conv_id + turn) % 6``: 0 query argument, 1 empty arguments, 2 arguments without a query (both fall
    back to the user input), 3 an unknown tool, 4 arguments that are no JSON, 5 a null query."""
    conv = read_table(spark, sf_dir, "conversations")
    sel = (F.col("conv_id") + F.col("turn")) % 6
    args = (
        F.when(sel == 1, F.lit(""))
        .when(sel == 2, F.lit('{"q": "x"}'))
        .when(sel == 4, F.lit('{"query": nul'))
        .when(sel == 5, F.lit('{"query": null}'))
        .otherwise(F.to_json(F.struct(F.col("text").alias("query"))))
    )
    is_user = F.col("role") == "user"
    item = F.when(
        is_user,
        F.struct(
            F.lit(E.ITEM_FUNCTION_CALL).alias("type"),
            F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("call_id"),
            F.when(sel == 3, F.lit("web_search")).otherwise(F.lit(E.SEARCH_TOOL)).alias("name"),
            args.alias("arguments"),
        ),
    ).otherwise(F.struct(F.lit(E.ITEM_MESSAGE).alias("type"), F.lit(None).cast("string").alias("call_id"),
                         F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments")))
    ev = conv.select(
        F.lit(E.EVENT_ITEM_DONE).alias("type"),
        (F.col("conv_id") * RESPONSE_ID_BASE + F.col("turn")).alias("response_id"),
        F.col("text").alias("user_input"),
        item.alias("item"),
    )
    src = _write_json_events(ev, spark, "function-call-events")
    calls = E.pending_calls(E.json_event_stream(spark, src))
    return E.run_to_completion(calls, "pending-calls").select("response_id", "call_id", "name", "arguments", "query", "error")


@query(
    "stream_response_timeouts",
    f"""SELECT conv_id * {RESPONSE_ID_BASE} + turn AS response_id,
  CAST(CASE WHEN (conv_id + turn) % 7 = 3 THEN ceil(length(text) / 40) - 1 ELSE ceil(length(text) / 40) END AS BIGINT) AS n_deltas,
  CASE WHEN (conv_id + turn) % 7 = 3 THEN substr(text, 41) ELSE text END AS text, (conv_id + turn) % 7 NOT IN (0, 3) AS completed
FROM conversations WHERE length(text) > 0""",
)
def stream_response_timeouts(spark, sf_dir):
    """Every conversation turn is a response of deltas and a completed event, a second apart; by rule on
    ``(conv_id + turn) % 7``: 0 is never completed, 3 loses its first delta, 5 has every delta twice.  The events lie
    in hash order within hours, an hour's events in the next file; idle responses are emitted unfinished by their timers.  Some
    events long after the others move the watermark on."""
    turns = read_table(spark, sf_dir, "conversations").where(F.length("text") > 0)
    n, sel = F.ceil(F.length("text") / 40).cast("int"), (F.col("conv_id") + F.col("turn")) % 7
    one = lambda kind, seq, delta: F.struct(F.lit(kind).alias("type"), seq.cast("long").alias("seq"), delta.cast("string").alias("delta"))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(E.EVENT_TEXT_DELTA, i, F.col("text").substr(i * 40 + 1, F.lit(40))))
    parts = F.when(sel == 3, F.filter(parts, lambda p: p["seq"] > 0)).when(sel == 5, F.concat(parts, parts)).otherwise(parts)
    closing = F.array(one(E.EVENT_COMPLETED, n, F.lit(None)))
    ev = turns.select((F.col("conv_id") * RESPONSE_ID_BASE + F.col("turn")).alias("response_id"), (F.col("conv_id") % 3).cast("int").alias("hour"), F.explode(F.when(sel == 0, parts).otherwise(F.concat(parts, closing))).alias("e"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ev = ev.select("response_id", "e.*", "hour", (start + F.make_dt_interval(hours=F.col("hour"), mins=F.pmod(F.xxhash64("response_id"), F.lit(30)).cast("int"))).alias("at"))
    path = scratch_path(spark, "timed-events")
    for hour in range(3):  # files in the order of their hours, three whatever the table
        ev.where(F.col("hour") == hour).drop("hour").coalesce(1).write.mode("append").parquet(path)
    last = spark.range(4).select(F.lit("response.in_progress").alias("type"), (start + F.make_dt_interval(days=F.lit(2), mins=F.col("id").cast("int"))).alias("at"))
    schema = spark.read.parquet(path).schema
    for i in range(4):
        tail = last.where(F.minute("at") == i).select(*[(F.col(f.name) if f.name in ("type", "at") else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        tail.coalesce(1).write.mode("append").parquet(path)
    with R.with_rocksdb(spark):
        stream = E.table_stream(spark, path, schema, files_per_batch=1)
        return E.run_to_completion(R.response_text_or_timeout(stream, "response_id", "seq", "at", idle="40 minutes"), "response-timeouts")


@query(
    "stream_unanswered_calls",
    """SELECT 'call_' || conv_id || '_' || turn AS call_id, 'search_knowledge_base' AS name FROM conversations WHERE role = 'user' AND (conv_id + turn) % 5 IN (0, 1)""",
)
def stream_unanswered_calls(spark, sf_dir):
    """Every user turn is a finished function call; by rule on ``(conv_id + turn) % 5``: 0 has no output, 1 has one after
    the bound of ten minutes, the others are answered in time, 4 twice.  Calls and outputs are two readers of the same files."""
    conv = read_table(spark, sf_dir, "conversations").where("role = 'user'")
    sel, start = (F.col("conv_id") + F.col("turn")) % 5, F.lit("2024-01-01 00:00:00").cast("timestamp")
    called = start + F.make_dt_interval(mins=F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(40)).cast("int"))
    call_id = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    item = lambda kind, name, after: F.struct(F.struct(F.lit(kind).alias("type"), call_id.alias("call_id"), F.lit(name).cast("string").alias("name")).alias("item"), (called + F.make_dt_interval(mins=F.lit(after))).alias("at"))
    call, soon, late = item(E.ITEM_FUNCTION_CALL, E.SEARCH_TOOL, 0), item(R.ITEM_CALL_OUTPUT, None, 4), item(R.ITEM_CALL_OUTPUT, None, 25)
    found = F.when(sel == 0, F.array(call)).when(sel == 1, F.array(call, late)).when(sel == 4, F.array(call, soon, soon)).otherwise(F.array(call, soon))
    ev = conv.select(F.explode(found).alias("e")).select(F.lit(E.EVENT_ITEM_DONE).alias("type"), "e.*")
    path = scratch_path(spark, "call-events")
    ev.repartition(3).write.parquet(path)
    schema = spark.read.parquet(path).schema
    for i in range(3):
        spark.range(1).coalesce(1).select(F.lit("response.in_progress").alias("type"), F.lit(None).cast(schema["item"].dataType).alias("item"), (start + F.make_dt_interval(days=F.lit(2 + i))).alias("at")).write.mode("append").parquet(path)
    read = lambda: E.table_stream(spark, path, schema, files_per_batch=1)
    out = R.unanswered_calls(read(), "at", within="10 minutes", delay="2 hours", answers=read())
    return E.run_to_completion(out, "unanswered-calls").select("call_id", "name")
