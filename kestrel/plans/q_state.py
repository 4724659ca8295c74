"""Queries: ingestion error report, readiness gate, latest status, content-hash change detection,
nested inventory flattening, transcripts and tool-call rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import state as S
from kestrel.plans.registry import query
from kestrel.session import read_table


@query(
    "ingest_error_report",
    """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS run_day, event_id, user_id, value, props FROM events WHERE event_type = 'error'),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_day ORDER BY event_id) AS INTEGER) AS pos FROM e),
t AS (SELECT run_day, count(*) AS n_errors FROM e GROUP BY run_day)
SELECT r.run_day, event_id, user_id, value, props, pos, n_errors, greatest(n_errors - 20, 0) AS n_more
FROM r JOIN t USING (run_day) WHERE pos <= 20""",
)
def ingest_error_report(spark, sf_dir):
    """Runs are days; errors are events of type ``error``; first 20 per run by event id."""
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    errors = ev.select(F.date_format("ts", "yyyy-MM-dd").alias("run_day"), "event_id", "user_id", "value", "props")
    return S.ingest_error_report(errors, "run_day", "event_id", ["user_id", "value", "props"], max_items=20)


_GATE_SQL = """WITH r AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day,
         count(*) FILTER (WHERE event_type = 'purchase') AS completed,
         count(*) FILTER (WHERE event_type = 'error') AS failed,
         count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS in_progress
  FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')),
l AS (SELECT user_id, day, CASE WHEN value IS NULL OR value < 20 THEN 'in_progress' ELSE 'completed' END AS status FROM (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, value,
         row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
s AS (SELECT r.*, l.status FROM r JOIN l USING (user_id, day))
SELECT user_id, day, completed, failed, in_progress, status,
  CASE WHEN status <> 'completed' THEN 'processing' WHEN failed > 0 THEN 'error_failed' WHEN completed = 0 THEN 'error_empty' ELSE 'ready' END AS verdict,
  'completed=' || completed || ', failed=' || failed || ', in_progress=' || in_progress AS detail
FROM s"""


@query("ingest_gate", _GATE_SQL)
def ingest_gate(spark, sf_dir):
    """Runs are (user, day); ``error`` rows failed, ``purchase`` rows completed, others in progress.  The
    status recorded with an event is ``completed`` when its value is 20 or more."""
    ev = read_table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("in_progress")
    status = F.when(F.col("value") >= 20, "completed").otherwise("in_progress")
    runs = ev.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), state.alias("state"), status.alias("run_status"), "ts", "event_id")
    gate = S.ingest_gate(runs, ["user_id", "day"], "state", "run_status", ["ts", "event_id"])
    return gate.select("user_id", "day", "completed", "failed", "in_progress", "status", "verdict", "detail")


@query(
    "latest_status",
    """WITH l AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)
SELECT c.c_custkey, coalesce(l.event_type, 'NotFound') AS status FROM customer c LEFT JOIN l ON l.user_id = c.c_custkey""",
)
def latest_status(spark, sf_dir):
    """Newest event type per user, for every customer key; keys without events get ``NotFound``."""
    ev = read_table(spark, sf_dir, "events")
    keys = read_table(spark, sf_dir, "customer").select("c_custkey")
    return S.latest_status(ev, "user_id", "event_type", ["ts", "event_id"], keys=keys, key_col="c_custkey")


@query(
    "content_hash_change",
    """WITH cur AS (
  SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN sha256(d.text)
         ELSE sha256(d.text) || ':' || sha256(CAST(l.quality AS VARCHAR) || ':' || CAST(l.toxic AS VARCHAR)) END AS hash
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
prev AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(hash || 'old') ELSE upper(hash) END AS prev_hash, 1 AS prev_version
         FROM cur WHERE doc_id % 10 <> 0)
SELECT c.doc_id, c.hash,
  CASE WHEN p.prev_hash IS NULL THEN 'new' WHEN lower(p.prev_hash) = lower(c.hash) THEN 'skip' ELSE 'update' END AS action,
  CAST(CASE WHEN p.prev_hash IS NULL THEN 1 WHEN lower(p.prev_hash) = lower(c.hash) THEN p.prev_version ELSE p.prev_version + 1 END AS INTEGER) AS version
FROM cur c LEFT JOIN prev p ON p.doc_id = c.doc_id""",
)
def content_hash_change(spark, sf_dir):
    """Item = document text, referred item = its label row (``quality:toxic``).  The previous manifest
    holds the documents whose id is not a multiple of 10 (the rest are new); its hash is upper-cased
    (same hash, other case) or, for multiples of 3, a different hash."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    ref = F.concat(F.col("quality").cast("string"), F.lit(":"), F.col("toxic").cast("string"))
    cur = docs.join(labels, "doc_id", "left").select("doc_id", S.content_hash(F.col("text"), ref).alias("hash"))
    prev = cur.where(F.col("doc_id") % 10 != 0).select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("hash", F.lit("old")), 256)).otherwise(F.upper("hash")).alias("hash"),
        F.lit(1).alias("version"),
    )
    return S.content_hash_change(cur, prev, "doc_id")


@query(
    "manifest_changes",
    """WITH cur AS (SELECT doc_id AS key, sha256(text) AS hash FROM documents WHERE doc_id % 500 <> 7),
prev AS (SELECT doc_id AS key, CASE WHEN doc_id % 500 = 13 THEN sha256(sha256(text) || 'old') ELSE sha256(text) END AS hash,
  CAST(1 + doc_id % 3 AS INTEGER) AS version FROM documents WHERE doc_id % 500 <> 0)
SELECT coalesce(c.key, p.key) AS key, coalesce(c.hash, p.hash) AS hash,
  CASE WHEN p.key IS NULL THEN 'new' WHEN c.key IS NULL THEN 'delete' ELSE 'update' END AS action,
  CAST(CASE WHEN p.key IS NULL THEN 1 WHEN c.key IS NULL THEN p.version ELSE p.version + 1 END AS INTEGER) AS version
FROM cur c FULL JOIN prev p ON p.key = c.key WHERE p.key IS NULL OR c.key IS NULL OR c.hash <> p.hash""",
)
def manifest_changes(spark, sf_dir):
    """Two stored manifests of ``documents`` compared by range hashes: documents of ``doc_id % 500 = 0`` are missing in
    the previous one, those of 7 in the current one, those of 13 had another text."""
    from kestrel.operators.changes import change_set, write_manifest

    key, text_hash = F.col("doc_id"), F.sha2("text", 256)
    docs = read_table(spark, sf_dir, "documents")
    old = F.when(key % 500 == 13, F.sha2(F.concat(text_hash, F.lit("old")), 256)).otherwise(F.upper(text_hash))
    current = write_manifest(docs.where(key % 500 != 7).select(key, text_hash.alias("hash")), "doc_id", leaf_rows=64)
    previous = write_manifest(docs.where(key % 500 != 0).select(key, old.alias("hash"), (1 + key % 3).alias("version")), "doc_id", version_col="version", leaf_rows=64)
    return change_set(spark, current, previous).changes


@query(
    "nested_dedupe_flatten",
    """WITH f AS (SELECT l_suppkey AS nic_id, l_partkey AS ip, l_orderkey, l_linenumber,
        'o' || l_orderkey || '-' || l_linenumber || '.example.net' || ',' || lower(l_returnflag) || lower(l_linestatus) || '.example.net' AS fqdns,
        0 AS config FROM lineitem
      UNION ALL
      SELECT l_suppkey, l_partkey + 1000000, l_orderkey, l_linenumber, 'q' || CAST(l_quantity AS BIGINT) || '.example.net', 1 FROM lineitem WHERE l_quantity > 10),
w AS (SELECT *, row_number() OVER (PARTITION BY nic_id, ip ORDER BY l_orderkey, l_linenumber, config, fqdns) AS rn FROM f)
SELECT nic_id, ip, l_orderkey, l_linenumber, CAST(config AS INTEGER) AS config, fqdns FROM w WHERE rn = 1""",
)
def nested_dedupe_flatten(spark, sf_dir):
    """Orders as resources with a chain of nested levels: connections (their line items), each with one NIC
    (the supplier) of one or two IP configurations (the part; for quantities over 10 a second one).  The
    lines of an order are few (17 at most in these tables).  The first by (order, line, configuration) per
    (NIC, IP) wins; its FQDNs are joined with ','."""
    li = read_table(spark, sf_dir, "lineitem")
    fq = F.array(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(".example.net")),
        F.concat(F.lower("l_returnflag"), F.lower("l_linestatus"), F.lit(".example.net")),
    )
    second = F.array(F.concat(F.lit("q"), F.col("l_quantity").cast("long").cast("string"), F.lit(".example.net")))
    configs = F.array(
        F.struct(F.col("l_partkey").alias("ip"), F.lit(0).alias("config"), fq.alias("fqdns")),
        F.when(F.col("l_quantity") > 10, F.struct((F.col("l_partkey") + 1000000).alias("ip"), F.lit(1).alias("config"), second.alias("fqdns"))),
    )
    nics = F.array(F.struct(F.col("l_suppkey").alias("nic_id"), F.filter(configs, lambda c: c.isNotNull()).alias("configs")))
    connection = F.struct("l_linenumber", nics.alias("nics"))
    resources = li.groupBy("l_orderkey").agg(F.collect_list(connection).alias("connections"))
    return S.nested_dedupe_flatten(
        resources, "l_orderkey", ["connections", "nics", "configs"], ("nic_id", "ip"), ["l_orderkey", "l_linenumber", "config"], "fqdns"
    )


@query(
    "transcript",
    "SELECT conv_id, turn, role || ': ' || string_split(text, chr(10))[-1] AS line FROM conversations WHERE turn % 5 <> 4",
)
def transcript(spark, sf_dir):
    """Messages are conversation turns whose content parts are the text lines; by rule every turn
    with ``turn % 5 = 4`` ends with a non-text part and prints nothing."""
    conv = read_table(spark, sf_dir, "conversations")
    parts = F.transform(F.split("text", "\n"), lambda p: F.struct(F.lit("text").alias("type"), p.alias("text")))
    tail = F.when(F.col("turn") % 5 == 4, F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))).otherwise(
        F.array().cast("array<struct<type:string,text:string>>")
    )
    msgs = conv.select("conv_id", "turn", "role", F.concat(parts, tail).alias("content"))
    return S.transcript(msgs, "conv_id", "turn", "role", "content")


@query(
    "tool_call_rows",
    """SELECT event_id, CAST(0 AS INTEGER) AS pos,
  CAST(to_json({'id': 'call_' || event_id || '_0', 'type': 'function', 'function': {'name': 'lookup', 'arguments': props}}) AS VARCHAR) AS call_json
FROM events WHERE event_type = 'click'
UNION ALL
SELECT event_id, CAST(1 AS INTEGER) AS pos,
  CAST(to_json({'id': 'call_' || event_id || '_1', 'type': 'function', 'function': {'name': 'search', 'arguments': '{"q": "' || user_id || '"}'}}) AS VARCHAR) AS call_json
FROM events WHERE event_type = 'click' AND value > 10""",
)
def tool_call_rows(spark, sf_dir):
    """Events as run steps: ``click`` events are ``tool_calls`` steps with a lookup call (arguments =
    props) and, when value > 10, a second search call."""
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id").cast("string")

    def call(i: int, name: str, args):
        return F.struct(
            F.concat(F.lit("call_"), eid, F.lit(f"_{i}")).alias("id"),
            F.lit("function").alias("type"),
            F.struct(F.lit(name).alias("name"), args.alias("arguments")).alias("function"),
        )

    search_args = F.concat(F.lit('{"q": "'), F.col("user_id").cast("string"), F.lit('"}'))
    calls = F.filter(F.array(call(0, "lookup", F.col("props")), F.when(F.col("value") > 10, call(1, "search", search_args))), lambda c: c.isNotNull())
    steps = ev.select(
        "event_id",
        F.when(F.col("event_type") == "click", "tool_calls").otherwise("message_creation").alias("type"),
        calls.alias("tool_calls"),
    )
    return S.tool_call_rows(steps, "event_id")
