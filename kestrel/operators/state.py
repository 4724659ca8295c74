"""Ingestion state and run bookkeeping: error reports, readiness gates, latest status per key,
content-hash change detection, nested inventory flattening; plus transcript and tool-call rows.

Per-group work is either a combinable aggregate (partial aggregation before the shuffle, so
a hot group costs no more than its share) or a bounded window (``row_number() <= n`` is a
partial ``WindowGroupLimit``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ingest_error_report(errors: DataFrame, run_col: str, order_col: str, fields: list[str], max_items: int = 20) -> DataFrame:
    """The first ``max_items`` errors of each run (by ``order_col``) with their fields, the run's error
    count and how many more are not shown (``count - max_items``, at least 0)."""
    w = Window.partitionBy(run_col).orderBy(F.col(order_col).asc())
    shown = errors.select(run_col, order_col, *fields).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max_items)
    totals = errors.groupBy(run_col).agg(F.count(F.lit(1)).alias("n_errors"))
    return shown.join(totals, run_col).withColumn("n_more", F.greatest(F.col("n_errors") - F.lit(max_items), F.lit(0)))


# Verdict codes of the readiness gate, in the order they are tested.
VERDICT_PROCESSING = "processing"
VERDICT_FAILED = "error_failed"
VERDICT_EMPTY = "error_empty"
VERDICT_READY = "ready"


def ingest_gate(runs: DataFrame, run_cols: list[str], state_col: str, status_col: str, order_cols: list[str]) -> DataFrame:
    """Counts of ``completed`` / ``failed`` / ``in_progress`` per run and a verdict tested in order:
    run not completed -> processing; any failure -> error with counts; nothing completed -> error;
    else ready.  The run's status is the one recorded in ``status_col`` of its newest row (by ``order_cols``)."""
    st = F.col(state_col)
    agg = runs.groupBy(*run_cols).agg(
        F.max_by(F.col(status_col), F.struct(*order_cols)).alias("status"),
        F.count_if(st == "completed").alias("completed"),
        F.count_if(st == "failed").alias("failed"),
        F.count_if(st == "in_progress").alias("in_progress"),
    )
    counts = F.concat(
        F.lit("completed="), F.col("completed").cast("string"),
        F.lit(", failed="), F.col("failed").cast("string"),
        F.lit(", in_progress="), F.col("in_progress").cast("string"),
    )
    verdict = (
        F.when(~F.col("status").eqNullSafe("completed"), F.lit(VERDICT_PROCESSING))
        .when(F.col("failed") > 0, F.lit(VERDICT_FAILED))
        .when(F.col("completed") == 0, F.lit(VERDICT_EMPTY))
        .otherwise(F.lit(VERDICT_READY))
    )
    return agg.withColumn("verdict", verdict).withColumn("detail", counts)


def latest_status(records: DataFrame, group_col: str, status_col: str, order_cols: list[str], keys: DataFrame | None = None, key_col: str | None = None, missing: str = "NotFound") -> DataFrame:
    """Status of the newest record per group (newest = max of ``order_cols`` as a tuple); with a key
    list, every key gets a row and keys without records get ``missing``."""
    latest = records.groupBy(group_col).agg(F.max_by(F.col(status_col), F.struct(*order_cols)).alias("status"))
    if keys is None:
        return latest
    key_col = key_col or group_col
    return (
        keys.select(F.col(key_col).alias(group_col))
        .join(latest, group_col, "left")
        .select(F.col(group_col).alias(key_col), F.coalesce(F.col("status"), F.lit(missing)).alias("status"))
    )


def content_hash(item: Column, referred: Column | None = None) -> Column:
    """SHA-256 of the item; with what it refers to, both hashes joined by a colon."""
    h = F.sha2(item, 256)
    if referred is None:
        return h
    return F.when(referred.isNull(), h).otherwise(F.concat_ws(":", h, F.sha2(referred, 256)))


def content_hash_change(current: DataFrame, previous: DataFrame, key: str, hash_col: str = "hash", version_col: str = "version") -> DataFrame:
    """Compare current hashes with the last recorded manifest (case-insensitive): unchanged -> skip
    (version kept), changed -> update (version + 1), new -> new (version 1)."""
    prev = previous.select(key, F.col(hash_col).alias("prev_hash"), F.col(version_col).alias("prev_version"))
    j = current.select(key, hash_col).join(prev, key, "left")
    same = F.lower(F.col(hash_col)) == F.lower(F.col("prev_hash"))
    action = F.when(F.col("prev_hash").isNull(), F.lit("new")).when(same, F.lit("skip")).otherwise(F.lit("update"))
    version = F.when(F.col("prev_hash").isNull(), F.lit(1)).when(same, F.col("prev_version")).otherwise(F.col("prev_version") + 1)
    return j.select(key, hash_col, action.alias("action"), version.cast("int").alias(version_col))


def flatten_levels(df: DataFrame, keep: list[str], levels: list[str]) -> DataFrame:
    """Explode a chain of nested arrays: each level is an array of structs whose fields become columns,
    the next level's array among them.  An empty or null array at any level yields no row."""
    out = df.select(*keep, levels[0])
    for i, level in enumerate(levels):
        rest = [c for c in out.columns if c != level]
        out = out.select(*rest, F.explode(level).alias("level_item")).select(*rest, "level_item.*")
        if i + 1 < len(levels) and levels[i + 1] not in out.columns:
            raise ValueError(f"items of {level} have no field {levels[i + 1]}")
    return out


def nested_dedupe_flatten(
    resources: DataFrame, res_key: str, levels: list[str], pair: tuple[str, str], order_cols: list[str], list_col: str, sep: str = ","
) -> DataFrame:
    """resource -> items, through any number of nested ``levels`` -> one row per ``pair`` value; the first
    by ``order_cols`` (fields of any level) wins, ties broken by the joined list so the pick is total.  The
    pick is a ``min`` over a struct (combinable), so a pair repeated across a third of the resources
    costs one partial row per task.  Output: ``pair, order_cols, list_col`` (list joined with ``sep``)."""
    a, b = pair
    flat = flatten_levels(resources, [res_key], levels)
    joined = F.array_join(F.col(list_col), sep)
    first = flat.groupBy(a, b).agg(F.min(F.struct(*[F.col(c) for c in order_cols], joined.alias("__l"))).alias("w"))
    return first.select(a, b, *[F.col(f"w.{c}").alias(c) for c in order_cols], F.col("w.__l").alias(list_col))


def transcript(messages: DataFrame, conv_col: str, order_col: str, role_col: str, content_col: str) -> DataFrame:
    """Messages in ascending order as ``role: text`` lines, using the last content part of each
    message; a message whose last part has no text is skipped.  Row-local (no grouping): the
    order column carries the sequence, so no conversation is ever gathered into one task."""
    last = F.try_element_at(F.col(content_col), F.lit(-1))
    text = F.when(last["type"] == "text", last["text"])
    return messages.select(conv_col, order_col, F.concat(F.col(role_col), F.lit(": "), text).alias("line")).where(F.col("line").isNotNull())


def tool_call_rows(steps: DataFrame, step_key: str, type_col: str = "type", calls_col: str = "tool_calls") -> DataFrame:
    """Steps of type ``tool_calls`` -> one JSON row per call ``(step, pos, call_json)``."""
    return steps.where(F.col(type_col) == "tool_calls").select(
        step_key, F.posexplode(calls_col).alias("pos", "call")
    ).select(step_key, "pos", F.to_json("call").alias("call_json"))
