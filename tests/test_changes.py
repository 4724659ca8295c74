"""Change sets by range hashes, and incremental index runs with replayed and unfinished batches."""

import random
import tempfile

import pytest

from kestrel.operators.changes import MAX_DEPTH, change_set, write_manifest
from kestrel.operators.enrich import index_projection
from kestrel.streaming import index_run


def _manifest(spark, rows, **kw):
    return write_manifest(spark.createDataFrame(rows, "id string, hash string, version int"), "id", version_col="version", **kw)


def _changes(spark, now, was, **kw):
    c = change_set(spark, _manifest(spark, now, **kw), _manifest(spark, was, **kw))
    return sorted(tuple(r) for r in c.changes.collect()), c.share_read


def _brute(now, was):
    a, b = {k: h for k, h, _ in now}, {k: (h, v) for k, h, v in was}
    out = [(k, h, "new", 1) if k not in b else (k, h, "update", b[k][1] + 1) for k, h in a.items() if k not in b or b[k][0] != h]
    return sorted(out + [(k, h, "delete", v) for k, (h, v) in b.items() if k not in a])


@pytest.mark.parametrize("leaf_rows", [1, 4, 100, 10_000])
def test_changes_equal_brute_force_at_every_depth(spark, leaf_rows):
    r = random.Random(5)
    was = [(f"k{i}", f"h{i}", r.randint(1, 4)) for i in range(600)]
    now = [(k, "other" if r.random() < 0.01 else h, 1) for k, h, _ in was if r.random() > 0.01] + [(f"n{i}", "x", 1) for i in range(5)]
    got, share = _changes(spark, now, was, leaf_rows=leaf_rows)
    assert got == _brute(now, was)
    assert 0 < share <= 1


def test_one_change_reads_one_range(spark):
    was = [(f"k{i}", f"h{i}", 1) for i in range(2000)]
    got, share = _changes(spark, [("k7", "new text", 1)] + was[:7] + was[8:], was, leaf_rows=8)
    assert got == [("k7", "new text", "update", 2)]
    assert share < 0.02


def test_equal_empty_null_and_repeated_keys(spark):
    rows = [("a", "AB", 1), ("b", None, 2), (None, "x", 1)]
    assert _changes(spark, [("a", "ab", 1), ("b", None, 1)], rows) == ([], 0.0)
    assert _changes(spark, [], []) == ([], 0.0)
    assert _changes(spark, [], [("a", "x", 3)])[0] == [("a", "x", "delete", 3)]
    assert _changes(spark, [("a", "x", 1)], [])[0] == [("a", "x", "new", 1)]
    assert _changes(spark, [("b", "y", 1)], rows)[0] == [("a", "ab", "delete", 1), ("b", "y", "update", 3)]
    assert _changes(spark, [("a", "z", 1)], [("a", "x", 1), ("a", "w", 2)])[0] == [("a", "z", "update", 3)]
    assert MAX_DEPTH * 4 < 64


def _docs(spark, rows):
    return spark.createDataFrame(rows, "content string, file_name string, source_url string, seq int")


def _index(spark, path):
    return sorted((r["source_url"], r["page"], r["chunk"]) for r in index_run.read_index(spark, path).collect())


def test_batches_replace_replay_and_delete(spark):
    path = tempfile.mkdtemp(prefix="kestrel-index-") + "/index"
    first = _docs(spark, [("a" * 3000, "a", "u/a", 1), ("old", "b", "u/b", 1), ("b", "b", "u/b", 2), ("c", "c", "u/c", 1), ("z", "z", None, 1)])
    second = _docs(spark, [("short", "a", "u/a", 1), (None, "c", "u/c", 1), ("  ", "d", "u/d", 1)])
    index_run.apply_batch(first, 0, path, "seq")
    assert [(u, p) for u, p, _ in _index(spark, path)] == [("u/a", 0), ("u/a", 1), ("u/b", 0), ("u/c", 0)]
    index_run.apply_batch(second, 1, path, "seq")
    want = [("u/a", 0, "short"), ("u/b", 0, "b")]
    assert _index(spark, path) == want
    index_run.apply_batch(first, 0, path, "seq")  # run again after a failure: replaces its own rows only
    index_run.apply_batch(second, 1, path, "seq")
    assert _index(spark, path) == want
    assert sorted(tuple(r) for r in index_run.ledger(spark, path).collect()) == [(0, 3, 4), (1, 3, 1)]
    full = index_projection(_docs(spark, [("short", "a", "u/a", 1), ("b", "b", "u/b", 1)]))
    assert sorted((r["source_url"], r["page"], r["chunk"]) for r in full.collect()) == want


def test_batch_without_ledger_line_is_not_seen(spark):
    path = tempfile.mkdtemp(prefix="kestrel-index-") + "/index"
    index_run.apply_batch(_docs(spark, [("a", "a", "u/a", 1)]), 0, path, "seq")
    late = _docs(spark, [("changed", "a", "u/a", 1)])
    index_projection(late).write.parquet(f"{path}/chunks/batch=1")
    index_run.latest_arrivals(late, "seq").selectExpr("'x' as parent_id").write.parquet(f"{path}/parents/batch=1")
    assert _index(spark, path) == [("u/a", 0, "a")]
    index_run.apply_batch(late, 1, path, "seq")
    assert _index(spark, path) == [("u/a", 0, "changed")]
