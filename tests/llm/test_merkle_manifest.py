"""Merkle manifest against a plain recursion over lists."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kestrel.llm import merkle_manifest
from kestrel.llm.queries import QUERIES
from tests.conftest import SF_SMALL

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, text):
    values = [text if c == "text" else row[c] for c in FIELDS]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(levels, i, fold):
    """Siblings and folded hash of node i of levels[0], up to the last level."""
    out = []
    for level in levels[:-1]:
        first = i - i % 8
        run = level[first : first + 8]
        out += run[: i % 8] + run[i % 8 + 1 :]
        run = [*run[: i % 8], fold, *run[i % 8 + 1 :]]
        fold, i = h("".join(run)), i // 8
    return out, fold


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
    trees = [tree([leaf_of(r, r["text"]) for r in groups[lang]]) for lang in langs]
    top = tree([t[-1][0] for t in trees]) if trees else []
    out = []
    for g, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            leaf = leaf_of(r, r["text"])
            start = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                start = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            low, fold = climb(trees[g], i, start)
            high, fold = climb(top, g, fold)
            out.append((r["doc_id"], leaf, trees[g][-1][0], top[-1][0], h("".join(low + high)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def check(docs):
    got = merkle_manifest.manifest(docs, FIELDS)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs.collect())


def test_edge_rows(edge_docs):
    check(edge_docs)


def test_empty_table(no_docs):
    out = merkle_manifest.manifest(no_docs, FIELDS)
    assert out.columns == COLUMNS and out.collect() == []


@pytest.mark.parametrize("sizes", [(1,), (2,), (8,), (9,), (1, 1), (64, 65, 1), (513, 3, 8), (1,) * 9, (3,) * 70])
def test_tree_shapes(spark, sizes):
    rows = [(100 * g + i, f"Text {i} A", None if g == 2 else f"l{g:03d}é", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5))


def test_copies_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "RUNS_PER_COPY", 2)
    monkeypatch.setattr(merkle_manifest, "MAX_COPIES", 7)
    rows = [(i, f"Text {i}", "b" if i % 3 else "a" if i % 9 else None, "s", i) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    check(docs)


def test_equal_ids_and_rows(spark):
    rows = [(i % 5, f"Text {i % 15}", "a", None, 1) for i in range(90)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4))


def test_positions_of_a_hot_group(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.col("id").cast("string")).alias("g"))
    got = merkle_manifest.positions(rows.repartition(6), "g", ["id"]).collect()
    groups = defaultdict(list)
    for r in sorted(got, key=lambda r: r["id"]):
        groups[r["g"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, g or ""))
    for g, rs in groups.items():
        assert [r["place"] for r in rs] == list(range(len(rs)))
        assert {(r["size"], r["number"]) for r in rs} == {(len(rs), order.index(g))}


def test_query(spark):
    got = sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, SF_SMALL).collect()), key=str)
    assert got == expected(spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    assert {r[-1] for r in got} == {True, False}
