"""Sources and sinks: text-file containers, CSV inference, index key checks, request batching, dims."""

import glob
import gzip
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kestrel.operators import enrich
from kestrel.sources import io

MARKDOWN = """# Product guide

## Overview
A small field tent for two people.

- weight: 2 kg
- poles: aluminium
"""


def test_scan_text_files_reads_whole_markdown(spark):
    d = tempfile.mkdtemp(prefix="kestrel-md-")
    os.makedirs(os.path.join(d, "sub"))
    with open(os.path.join(d, "sub", "product.md"), "w") as f:
        f.write(MARKDOWN)
    with open(os.path.join(d, "skip.txt"), "w") as f:
        f.write("not markdown")
    rows = io.scan_text_files(spark, d, glob="*.md").collect()
    assert len(rows) == 1
    assert rows[0]["content"] == MARKDOWN and rows[0]["file_name"] == "product.md"
    assert rows[0]["source_url"].endswith("/sub/product.md")
    chunks = enrich.index_projection(io.scan_text_files(spark, d, glob="*.md")).collect()
    assert len(chunks) == 1 and chunks[0]["chunk"] == MARKDOWN


CONTAINER = [("group-1", "one\ntwo\r\nthree "), ("group-2", ""), ("group-3", None), ("part-4", "größe \U0001f600\n"), ("_b.c", "\ufefftext")]


def _container(spark, path):
    io.write_text_files(spark.createDataFrame(CONTAINER, "name string, value string"), path)
    rows = io.scan_text_files(spark, path).select("content", io.written_name(F.col("source_url")).alias("name")).collect()
    return sorted((r["name"], r["content"]) for r in rows)


def test_text_files_round_trip(spark):
    path = tempfile.mkdtemp(prefix="kestrel-container-") + "/box"
    assert _container(spark, "file://" + path) == sorted((n, (v or "") + "\n") for n, v in CONTAINER)
    assert sorted(f for _, _, files in os.walk(path) for f in files) == sorted(f"name={n}.txt" for n, _ in CONTAINER)  # no temporary ones


def test_text_files_round_trip_in_another_store(spark):
    top = tempfile.mkdtemp(prefix="kestrel-store-")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.kestrel-store.link./box", f"file://{top}")
    assert _container(spark, "viewfs://kestrel-store/box/c") == sorted((n, (v or "") + "\n") for n, v in CONTAINER)


def test_scan_of_many_small_files_keeps_partitions_few(spark):
    path = tempfile.mkdtemp(prefix="kestrel-many-") + "/box"
    io.write_text_files(spark.range(1000).select(F.concat(F.lit("f"), "id").alias("name"), F.col("id").cast("string").alias("value")), path)
    rows = io.scan_text_files(spark, path)
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r["content"] for r in rows.collect()) == sorted(f"{i}\n" for i in range(1000))


def test_scan_text_files_unpacks_compressed_ones(spark):
    d = tempfile.mkdtemp(prefix="kestrel-gz-")
    with gzip.open(os.path.join(d, "a.txt.gz"), "wb") as f:
        f.write(MARKDOWN.encode())
    assert [r["content"] for r in io.scan_text_files(spark, d, glob="*.gz").collect()] == [MARKDOWN]


def test_container_query_makes_few_folders(spark):
    """A folder for every file was what the committer and the listing spent their time on."""
    from kestrel.plans.q_index import document_container_scan
    from kestrel.session import scratch_root

    d = tempfile.mkdtemp(prefix="kestrel-docs-")
    docs = [(i, f"text {i}\nend") for i in range(600)] + [(1, "again"), (None, "no id"), (700, None), (701, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    root = scratch_root(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/container-*"))
    got = {r["file_name"]: (r["content"], r["n_lines"]) for r in document_container_scan(spark, d).collect()}
    (box,) = set(glob.glob(f"{root}/container-*")) - before
    want = {f"group-{g}.txt": ("".join(f"text {i}\nend\n" for i in range(3 * g, 3 * g + 3)), 7) for g in range(1, 200)}
    want["group-0.txt"] = ("text 0\nend\nagain\ntext 1\nend\ntext 2\nend\n", 8)
    want |= {"group-233.txt": ("\n", 2), "__HIVE_DEFAULT_PARTITION__.txt": ("no id\n", 2)}
    assert got == want
    assert sum(1 for _ in os.walk(box)) <= io.CONTAINER_FOLDERS + 1


def test_csv_round_trip_with_inference(spark):
    d = tempfile.mkdtemp(prefix="kestrel-csv-")
    df = spark.createDataFrame([(1, "a", 2.5, None), (2, None, None, "x")], "id int, s string, v double, c string")
    io.csv_sink(df, d + "/out", index_col="id")
    back = io.csv_scan(spark, d + "/out", index_col="id")
    assert dict(back.dtypes)["v"] == "double" and dict(back.dtypes)["id"] == "int"
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a", 2.5, None), (2, None, None, "x")]


def test_index_write_rejects_duplicate_keys(spark):
    d = tempfile.mkdtemp(prefix="kestrel-idx-")
    row = ("p", "t", "u", "f", ["x"], "k1", "c", [0.5])
    schema = "parent_id string, title string, source_url string, source_file_name string, locations array<string>, chunk_id string, chunk string, text_vector array<double>"
    ok = spark.createDataFrame([row, row[:5] + ("k2",) + row[6:]], schema)
    path = io.index_write(ok, d + "/ok")
    assert [f.dataType.simpleString() for f in spark.read.parquet(path).schema.fields][-1] == "array<float>"
    with pytest.raises(ValueError):
        io.index_write(spark.createDataFrame([row, row], schema), d + "/dup")


def test_request_batches_are_bounded_and_complete(spark):
    df = spark.createDataFrame([(f"k{i:04d}", f"text {i}") for i in range(237)], "chunk_id string, chunk string")
    out = enrich.embed_request_batches(df, batch_size=10).collect()
    assert max(r["n_inputs"] for r in out) <= 10
    seen = [t for r in out for t in json.loads(r["payload"])["input"]]
    assert sorted(seen) == sorted(f"text {i}" for i in range(237))


def test_dim_check_and_mismatch_side_table(spark):
    resp = [(1, json.dumps({"data": [{"embedding": [0.1] * 4}, {"embedding": [0.2] * 3}]})), (2, json.dumps({"data": [{"embedding": [0.0] * 4}]}))]
    df = spark.createDataFrame(resp, "id long, response string")
    got = {r["dim"]: (r["n_vectors"], r["matches_declared"]) for r in enrich.embedding_dim_check(df, 4).collect()}
    assert got == {4: (2, True), 3: (1, False)}
    bad = [(r["id"], r["pos"], r["dim"]) for r in enrich.dim_mismatches(df, 4, "id").collect()]
    assert bad == [(1, 1, 3)]


def test_extract_locations(spark):
    chunks = spark.createDataFrame(
        [("c1", "The Ice Sheet near Sea Surface"), ("c2", "nothing"), ("c3", "sea surface sea"), ("c4", "New York-City hall is open"), ("c5", None), ("c6", "PARIS, paris")],
        "chunk_id string, chunk string",
    )
    gaz = spark.createDataFrame(
        [("ice sheet", "Ice Sheet"), ("sea surface", "Sea Surface"), ("sea", "Sea"), ("new york city hall", "City Hall"), ("Paris", "Paris (France)"), ("paris", "Paris (Texas)"), ("", "none"), (None, "none")],
        "term string, canonical string",
    )
    got = {r["chunk_id"]: r["locations"] for r in enrich.extract_locations(chunks, gaz).collect()}
    assert got == {
        "c1": ["Ice Sheet", "Sea", "Sea Surface"], "c2": [], "c3": ["Sea", "Sea Surface"], "c4": ["City Hall"], "c5": [],
        "c6": ["Paris (France)", "Paris (Texas)"],  # both names, terms and texts in any case
    }
    none = enrich.extract_locations(chunks, gaz.limit(0)).collect()
    assert len(none) == 6 and all(r["locations"] == [] for r in none)


def test_csv_round_trip_of_hard_texts(spark):
    texts = ["two\nlines", "", "  pad ", None, 'say "hi"', '"', "back\\slash", "\\", 'x\\"y', "a,b", "\r\n", "\t", "'", "NULL", "ü\u2028x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    path = io.csv_sink(df, tempfile.mkdtemp(prefix="kestrel-csv-") + "/out", index_col="id")
    back = {r["id"]: r["s"] for r in io.csv_scan(spark, path, schema="id int, s string").collect()}
    assert back == dict(enumerate(texts))


def test_a_failed_index_write_leaves_the_old_index(spark):
    d = tempfile.mkdtemp(prefix="kestrel-idx-")
    row = ("p", "t", "u", "f", ["x"], "k1", "c", [0.5, 0.5])
    schema = "parent_id string, title string, source_url string, source_file_name string, locations array<string>, chunk_id string, chunk string, text_vector array<double>"
    io.index_write(spark.createDataFrame([row], schema), d + "/i", dim=2)
    twice = spark.createDataFrame([row, row], schema)
    uneven = spark.createDataFrame([row, row[:5] + ("k2", "c", [0.5])], schema)
    three = spark.createDataFrame([row[:7] + ([1.0, 2.0, 3.0],)], schema)
    for bad in (twice, uneven, three):
        with pytest.raises(ValueError):
            io.index_write(bad, d + "/i", dim=2)
        assert [r["chunk_id"] for r in spark.read.parquet(d + "/i").collect()] == ["k1"]
    io.index_write(spark.createDataFrame([row[:5] + ("k9",) + row[6:]], schema), d + "/i", dim=2)
    assert [r["chunk_id"] for r in spark.read.parquet(d + "/i").collect()] == ["k9"]


def test_file_manifest_glob_and_recursion(spark):
    d = tempfile.mkdtemp(prefix="kestrel-files-")
    os.makedirs(os.path.join(d, "a", "b"))
    for rel, body in [("x.csv", "1"), ("y.pdf", "22"), ("a/z.csv", "333"), ("a/b/w.csv", "4444")]:
        with open(os.path.join(d, rel), "w") as f:
            f.write(body)
    top = {r["file_name"]: r["file_size"] for r in io.file_manifest(spark, d, "*.csv").collect()}
    assert top == {"x.csv": 1}
    deep = {r["file_name"]: r["file_size"] for r in io.file_manifest(spark, d, "*.csv", recursive=True).collect()}
    assert deep == {"x.csv": 1, "z.csv": 3, "w.csv": 4}
    plan = io.file_manifest(spark, d, "*.csv")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("]")[0]  # file bodies are not read


def test_upsert_leaves_no_stale_chunks(spark):
    current = spark.createDataFrame([("d1", "d1-0", "old"), ("d1", "d1-1", "old"), ("d2", "d2-0", "old"), ("d3", "d3-0", "kept")], "parent_id string, chunk_id string, chunk string")
    updates = spark.createDataFrame([("d4", "d4-0", "new")], current.schema)
    changed = spark.createDataFrame([("d1",), ("d2",), ("d4",)], "parent_id string")  # d1's text is blank now, d2 was deleted
    got = io.index_upsert(current, updates, changed=changed)
    assert sorted(tuple(r) for r in got.collect()) == [("d3", "d3-0", "kept"), ("d4", "d4-0", "new")]


def test_tokens_at_hand_are_tagged_without_a_shuffle_as_by_the_join(spark):
    from kestrel.functions.text import tokens

    rows = [
        ("c1", "The Ice Sheet near Sea Surface"), ("c2", "nothing"), ("c3", "ice ice sheet"), ("c4", "New York-City hall is open; new york"), ("c5", None),
        (None, "sea surface"), ("c7", "sea"), ("c7", "ice sheet"), ("c8", "ice"), ("c9", "sheet of ice"), ("c10", ""),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk string").repartition(2)
    gaz = spark.createDataFrame(
        [("ice sheet", "Ice Sheet"), ("Sea surface", "Sea Surface"), ("sea", "\u00e9tang"), ("sea", "Sea"), ("sea", "\U0001f30a"), ("sea", "\uffee"), ("new york city hall", "City Hall"), ("york", "York"), (None, "none")],
        "term string, canonical string",
    )
    with_toks = chunks.withColumn("toks", tokens("chunk"))
    names = lambda df: sorted(((r["chunk_id"] or "", r["chunk"] or "", r["locations"]) for r in df.collect()), key=str)
    want = names(enrich.extract_locations(chunks, gaz))
    assert names(enrich.extract_locations(with_toks, gaz, toks_col="toks")) == want
    assert ("", "sea surface", []) in want and ("c7", "sea", ["Ice Sheet", "Sea", "\u00e9tang", "\uffee", "\U0001f30a"]) in want
    plan = enrich.extract_locations(spark.range(20).selectExpr("cast(id as string) as chunk_id", "array('sea') as toks"), gaz, toks_col="toks")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_one_pass_tokenises_for_tags_and_vectors(spark):
    from kestrel.plans import fixtures as fx
    from tests.conftest import SF_SMALL

    plan = fx.chunk_index(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1
