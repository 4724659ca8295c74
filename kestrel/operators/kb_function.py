"""Retrieval as a named SQL function: ``search_knowledge_base(query)`` -> the best passages.

The function is a Spark SQL table function over a stored index: postings by part of the index and term, a
weight per term, and the passages (text, title, source URL), written as Parquet under the shared scratch
folder.  Called with ``LATERAL`` for a table of queries, it becomes one distributed plan.  Its ``LIMIT``
becomes a limit per query, which Spark applies in every task before the shuffle by query.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.text import term_counts, tokens
from kestrel.operators.blocks import best
from kestrel.session import bounded_batches, materialize, settle

#: Chunks of a part of the index, whose scores for a query are summed together.
PART_CHUNKS = 4096


def build_postings(index: DataFrame, key_col: str = "chunk_id", text_col: str = "chunk") -> DataFrame:
    """The postings of the chunk index, those of a chunk in one row: ``(chunk_id, dl, terms, tfs)``; a chunk without
    tokens keeps its row, so the postings alone describe every chunk (count and lengths).

    Only the texts are dealt out by key, so that rows of one key and length count as one chunk; terms are
    counted within the row and no posting is shuffled."""
    docs = index.select(key_col, text_col).repartition(key_col).select(key_col, tokens(F.col(text_col)).alias("toks"))
    merged = docs.groupBy(key_col, F.size("toks").alias("dl")).agg(F.flatten(F.collect_list("toks")).alias("toks"))
    return merged.select(key_col, "dl", term_counts(F.col("toks")).alias("c")).select(key_col, "dl", "c.terms", "c.tfs")


def invert_postings(postings: DataFrame, key_col: str = "chunk_id") -> DataFrame:
    """``build_postings`` by part of the index and term: ``(chunk_id_part, term, n, total, entries, keys)``.

    Rows of a partition are taken in key order, about ``PART_CHUNKS`` make a part, and rows of one key stay together.  A
    term's ``entries`` are pairs (row, count), ``n`` of them.  The row of the empty term describes the part: of each
    of its ``n`` rows the length and the number of its key (after the bytes of a number of an entry), the sum of the lengths, and
    the ``keys``."""
    key_type = postings.schema[key_col].dataType
    fields = [("chunk_id_part", T.LongType()), ("term", T.StringType()), ("n", T.IntegerType()), ("known", T.IntegerType()), ("total", T.LongType()), ("entries", T.BinaryType()), ("keys", T.ArrayType(key_type))]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def part(table: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        column = lambda c: table.column(c).chunk(0) if table.column(c).num_chunks else pa.array([], table.schema.field(c).type)
        keys = column(key_col).to_pylist()
        new = np.array([True] + [x != y for x, y in zip(keys, keys[1:])])
        dl, lists = column("dl").fill_null(0).to_numpy(zero_copy_only=False), column("terms")
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        codes = lists.flatten().dictionary_encode()
        code, tfs = codes.indices.to_numpy(zero_copy_only=False), column("tfs").flatten().to_numpy(zero_copy_only=False)
        kind = np.dtype(np.uint16 if max(len(keys), tfs.max(initial=0)) < 65536 else np.int32)
        held = np.concatenate(([kind.itemsize], dl, np.cumsum(new) - 1)).astype(np.int32)
        yield [number], [""], [len(keys)], [len(keys) - column("dl").null_count], [int(dl.sum(dtype=np.int64))], [held.tobytes()], [[k for k, first in zip(keys, new) if first]]
        by = np.argsort(code, kind="stable")
        pairs = np.stack([np.repeat(np.arange(len(keys)), lengths)[by], tfs[by]], axis=1).astype(kind)
        n = np.bincount(code, minlength=len(codes.dictionary))
        offsets = np.concatenate(([0], np.cumsum(n) * 2 * kind.itemsize)).astype(np.int32)
        entries = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])
        same = lambda x: np.full(len(n), x)
        yield same(number), codes.dictionary, n, same(0), same(0), entries, pa.nulls(len(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types, parts = to_arrow_schema(schema), 0
        made = lambda found: pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) if not isinstance(c, list) else pa.array(c, f.type) for c, f in zip(found, types)], schema=types)
        rows: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = PART_CHUNKS - sum(r.num_rows for r in rows)
                cut = min(max(room, 0), batch.num_rows)
                if cut == 0:  # full: rows of the key it ends with still belong to it
                    last, keys = rows[-1].column(key_col)[-1].as_py(), batch.column(key_col)
                    while cut < batch.num_rows and keys[cut].as_py() == last:
                        cut += 1
                    if cut == 0:
                        for found in part(pa.Table.from_batches(rows), (TaskContext.get().partitionId() << 32) + parts):
                            yield made(found)
                        parts, rows = parts + 1, []
                        continue
                rows.append(batch.slice(0, cut))
                batch = batch.slice(cut)
        if rows:
            for found in part(pa.Table.from_batches(rows), (TaskContext.get().partitionId() << 32) + parts):
                yield made(found)

    bounded_batches(postings.sparkSession)
    return postings.sortWithinPartitions(key_col).mapInArrow(run, schema)


def part_scorer(avgdl: float, top: int, k1: float, b: float):
    """A function of what a query finds in a part of the index, ``(term, idf, entries)`` with the part's own row: the chunks,
    by the number of their key, that can be among its ``top`` (in that order numbers stand for keys), with their scores."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("key_no", T.IntegerType()), T.StructField("score", T.DoubleType())])))
    def scored(hits: pa.Array) -> pa.Array:
        counts, places, values = [], [], []
        for hit in hits:
            found = hit.values
            terms, idf, entries = found.field("term").to_pylist(), found.field("idf").to_pylist(), found.field("entries")
            own = np.frombuffer(next(e.as_buffer() for t, e in zip(terms, entries) if t == ""), np.int32)
            kind, (dl, number) = np.uint16 if own[0] == 2 else np.int32, own[1:].reshape(2, -1)
            norm = k1 * (1.0 - b + b * dl / (avgdl or 1.0))
            score = np.zeros(number[-1] + 1)
            pairs = [np.frombuffer(e.as_buffer(), kind).reshape(-1, 2).astype(np.int64) for t, e in zip(terms, entries) if t != ""]
            if pairs:
                row, tf = np.concatenate(pairs).T
                weight = np.repeat([w for t, w in zip(terms, idf) if t != ""], [len(p) for p in pairs])
                score = np.bincount(number[row], weights=weight * (tf * (k1 + 1.0) / (tf + norm[row])), minlength=len(score))
            at = best(np.where(score > 0, score, -np.inf)[None, :], None, top, np.arange(len(score)))[0]
            counts.append(len(at))
            places.append(at.astype(np.int32))
            values.append(score[at])
        rows = [np.concatenate(x) if x else np.zeros(0) for x in (places, values)]
        struct = pa.StructArray.from_arrays([pa.array(rows[0].astype(np.int32)), pa.array(rows[1])], ["key_no", "score"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), struct)

    return scored


def store_inverted_index(spark: SparkSession, index: DataFrame, key_col: str = "chunk_id", text_col: str = "chunk", passage_cols: tuple[str, ...] = ("chunk", "title", "source_url"),
                         k1: float = 1.2, b: float = 0.75) -> dict[str, str]:
    """Write the postings once (the text is tokenised only here), derive the weight of every term from the written
    table, store both with the passages, and register them as temp views.  The view of the postings deals
    parts of the index to tasks, so that the scores of a chunk are summed where its postings are read; a row is a term's
    postings in a part, not a posting."""
    tag = uuid.uuid4().hex[:8]
    stored = settle(invert_postings(build_postings(index, key_col, text_col), key_col), "kb-postings")
    whole = F.col("term") == ""
    stats = stored.where(whole).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("known").alias("known"), F.sum("total").alias("total")).first()  # one row
    n, avgdl = stats["n"], float(stats["total"] / stats["known"]) if stats["known"] else 0.0
    dfreq = stored.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.when(whole, F.lit(0.0)).otherwise(F.log(1.0 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    terms = settle(dfreq.select("term", idf.alias("idf")), "kb-terms")
    parts = max(spark.sparkContext.defaultParallelism, -(-n // PART_CHUNKS))
    postings = stored.select("chunk_id_part", "term", "entries").repartition(parts, "chunk_id_part")
    chunks = stored.where(whole).select("chunk_id_part", F.posexplode("keys").alias("key_no", "chunk_id"))
    passages = materialize(index.select(F.col(key_col).alias("chunk_id"), *passage_cols), "kb-passages")
    views = {"postings": f"kb_postings_{tag}", "passages": f"kb_passages_{tag}", "terms": f"kb_terms_{tag}", "chunks": f"kb_chunks_{tag}"}
    postings.createOrReplaceTempView(views["postings"])
    chunks.createOrReplaceTempView(views["chunks"])
    passages.createOrReplaceTempView(views["passages"])
    terms.createOrReplaceTempView(views["terms"])
    _SCORING[views["postings"]] = (avgdl, k1, b)
    return views


#: Of a view of postings: mean length and constants, which its scores need.
_SCORING: dict[str, tuple[float, float, float]] = {}


def search_with_function(spark: SparkSession, queries: DataFrame, function: str) -> DataFrame:
    """Call the table function for every row of ``queries (query_id, query_text)``."""
    view = f"kb_queries_{uuid.uuid4().hex[:8]}"
    queries.select("query_id", "query_text").createOrReplaceTempView(view)
    return spark.sql(f"SELECT q.query_id, k.chunk_id, k.passage, k.title, k.source_url, k.score, k.rank FROM {view} q, LATERAL {function}(q.query_text) k")


def register_search_function(spark: SparkSession, views: dict[str, str], name: str | None = None, top: int = 5) -> str:
    """Create ``name(query STRING) RETURNS TABLE(chunk_id, passage, title, source_url, score, rank)``: BM25 over
    the stored index, ranked by rounded score then chunk id, first ``top``.  Each index gets a function
    of its own (the default name ends with the index's tag), so several can be in use."""
    name = name or "search_knowledge_base_" + views["postings"].rsplit("_", 1)[1]
    split = r"'[^\\p{L}\\p{N}]+'"
    avgdl, k1, b = _SCORING[views["postings"]]
    bounded_batches(spark)
    spark.udf.register(f"{name}_scores", part_scorer(avgdl, top, k1, b))
    spark.sql(
        f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING)
RETURNS TABLE(chunk_id STRING, passage STRING, title STRING, source_url STRING, score DOUBLE, rank INT)
RETURN
SELECT /*+ BROADCAST(r) */ r.chunk_id, d.chunk, d.title, d.source_url, round(r.score, 6), CAST(r.rank AS INT) FROM (
  SELECT chunk_id, score, row_number() OVER (ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM (
    SELECT c.chunk_id, f.score FROM (
      SELECT chunk_id_part, inline({name}_scores(hits)) FROM (
        SELECT /*+ BROADCAST(a) */ p.chunk_id_part, collect_list(struct(a.term, a.idf, p.entries)) AS hits
        FROM (SELECT qt.term, t.idf
              FROM (SELECT explode(concat(array(''), array_distinct(filter(split(lower(query), {split}), t -> t <> '')))) AS term) qt
              JOIN {views["terms"]} t ON t.term = qt.term) a
        JOIN {views["postings"]} p ON p.term = a.term
        GROUP BY p.chunk_id_part)) f
    JOIN {views["chunks"]} c ON c.chunk_id_part = f.chunk_id_part AND c.key_no = f.key_no
    ORDER BY round(score, 6) DESC, chunk_id LIMIT {top})) r
JOIN {views["passages"]} d ON d.chunk_id = r.chunk_id
"""
    )
    return name
