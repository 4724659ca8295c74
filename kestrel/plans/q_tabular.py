"""Queries: CSV sources and sinks, file listings, null handling, the wrangle job."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import wrangle as W
from kestrel.plans import fixtures as fx
from kestrel.plans.registry import query
from kestrel.session import read_table, scratch_path
from kestrel.sources import io

# The same null-injection rule in SQL (see fixtures.customer_with_nulls).
CUSTOMER_NULLS = """cn AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS c_name,
         c_nationkey,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""


# Fixed values (test design): texts that a CSV file must carry unchanged, by c_custkey modulo 13.
_HARD = {0: "two\nlines", 1: "", 2: "  padded ", 3: 'a "quoted" word', 4: "back\\slash", 5: "comma, and \"", 6: "\r\nstart", 7: "'", 8: "\t"}


def _hard_sql(c: str) -> str:
    parts = [f"WHEN {i} THEN '" + t.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for i, t in _HARD.items()]
    return f"CASE c_custkey % 13 {' '.join(parts)} ELSE {c} END"


def _hard(c: str):
    out = F.col(c)
    for i, t in _HARD.items():
        out = F.when(F.col("c_custkey") % 13 == i, F.lit(t)).otherwise(out)
    return out


@query("csv_scan", f"SELECT c_custkey, {_hard_sql('c_name')} AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, sf_dir):
    """customer, some names with line ends, quotes, blanks or nothing in them, written as CSV to the shared
    scratch folder and read back with an explicit schema."""
    src = read_table(spark, sf_dir, "customer").withColumn("c_name", _hard("c_name"))
    path = io.csv_sink(src, scratch_path(spark, "customer-csv"))
    return io.csv_scan(spark, path, schema=src.schema, index_col="c_custkey")


@query("csv_sink", "WITH " + CUSTOMER_NULLS + f" SELECT c_custkey, {_hard_sql('c_name')} AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM cn")
def csv_sink(spark, sf_dir):
    """customer with nulls and hard texts written through the sink (index column first, header) and read back."""
    df = fx.customer_with_nulls(spark, sf_dir).withColumn("c_name", _hard("c_name"))
    path = io.csv_sink(df, scratch_path(spark, "csv-sink"), index_col="c_custkey")
    return io.csv_scan(spark, path, schema=df.schema, index_col="c_custkey")


@query("fill_null_literal", "WITH " + CUSTOMER_NULLS + " SELECT c_custkey, c_name, c_nationkey, c_acctbal, coalesce(c_mktsegment, 'None') AS c_mktsegment FROM cn")
def fill_null_literal(spark, sf_dir):
    return W.fill_null_literal(fx.customer_with_nulls(spark, sf_dir), {"c_mktsegment": "None"})


@query(
    "drop_null_rows",
    "WITH " + CUSTOMER_NULLS + " SELECT * FROM cn WHERE c_name IS NOT NULL AND c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL",
)
def drop_null_rows(spark, sf_dir):
    return W.drop_null_rows(fx.customer_with_nulls(spark, sf_dir), index_col="c_custkey")


@query(
    "impute_mean",
    "WITH " + CUSTOMER_NULLS + " SELECT c_custkey, c_name, c_nationkey, coalesce(c_acctbal, round((SELECT avg(c_acctbal) FROM cn), 6)) AS c_acctbal, c_mktsegment FROM cn",
)
def impute_mean(spark, sf_dir):
    return W.impute_mean(fx.customer_with_nulls(spark, sf_dir), ["c_acctbal"], decimals=6)


@query(
    "wrangle",
    "WITH " + CUSTOMER_NULLS + f", h AS (SELECT c_custkey, {_hard_sql('c_name')} AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM cn)"
    " SELECT c_custkey, c_name, c_nationkey, c_acctbal, coalesce(c_mktsegment, 'None') AS c_mktsegment FROM h "
    "WHERE c_name IS NOT NULL AND c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL",
)
def wrangle(spark, sf_dir):
    """CSV in -> fill c_mktsegment ('Cabin' role) -> drop rows with nulls left -> CSV out -> read back."""
    df = fx.customer_with_nulls(spark, sf_dir).withColumn("c_name", _hard("c_name"))
    src = io.csv_sink(df, scratch_path(spark, "wrangle-in"))
    return W.wrangle(spark, src, scratch_path(spark, "wrangle-out"), {"c_mktsegment": "None"}, "c_custkey", schema=df.schema)


@query(
    "file_manifest",
    """SELECT part || '.txt' AS file_name, CAST(sum(strlen(text)) + count(*) AS BIGINT) AS file_size
FROM (SELECT lang || '-' || source AS part, text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL) GROUP BY part""",
)
def file_manifest(spark, sf_dir):
    """``documents`` written as text files, one folder per language and source; the manifest gives each file's
    size without reading it, summed by folder."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null and lang is not null and source is not null")
    path = scratch_path(spark, "manifest-files")
    part = F.concat_ws("-", "lang", "source").alias("part")
    docs.select(part, F.col("text").alias("value")).write.partitionBy("part").text(path)
    files = io.file_manifest(spark, path, "*.txt", recursive=True)
    name = F.concat(F.regexp_extract("file_path", "part=([^/]+)/", 1), F.lit(".txt"))
    return files.groupBy(name.alias("file_name")).agg(F.sum("file_size").alias("file_size"))
