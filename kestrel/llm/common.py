"""Shared helpers of the llm operators: safe column handling, scratch tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.session import ARROW_BYTES, ARROW_ROWS, bounded_batches, materialize, table_path  # noqa: F401

def tidied(batches: Iterator) -> Iterator:
    """The batches; now and then, and after the last one, memory that Python and Arrow hold free goes back to the system.

    Workers live as long as their executor and serve one stage after the other, so what each stage leaves adds up."""
    import ctypes

    import pyarrow as pa

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for n, batch in enumerate(batches, 1):
        yield batch
        if n % 64 == 0 and trim:
            trim(0)
    pa.default_memory_pool().release_unused()
    if trim:
        trim(0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def crc32_mod(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def hash_sample(rows: DataFrame, group: str, doc_id: str, per_group: int) -> DataFrame:
    """At most ``per_group`` rows (doc_id, group) of each group, those with the smallest id hashes.

    Counts per group, a combinable aggregate, give each group a hash threshold that lets about 1.5 times
    the bound through, so the window that cuts at the bound never holds a whole large group.  The counts, one
    row per group, are broadcast: the caller takes ``per_group`` rows of each group to one place anyway.
    """
    u = F.pmod(F.xxhash64(doc_id), F.lit(1 << 40)) / float(1 << 40)
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    near = rows.join(F.broadcast(sizes), group).filter(u * F.col("group_size") <= 1.5 * per_group + 50)
    order = Window.partitionBy(group).orderBy(u, doc_id)
    return near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_group).select(doc_id, group)


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b, long): label is the smallest node reachable.

    Contraction by a random order.  In each round every node points to the node of its closed neighbourhood
    that comes first in an order drawn anew by hashing; nodes that point to the same one become one, and the
    links between what is left are taken on.  Whatever the shape of the graph and the numbers of its nodes, a
    round is expected to remove at least a quarter of the nodes that still have links (a third or more on chains),
    so the rounds grow with the logarithm of the number of nodes and all rounds together cost a few times the
    first.  The smallest neighbour is a combinable ``min``: a node with very many links is pre-aggregated.
    Every round is written to the shared scratch folder, which cuts the lineage and survives lost executors.
    """
    links = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    links = materialize(links, "cc-links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        seed = F.lit(len(rounds))
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("n"))).alias("near"))
        own = F.struct(F.xxhash64("node", seed).alias("h"), F.col("node").alias("n"))
        to = materialize(first.select("node", F.least("near", own)["n"].alias("to")), "cc-round")
        rounds.append(to)
        a, b = (to.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        moved = links.join(a, "a").join(b, "b").filter("to_a <> to_b")
        links = materialize(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "cc-links")
    if not rounds:
        return nodes.select("node", F.col("node").alias("label"))
    ends = rounds[-1]
    for to in reversed(rounds[:-1]):  # where a node's target went in the later rounds
        later = ends.select(F.col("node").alias("to"), F.col("to").alias("end"))
        ends = materialize(to.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to")), "cc-ends")
    smallest = ends.groupBy("to").agg(F.min("node").alias("label"))
    named = ends.join(smallest, "to").select("node", "label")
    return nodes.join(named, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
