"""Change sets between two stored manifests, by a tree of range hashes over the key space.

A manifest holds one row per key: ``(key, hash, version)``.  Keys are placed at a 64-bit position (their
XXH64), so any key distribution fills the ranges evenly.  A node of level ``l`` covers the positions
that share their first ``4 * l`` bits and holds three combinable digests of its rows.  Two manifests are
compared from the root down: only children of nodes that differ are looked at.  Rows are read from the
folders (256 at most) that hold a range that differs, and joined with those ranges.  Equal manifests
cost the comparison of two roots.

A range in which rows differ is taken for equal only if its count, the XOR of one 64-bit hash and the
sum of another all agree by chance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kestrel.session import materialize, scratch_path

LEVEL_BITS = 4
MAX_DEPTH = 7
#: Rows lie in folders by the first bits of their position: at most 256, so the list of those to read is bounded.
PART_BITS = 8
DIGESTS = ("n", "x", "s")


@dataclass(frozen=True)
class Manifest:
    """A stored manifest: ``path/rows`` (by part, sorted by position) and ``path/nodes`` (by level)."""

    path: str
    depth: int
    n_rows: int
    schema: StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def nodes(self, spark: SparkSession, level: int) -> DataFrame:
        schema = "level int, node long, n long, x long, s decimal(38,0)"
        return spark.read.schema(schema).parquet(f"{self.path}/nodes").where(F.col("level") == level).select("node", *DIGESTS)


@dataclass(frozen=True)
class ChangeSet:
    """``changes``: ``key, hash, action, version``; ``share_read``: rows in the ranges that differ, of all rows of both manifests."""

    changes: DataFrame
    share_read: float


def _node(position: Column, level: int) -> Column:
    return F.shiftrightunsigned(position, 64 - LEVEL_BITS * level) if level else F.lit(0).cast("long")


def write_manifest(items: DataFrame, key: str, hash_col: str = "hash", version_col: str | None = None, path: str | None = None, leaf_rows: int = 4096) -> Manifest:
    """Store ``items`` as a manifest whose lowest ranges hold about ``leaf_rows`` rows.

    Hashes compare without case and are kept in lower case.  Rows without a key take no part.  Of a key on
    several rows the one of the highest version, then the largest hash counts (a combinable ``max``, so a
    key on a third of all rows costs one partial row a task).  Without ``version_col`` versions are 1; a null
    hash is a value like any other."""
    spark = items.sparkSession
    path = path or scratch_path(spark, "manifest")
    version = F.col(version_col).cast("int") if version_col else F.lit(1)
    best = F.max(F.struct(version.alias("version"), F.lower(F.col(hash_col)).alias("hash"))).alias("best")
    rows = items.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(best)
    position = F.xxhash64(F.col("key").cast("string"))
    rows = rows.select("key", "best.hash", "best.version", position.alias("position"), F.shiftrightunsigned(position, 64 - PART_BITS).cast("int").alias("part"))
    rows.repartitionByRange("part", "position").sortWithinPartitions("part", "position").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    n = stored.count()
    depth = next((d for d in range(MAX_DEPTH) if leaf_rows << (LEVEL_BITS * d) >= n), MAX_DEPTH)
    mark = F.struct("key", "hash")
    digests = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.lit("x"), mark)).alias("x"), F.sum(F.xxhash64(F.lit("s"), mark).cast("decimal(20,0)")).cast("decimal(38,0)").alias("s"))
    # Leaves from the rows, then each level from the one below it: every level is a sixteenth of the last.
    level = stored.groupBy(_node(F.col("position"), depth).alias("node")).agg(*digests)
    for d in range(depth, -1, -1):
        level.write.mode("overwrite").parquet(f"{path}/nodes/level={d}")
        below = spark.read.parquet(f"{path}/nodes/level={d}")
        up = F.shiftrightunsigned("node", LEVEL_BITS).alias("node")
        level = below.groupBy(up).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").cast("decimal(38,0)").alias("s"))
    return Manifest(path, depth, n, rows.schema)


def differing_ranges(spark: SparkSession, current: Manifest, previous: Manifest) -> tuple[DataFrame, int]:
    """``(node, n)`` of the lowest ranges that differ, and their level; ``n`` counts the rows of both sides.

    Each level's differing nodes are written before the next is compared; the descent ends at once where
    none differ."""
    depth = min(current.depth, previous.depth)
    found = None
    for level in range(depth + 1):
        a, b = current.nodes(spark, level), previous.nodes(spark, level)
        if found is not None:
            parents = found.select(F.col("node").alias("parent"))
            parent = F.shiftrightunsigned("node", LEVEL_BITS) == F.col("parent")
            a, b = a.join(parents, parent, "left_semi"), b.join(parents, parent, "left_semi")
        a, b = (side.select("node", F.struct(*DIGESTS).alias(name)) for side, name in ((a, "a"), (b, "b")))
        differ = a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        found = materialize(differ.select("node", (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n")), "ranges")
        if found.isEmpty():
            break
    return found, level


def change_set(spark: SparkSession, current: Manifest, previous: Manifest) -> ChangeSet:
    """What must be done to get from ``previous`` to ``current``: ``new`` (version 1), ``update`` (hash differs:
    version + 1) and ``delete`` (the key is gone; hash and version as last recorded).  Keys not in the result
    are unchanged.  Two empty manifests, or equal ones, give no rows and read none."""
    ranges, level = differing_ranges(spark, current, previous)
    total = current.n_rows + previous.n_rows
    share = (ranges.agg(F.sum("n")).first()[0] or 0) / total if total else 0.0
    shift = PART_BITS - LEVEL_BITS * level
    if shift >= 0:
        parts = F.explode(F.sequence(F.col("node") * (1 << shift), (F.col("node") + 1) * (1 << shift) - 1))
    else:
        parts = F.shiftrightunsigned("node", -shift)
    wanted = [r[0] for r in ranges.select(parts.alias("part")).distinct().collect()]  # 256 at most

    def read(manifest: Manifest) -> DataFrame:
        position = _node(F.col("position"), level)
        return manifest.rows(spark).where(F.col("part").isin(wanted)).join(ranges, position == F.col("node"), "left_semi")

    now = read(current).select("key", "hash", F.lit(True).alias("is_now"))
    was = read(previous).select("key", F.col("hash").alias("old_hash"), F.col("version").alias("old_version"), F.lit(True).alias("was"))
    both = now.join(was, "key", "full_outer")
    action = F.when(F.col("was").isNull(), "new").when(F.col("is_now").isNull(), "delete").when(~F.col("hash").eqNullSafe(F.col("old_hash")), "update")
    version = F.when(F.col("was").isNull(), 1).when(F.col("is_now").isNull(), F.col("old_version")).otherwise(F.col("old_version") + 1)
    kept_hash = F.when(F.col("is_now").isNull(), F.col("old_hash")).otherwise(F.col("hash"))
    out = both.select("key", kept_hash.alias("hash"), action.alias("action"), version.cast("int").alias("version")).where(F.col("action").isNotNull())
    return ChangeSet(out, share)
