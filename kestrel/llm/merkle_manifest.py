"""Merkle manifest of a dataset: one tree per group, one over the groups' roots, and a proof for every row.

Rows are leaves.  Within a group they ascend by id; every ``ARITY`` consecutive nodes become one of the next
level, up to the group's root; the groups' roots, in order, are the leaves of the top tree.  Built levels are
stored as node rows that name their parent, and a recursive Spark query climbs these links: it appends the
siblings met and folds the (maybe tampered) leaf hash up to the root.

How it stays even.  Positions come from one range-partitioned sort, so a group that holds most rows is many
tasks' work.  The leaves of one bottom run share all siblings above it, so a run climbs as one row with its
leaves' hashes.  Near the root all runs meet the same few nodes: a node with many runs below it is stored in
several copies, and a run joins the copy that its hash names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import materialize

ARITY = 8
RUNS_PER_COPY = 512  # bottom runs that meet one copy of a node, and
MAX_COPIES = 4096  # copies at most (one join key holds more runs beyond, over as many tasks)
TOP = -1  # number of the tree over the groups' roots


def field(value: Column) -> Column:
    """A value as it enters a leaf: its length in UTF-8 bytes, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other characters kept."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds to each row its place (from 0) within its group, the group's size and the group's number, groups and rows
    ascending (nulls first, strings bytewise).  ``order`` must tell all rows of a group apart.

    One range-partitioned sort; then only sizes of (partition, group) pieces are summed, by windows over the
    pieces of one group, or of one partition, or one row per partition.
    """
    sorted_rows = rows.repartitionByRange(F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order))
    sorted_rows = sorted_rows.sortWithinPartitions(F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order))
    # Partition number in the upper bits, row number within it in the lower 33.
    stored = materialize(sorted_rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "merkle-sorted")

    pieces = stored.groupBy("part", group).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    of_group = Window.partitionBy(group).orderBy("part")
    pieces = pieces.withColumn("before", F.sum("rows").over(of_group) - F.col("rows")).withColumn("size", F.sum("rows").over(Window.partitionBy(group)))
    pieces = pieces.withColumn("starts", (F.row_number().over(of_group) == 1).cast("long"))
    pieces = pieces.withColumn("nth", F.sum("starts").over(Window.partitionBy("part").orderBy("first")))
    begun = pieces.groupBy("part").agg(F.sum("starts").alias("starts"))
    begun = begun.select("part", (F.sum("starts").over(Window.orderBy("part")) - F.col("starts")).alias("begun"))  # a row per partition
    pieces = pieces.join(begun, "part").withColumn("number", F.when(F.col("starts") == 1, F.col("begun") + F.col("nth") - 1))
    pieces = pieces.withColumn("number", F.min("number").over(Window.partitionBy(group)))

    p = pieces.select(F.col("part").alias("p_part"), F.col(group).alias("p_group"), "first", "before", "size", "number")
    placed = stored.join(p, (F.col("part") == F.col("p_part")) & F.col(group).eqNullSafe(F.col("p_group")))
    return placed.withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "p_part", "p_group", "first", "before")


def levels(base: DataFrame, name: str) -> list[DataFrame]:
    """Node rows of every level: tree, level, idx, digest, kids, below (bottom runs), n (nodes of this level in the tree).

    ``base`` is level 1.  A level is a grouped sum over runs of ``ARITY`` nodes of the one before; each is stored.
    """
    out = [materialize(base, f"{name}-1")]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        runs = out[-1].filter("n > 1").groupBy("tree", F.expr(f"idx div {ARITY}").alias("up"))
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]), "")
        up = runs.agg(kids.alias("kids"), F.sum("below").alias("below"), F.max("n").alias("n"))
        up = up.select(
            "tree", F.lit(len(out) + 1).alias("level"), F.col("up").alias("idx"), F.sha2("kids", 256).alias("digest"), "kids", "below",
            F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"),
        )
        out.append(materialize(up, f"{name}-{len(out) + 1}"))
    return out


def _copies() -> Column:
    return F.least(F.lit(MAX_COPIES), F.ceil(F.col("below") / RUNS_PER_COPY)).cast("int")


def _linked(trees: DataFrame, tops: DataFrame) -> DataFrame:
    """Node rows with the link to their parent (up_tree, up_level, up_idx), their place among its children (turn) and the
    number of its copies; a group's root is child ``tree`` of the top tree; the link of the one root is null."""
    alone = F.col("n") == 1
    trees = trees.withColumns({
        "up_tree": F.when(alone, F.lit(TOP).cast("long")).otherwise(F.col("tree")),
        "up_level": F.when(alone, F.lit(2)).otherwise(F.col("level") + 1),
        "slot": F.when(alone, F.col("tree")).otherwise(F.col("idx")),
    })
    tops = tops.withColumns({"up_tree": F.col("tree"), "up_level": F.col("level") + 1, "slot": F.col("idx")})
    both = trees.unionByName(tops.filter("level > 1"))
    both = both.withColumn("up_idx", F.expr(f"slot div {ARITY}")).withColumn("turn", F.expr(f"cast(slot % {ARITY} as int)")).drop("slot")
    parents = trees.select("tree", "level", "idx", "below").unionByName(tops.filter("level > 1").select("tree", "level", "idx", "below"))
    parents = parents.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), _copies().alias("up_copies"))
    return both.join(parents, ["up_tree", "up_level", "up_idx"], "left")


CLIMB = """
WITH RECURSIVE climb(tree, run, up_tree, up_level, up_idx, turn, up_copies, folded, siblings, subroot) AS (
  SELECT tree, run, up_tree, up_level, up_idx, turn, up_copies, folded, siblings, subroot FROM {starts}
  UNION ALL
  SELECT c.tree, c.run, n.up_tree, n.up_level, n.up_idx, n.turn, n.up_copies,
    transform(c.folded, f -> unhex(sha2(concat(substring(n.kids, 1, 64 * c.turn), lower(hex(f)), substring(n.kids, 64 * c.turn + 65)), 256))),
    concat(c.siblings, unhex(concat(substring(n.kids, 1, 64 * c.turn), substring(n.kids, 64 * c.turn + 65)))),
    CASE WHEN n.tree = {top} AND c.subroot IS NULL THEN unhex(substring(n.kids, 64 * c.turn + 1, 64)) ELSE c.subroot END
  FROM climb c JOIN {nodes} n
    ON n.tree = c.up_tree AND n.level = c.up_level AND n.idx = c.up_idx AND n.copy = pmod(xxhash64(c.tree, c.run), c.up_copies)
)
SELECT tree, run, folded, siblings, subroot FROM climb WHERE up_copies IS NULL LIMIT ALL
"""


def manifest(docs: DataFrame, fields: list[str], group: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``fields`` are the columns that enter a leaf, in order.  Tampered rows are those whose crc32(doc_id as text)
    3 divides: there the climb starts from the leaf of the text with A-Z lower-cased; all siblings are the
    originals.  ``folded_root`` is where it ends and ``verified`` says whether that is ``root``.

    A null group is a group of its own, the first; a null id (never tampered) comes first in its group; rows
    of one id ascend by leaf hash, equal rows in the order they were stored.  An empty text is a field of
    length 0, a null one ``-``.  A single leaf is its group's root, and a single group's root is the root.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    changed = (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0) & (F.col(text) != lower_ascii(F.col(text)))
    tampered = leaf_hash([lower_ascii(F.col(c)) if c == text else F.col(c) for c in fields])
    leaves = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(group).alias("grp"), leaf_hash([F.col(c) for c in fields]).alias("leaf"), F.when(changed, tampered).alias("tampered")
    )
    leaves = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    placed = positions(leaves, "grp", ["doc_id", "leaf", "row"])

    # Bottom runs: the leaves of a run, its node, and each leaf folded once.
    member = F.struct("place", "doc_id", F.unhex("leaf").alias("leaf"), F.unhex("tampered").alias("tampered"))
    runs = placed.groupBy(F.col("number").alias("tree"), F.expr(f"place div {ARITY}").alias("run")).agg(
        F.array_sort(F.collect_list(member)).alias("members"), F.max("size").alias("size")
    )
    runs = runs.withColumn("kids", F.array_join(F.transform("members", lambda m: F.lower(F.hex(m["leaf"]))), ""))
    runs = materialize(runs, "merkle-runs")
    base = runs.select(
        "tree", F.lit(1).alias("level"), F.col("run").alias("idx"), F.when(F.col("size") == 1, F.col("kids")).otherwise(F.sha2("kids", 256)).alias("digest"),
        "kids", F.lit(1).cast("long").alias("below"), F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("n"),
    )
    trees = levels(base, "merkle-tree")
    all_trees = trees[0]
    for level in trees[1:]:
        all_trees = all_trees.unionByName(level)
    subroots = all_trees.filter("n = 1").select(F.lit(TOP).cast("long").alias("tree"), F.lit(1).alias("level"), F.col("tree").alias("idx"), "digest", F.col("digest").alias("kids"), "below")
    n_groups = subroots.count()
    tops = levels(subroots.withColumn("n", F.lit(n_groups).cast("long")), "merkle-top")
    all_tops = tops[0]
    for level in tops[1:]:
        all_tops = all_tops.unionByName(level)
    if not n_groups:
        none = F.lit(None).cast("string")
        return leaves.select("doc_id", "leaf", none.alias("subroot"), none.alias("root"), none.alias("proof_sha256"), none.alias("folded_root"), F.lit(None).cast("boolean").alias("verified"))
    root = tops[-1].first()["digest"]  # one row

    linked = materialize(_linked(all_trees, all_tops), "merkle-nodes")
    nodes = linked.filter("level > 1").withColumn("copy", F.explode(F.sequence(F.lit(0), _copies() - 1)))
    only = F.col("size") == 1
    fold = F.when(only, F.transform("members", lambda m: F.coalesce(m["tampered"], m["leaf"]))).otherwise(
        F.transform("members", lambda m, i: F.unhex(F.sha2(F.concat(
            F.substring("kids", F.lit(1), 64 * i), F.lower(F.hex(F.coalesce(m["tampered"], m["leaf"]))), F.substring("kids", 64 * i + 65, F.lit(64 * ARITY))
        ), 256)))
    )
    starts = runs.select("tree", "run", fold.alias("folded")).join(
        linked.filter("level = 1").select("tree", F.col("idx").alias("run"), "up_tree", "up_level", "up_idx", "turn", "up_copies"), ["tree", "run"]
    )
    starts = starts.withColumn("siblings", F.lit(b"")).withColumn("subroot", F.lit(None).cast("binary"))
    names = {"starts": "kestrel_merkle_starts", "nodes": "kestrel_merkle_nodes"}
    materialize(starts, "merkle-starts").createOrReplaceTempView(names["starts"])
    materialize(nodes, "merkle-copies").createOrReplaceTempView(names["nodes"])
    climbed = materialize(spark.sql(CLIMB.format(top=TOP, **names)), "merkle-climbed")

    each = runs.join(climbed, ["tree", "run"]).select("size", "kids", "folded", "siblings", "subroot", F.posexplode("members").alias("i", "m"))
    own = F.when(only, F.lit("")).otherwise(F.concat(F.substring("kids", F.lit(1), 64 * F.col("i")), F.substring("kids", 64 * F.col("i") + 65, F.lit(64 * ARITY))))
    folded = F.lower(F.hex(F.get("folded", F.col("i"))))
    return each.select(
        F.col("m.doc_id").alias("doc_id"), F.lower(F.hex("m.leaf")).alias("leaf"), F.coalesce(F.lower(F.hex("subroot")), F.lit(root)).alias("subroot"), F.lit(root).alias("root"),
        F.sha2(F.concat(own, F.lower(F.hex("siblings"))), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"),
    )


#: The manifest of ``documents`` in DuckDB.  It has no crc32, so the checksum is worked out bit by bit.
ORACLE_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, text,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda s, x: list_reduce(list_prepend(xor(s, x), list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda t, i: xor(t >> 1, 3988292384 * (t & 1)))), 4294967295) % 3 = 0 AS hit
  FROM documents
), h AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS tampered FROM f
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS r FROM h
), lev AS (
  SELECT 0 AS level, tree, idx, n, leaf AS digest, '' AS kids FROM leaves
  UNION ALL
  SELECT level + 1, tree, idx // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)), string_agg(digest, '' ORDER BY idx)
  FROM lev WHERE n > 1 GROUP BY level, tree, idx // 8
), top AS (
  SELECT 0 AS level, tree AS idx, count(*) OVER () AS n, digest, '' AS kids FROM lev WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)), string_agg(digest, '' ORDER BY idx)
  FROM top WHERE n > 1 GROUP BY level, idx // 8
), c AS (
  SELECT r, tree, 0 AS level, idx, n, coalesce(tampered, leaf) AS fold, '' AS sib FROM leaves
  UNION ALL
  SELECT c.r, c.tree, c.level + 1, c.idx // 8, p.n, sha256(substr(p.kids, 1, 64 * (c.idx % 8)) || c.fold || substr(p.kids, 64 * (c.idx % 8) + 65)),
    c.sib || substr(p.kids, 1, 64 * (c.idx % 8)) || substr(p.kids, 64 * (c.idx % 8) + 65)
  FROM c JOIN lev p ON p.tree = c.tree AND p.level = c.level + 1 AND p.idx = c.idx // 8 WHERE c.n > 1
), d AS (
  SELECT c.r, c.tree, 0 AS level, t.idx, t.n, c.fold, c.sib, t.digest AS subroot FROM c JOIN top t ON c.n = 1 AND t.level = 0 AND t.idx = c.tree
  UNION ALL
  SELECT d.r, d.tree, d.level + 1, d.idx // 8, p.n, sha256(substr(p.kids, 1, 64 * (d.idx % 8)) || d.fold || substr(p.kids, 64 * (d.idx % 8) + 65)),
    d.sib || substr(p.kids, 1, 64 * (d.idx % 8)) || substr(p.kids, 64 * (d.idx % 8) + 65), d.subroot
  FROM d JOIN top p ON p.level = d.level + 1 AND p.idx = d.idx // 8 WHERE d.n > 1
)
SELECT l.doc_id, l.leaf, d.subroot, t.digest AS root, sha256(d.sib) AS proof_sha256, d.fold AS folded_root, d.fold = t.digest AS verified
FROM leaves l JOIN d ON d.r = l.r AND d.n = 1 JOIN top t ON t.n = 1
"""
