"""Keyword retrieval over a stored inverted index: impact-ordered postings in blocks with a maximum each.

The index holds, for each term, its chunks in falling order of impact (the term's share of a BM25 score without
its idf), in blocks of ``BLOCK`` postings with the largest impact of the block; and for each chunk its terms.
A batch of queries is answered exactly without reading most postings:

1. *A floor for the k-th score.*  The k-th largest impact of any one term is a floor, and so is the k-th best exact
   score among the chunks that hold a query's rarest terms.
2. *Candidates.*  Terms whose largest possible scores together stay below the floor are left aside: a chunk with
   only those cannot be among the best.  Of each other term only postings count whose impact, with all other terms
   at their largest, reaches the floor; as lists fall, whole blocks are skipped by their maximum.
3. *Exact scores* of the candidates that can still reach the floor, from the chunks' own term lists.

Lists are cut into parts by chunk (``PART_CHUNKS`` chunks to a part), so a term that a third of all chunks hold is
many bounded lists, each ordered, skipped and joined on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.text import term_counts, tokens
from kestrel.operators.blocks import SCORE_DECIMALS
from kestrel.session import materialize

BLOCK = 128
PART_CHUNKS = 32_768
SLACK = 2e-6  # scores are ranked after rounding to 6 decimals, so near-ties with the floor must stay


@dataclass
class Postings:
    """A stored index: ``blocks`` (term, part, block, largest, n, chunks, impacts), ``terms`` (term, df, largest) and
    ``chunks`` (chunk, key, terms, tfs, norm), with the number of chunks, the name of the key column and BM25's k1."""

    blocks: DataFrame
    terms: DataFrame
    chunks: DataFrame
    n_chunks: int
    key_col: str
    k1: float


def build_postings(index: DataFrame, key_col: str = "chunk_id", text_col: str = "chunk", k1: float = 1.2, b: float = 0.75) -> Postings:
    """Tokenise and store the index.  Chunks of any length and number; a chunk without tokens has no postings."""
    docs = index.select(key_col, tokens(F.col(text_col)).alias("toks")).withColumn("chunk", F.monotonically_increasing_id())
    docs = docs.select("chunk", key_col, F.size("toks").alias("dl"), term_counts(F.col("toks")).alias("c"))
    docs = materialize(docs.select("chunk", key_col, "dl", "c.terms", "c.tfs"), "postings-chunks")
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()  # one row
    n, avgdl = stats["n"], float(stats["avgdl"] or 1.0)
    norm = F.lit(k1) * (1.0 - b + b * F.col("dl") / avgdl)
    impact = lambda tf: tf * (k1 + 1.0) / (tf + norm)

    # Chunks are dealt out by part with their counts packed; their postings are unpacked, ranked and put in blocks there.
    parts = max(1, -(-n // PART_CHUNKS))
    part = F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part")
    dealt = docs.select("chunk", "dl", F.arrays_zip("terms", "tfs").alias("p"), part).repartition(parts, "part")
    ranked = dealt.select("chunk", "dl", "part", F.explode("p").alias("p")).select("part", "chunk", F.col("p.terms").alias("term"), impact(F.col("p.tfs")).alias("impact"))
    nth = F.row_number().over(Window.partitionBy("term", "part").orderBy(F.desc("impact"), "chunk"))
    ranked = ranked.withColumn("block", ((nth - 1) / BLOCK).cast("int"))
    entry = F.array_sort(F.collect_list(F.struct((-F.col("impact")).alias("fall"), "chunk")))  # at most BLOCK
    blocks = ranked.groupBy("term", "part", "block").agg(F.max("impact").alias("largest"), F.count(F.lit(1)).alias("n"), entry.alias("e"))
    blocks = blocks.select("term", "part", "block", "largest", "n", F.col("e.chunk").alias("chunks"), F.transform("e.fall", lambda x: -x).alias("impacts"))
    blocks = materialize(blocks, "postings-blocks")
    terms = materialize(blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("largest").alias("largest")), "postings-terms")
    chunks = docs.where(F.size("terms") > 0).select("chunk", key_col, "terms", "tfs", norm.alias("norm"))
    return Postings(blocks, terms, chunks, n, key_col, k1)


def query_terms(p: Postings, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, term, idf, df, most, kth): the distinct terms of each query that the index has, with the largest score
    a chunk can get from the term and the k-th largest of a part (0 if no part has so many): a floor of the k-th."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))
    named = asked.select("term").distinct()
    nth = p.blocks.where(F.col("block") == (k - 1) // BLOCK).join(named, "term", "left_semi")
    kth = nth.groupBy("term").agg(F.max(F.get("impacts", F.lit((k - 1) % BLOCK))).alias("kth"))
    idf = F.log(1.0 + (F.lit(p.n_chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = asked.join(p.terms, "term").join(kth, "term", "left").withColumn("idf", idf)
    return materialize(found.select("query_id", "term", "idf", "df", (F.col("idf") * F.col("largest")).alias("most"), F.coalesce(F.col("idf") * F.col("kth"), F.lit(0.0)).alias("kth")), "query-terms")


def exact_scores(p: Postings, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, chunk, key, score) of (query_id, chunk) pairs, from the chunks' own term lists."""
    per_query = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("q"))  # the terms of one query
    joined = pairs.join(p.chunks, "chunk").join(per_query, "query_id")
    # A token of the query that the chunk lacks has no place among its terms: tf is null, its share nothing.
    tf = "try_element_at(tfs, nullif(cast(array_position(terms, x.term) as int), 0))"
    held = f"filter(transform(q, x -> struct(x.idf as idf, {tf} as tf)), x -> x.tf is not null)"
    score = f"aggregate({held}, 0D, (s, x) -> s + x.idf * (x.tf * {p.k1 + 1.0}D / (x.tf + norm)))"
    return joined.select("query_id", "chunk", p.key_col, F.expr(score).alias("score"))


def _first_floor(p: Postings, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): the k-th best exact score among the best postings of a query's rarest terms."""
    by_rarity = Window.partitionBy("query_id").orderBy("df", "term")
    rare = asked.withColumn("before", F.sum("df").over(by_rarity) - F.col("df")).where(F.col("before") < 4 * k)
    top = p.blocks.where(F.col("block") * BLOCK < 4 * k)
    held = rare.join(top, "term").select("query_id", "idf", F.explode(F.arrays_zip("chunks", "impacts")).alias("x"))
    sums = held.groupBy("query_id", F.col("x.chunks").alias("chunk")).agg(F.sum(F.col("idf") * F.col("x.impacts")).alias("s"))
    best = sums.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "chunk"))).where(F.col("nth") <= 2 * k)
    scored = exact_scores(p, asked, best.select("query_id", "chunk"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    return scored.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", F.col("score").alias("floor"))


def essential_terms(p: Postings, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, term, idf, df, least, aside, floor): the terms whose postings are read, from impact ``least`` on;
    ``aside`` is the most that the terms left aside can add."""
    single = asked.groupBy("query_id").agg(F.max("kth").alias("kth"), F.sum("most").alias("all_most"))
    floors = single.join(_first_floor(p, asked, k), "query_id", "left")
    floors = floors.select("query_id", "all_most", (F.greatest("kth", F.coalesce("floor", F.lit(0.0))) - SLACK).alias("floor"))
    rising = Window.partitionBy("query_id").orderBy("most", "term")
    with_floor = asked.join(floors, "query_id").withColumn("upto", F.sum("most").over(rising))
    aside = F.coalesce(F.max(F.when(F.col("upto") < F.col("floor"), F.col("upto"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    least = (F.col("floor") - (F.col("all_most") - F.col("most"))) / F.col("idf")
    kept = with_floor.withColumn("aside", aside).where(F.col("upto") >= F.col("floor"))
    return materialize(kept.select("query_id", "term", "idf", "df", least.alias("least"), "aside", "floor"), "query-essential")


def _read_blocks(p: Postings, essential: DataFrame) -> DataFrame:
    """The blocks that each (query, essential term) has to read."""
    return essential.join(p.blocks, "term").where(F.col("largest") >= F.col("least"))


def candidates(p: Postings, essential: DataFrame) -> DataFrame:
    """(query_id, chunk) pairs that can reach their query's floor.

    A chunk that reaches it has each of its terms at ``least`` or above, so what the read postings do not show
    of an essential term it does not have.
    """
    held = _read_blocks(p, essential).select("query_id", "idf", "least", "aside", "floor", F.explode(F.arrays_zip("chunks", "impacts")).alias("x"))
    held = held.where(F.col("x.impacts") >= F.col("least"))
    sums = held.groupBy("query_id", F.col("x.chunks").alias("chunk")).agg(
        F.sum(F.col("idf") * F.col("x.impacts")).alias("s"), F.max("aside").alias("aside"), F.max("floor").alias("floor")
    )
    return sums.where(F.col("s") + F.col("aside") >= F.col("floor")).select("query_id", "chunk")


def search_candidates(p: Postings, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score): exact BM25 scores of all chunks that can be among the best ``k`` of a query."""
    asked = query_terms(p, queries, k)
    scored = exact_scores(p, asked, candidates(p, essential_terms(p, asked, k)))
    return scored.select("query_id", p.key_col, "score")


def search(p: Postings, queries: DataFrame, k: int = 5) -> DataFrame:
    """Top-``k`` chunks per query by BM25, ranked on the score rounded to 6 decimals, then the key.

    The same rows as ``retrieve.keyword_search``.  A query without a term of the index has none.
    """
    scored = search_candidates(p, queries, k).withColumn("score", F.round("score", SCORE_DECIMALS))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), p.key_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", p.key_col, "score", "rank")


def share_read(p: Postings, queries: DataFrame, k: int) -> float:
    """Postings in the blocks read for candidates, as a share of all postings of the queries' terms."""
    asked = query_terms(p, queries, k)
    read = _read_blocks(p, essential_terms(p, asked, k)).agg(F.sum("n").alias("n")).first()["n"] or 0
    return read / max(1, asked.agg(F.sum("df").alias("n")).first()["n"] or 0)
