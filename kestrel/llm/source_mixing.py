"""Temperature mixing of sources, in DataFrame functions only.

The token share of each source is raised to an exponent and normalised.  The exponent is found by
bisection: the flattest mixture that keeps every source within a repetition limit, or the one that has a
target entropy.  The weights are then realised: a source's budget is a number of whole passes and a
part of one more, each pass a permutation of its documents made of hash blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import free_name, materialize

BISECTIONS = 50
#: Up to so many sources (some 100 bytes each) their table is broadcast; beyond, the planner chooses the join.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Mixture:
    """Production parameters.

    ``max_repeats``: no source is seen more often than this; ``target_entropy`` (nats): the mixture's
    entropy, taken instead when it is given.  ``budget_tokens``: tokens in all; None takes the least
    with which every source is seen whole at least once, so no document is lost.
    ``block_digits``: hash digits that name a block of a permutation.
    """

    max_repeats: float = 1.5
    target_entropy: float | None = None
    budget_tokens: int | None = None
    block_digits: int = 2


def n_tokens(text: str) -> Column:
    """Words of a text and one end mark (a null text has the end mark only)."""
    return (F.coalesce(F.regexp_count(text, F.lit("[^\\x09-\\x0D\\x20]+")), F.lit(0)) + 1).cast("long")


def _key(source: str) -> Column:
    """A source as a non-null key: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def quotas(sizes: DataFrame, m: Mixture) -> DataFrame:
    """From (source_key, tokens): exponent, weight, quota (tokens), full (whole passes) and rest (tokens of a part pass).

    One row per source comes in, pre-aggregated; the bisection runs over the array of their sizes.
    """
    mid = "((acc.lo + acc.hi) / 2)"
    power = f"transform(sizes, t -> pow(t / biggest, {mid}))"
    if m.target_entropy is None:
        budget = "" if m.budget_tokens is None else f"{m.budget_tokens}D"
        each = f"transform(sizes, t -> pow(t / biggest, {mid} - 1))"
        # Passes over a source are in proportion to size^(exponent - 1).
        most = f"array_max({each}) / array_min({each})" if not budget else f"{budget} * array_max({each}) / (biggest * aggregate({power}, 0D, (s, p) -> s + p))"
        flat_enough, top = f"{most} <= {float(m.max_repeats)!r}D", "1D"
    else:
        total = f"aggregate({power}, 0D, (s, p) -> s + p)"
        entropy = f"(ln({total}) - aggregate({power}, 0D, (s, p) -> s + if(p > 0, p * ln(p), 0D)) / {total})"
        flat_enough, top = f"{entropy} <= {float(m.target_entropy)!r}D", "8D"
    row = sizes.agg(F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("sizes"))
    row = row.withColumn("biggest", F.array_max("sizes")).filter("biggest is not null")
    row = row.withColumn("exponent", F.expr(
        f"round(aggregate(sequence(1, {BISECTIONS}), named_struct('lo', 0D, 'hi', {top}), "
        f"(acc, i) -> if({flat_enough}, named_struct('lo', acc.lo, 'hi', {mid}), named_struct('lo', {mid}, 'hi', acc.hi))).hi, 9)"
    ))
    row = row.withColumn("mass", F.expr("aggregate(transform(sizes, t -> pow(t / biggest, exponent)), 0D, (s, p) -> s + p)"))
    budget = F.expr("array_max(transform(sizes, t -> t / (pow(t / biggest, exponent) / mass)))") if m.budget_tokens is None else F.lit(float(m.budget_tokens))
    found = row.select(F.struct("biggest", "exponent", "mass", budget.alias("budget"))).scalar()  # one row
    out = sizes.withColumn("found", found).select("source_key", "tokens", "found.*")
    out = out.withColumn("weight", F.expr("pow(tokens / biggest, exponent) / mass")).withColumn("quota", F.round(F.col("budget") * F.col("weight")).cast("long"))
    return out.select("source_key", "tokens", "exponent", "weight", "quota", F.expr("quota div tokens").alias("full"), F.expr("quota % tokens").alias("rest"))


def source_plan(docs: DataFrame, m: Mixture, text: str, source: str) -> DataFrame:
    """``quotas`` of the sources of ``docs``, stored once."""
    sizes = docs.select(_key(source).alias("source_key"), n_tokens(text).alias("n_tokens")).groupBy("source_key").agg(F.sum("n_tokens").alias("tokens"))
    return materialize(quotas(sizes, m), "mixing-plan")


def _small(per_source: DataFrame) -> DataFrame:
    """Broadcast a table of one row per source when a count shows that it is small, so that documents stay where
    they are and a large source is not gathered in one task."""
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def permuted(docs: DataFrame, plan: DataFrame, m: Mixture, doc_id: str, text: str, source: str) -> DataFrame:
    """Every copy that the budgets take: source_key, doc_id, n_tokens, epoch, shuffle_key, position, quota, exponent.

    A source's documents are dealt to blocks by the first digits of a hash of pass and id, so a source that
    holds a third of all rows is ordered by many tasks: token sums per block are added up in block order and
    running sums are taken inside blocks only.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _key(source).alias("source_key"), n_tokens(text).alias("n_tokens"))
    copies = slim.join(_small(plan), "source_key").withColumn("epoch", F.explode(F.expr("sequence(0, cast(full as int))")))
    copies = copies.filter("epoch < full or rest > 0")
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    copies = copies.withColumn("block", F.substring("shuffle_key", 1, m.block_digits))
    keys = ["source_key", "epoch", "block"]
    sums = copies.groupBy(*keys).agg(F.sum("n_tokens").alias("in_block"))
    earlier = Window.partitionBy("source_key", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, F.coalesce(F.sum("in_block").over(earlier), F.lit(0)).alias("base"))
    running = Window.partitionBy(*keys).orderBy("shuffle_key")  # equal keys (one id twice) go together
    placed = copies.withColumn("upto", F.sum("n_tokens").over(running)).join(base, keys).withColumn("upto", F.col("upto") + F.col("base"))
    taken = placed.filter("epoch < full or upto <= rest")
    return taken.withColumn("position", F.expr("epoch * tokens + upto - n_tokens"))


def mix_sources(docs: DataFrame, mixture: Mixture = Mixture(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture as rows: doc_id, source, epoch, n_tokens, position (tokens of its source before it), mix_key.

    Ordered by ``mix_key`` (from 0 to 1, position over the source's budget) the sources interleave at their
    weights throughout.  A null source is a source of its own; a null text has one token (the end
    mark); rows with one id (or a null id) share a place in the permutation and are taken together;
    repeated rows count each; other columns are ignored; an empty table gives an empty result.
    """
    out = permuted(docs, source_plan(docs, mixture, text, source), mixture, doc_id, text, source)
    return out.select(
        "doc_id", F.expr("if(source_key = 'n', null, substring(source_key, 2))").alias("source"), "epoch", "n_tokens", "position",
        (F.col("position") / F.col("quota")).alias("mix_key"),
    )


def mixed_rows(docs: DataFrame, mixture: Mixture = Mixture(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mixture takes it.

    Texts are not shuffled: the part pass of a source ends at a key of its permutation, so a join with one
    row per source tells how often a row is taken.
    """
    key, end, full, last = (free_name(docs, n) for n in ("mix_source", "mix_end", "mix_full", "mix_last"))
    plan = source_plan(docs, mixture, text, source)
    part = permuted(docs, plan, mixture, doc_id, text, source).filter("epoch = full").groupBy("source_key").agg(F.max("shuffle_key").alias("last_key"))
    ends = plan.join(part, "source_key", "left").select(F.col("source_key").alias(key), F.col("full").alias(full), F.col("last_key").alias(last))
    wide = docs.withColumn(key, _key(source)).join(_small(materialize(ends, "mixing-ends")), key)
    own = F.md5(F.concat_ws(":", F.col(full).cast("string"), F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit(""))).cast("binary"))
    times = F.col(full) + F.when(own <= F.col(last), 1).otherwise(0)
    wide = wide.withColumn(end, F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int")))).filter(F.col(end) <= times)
    return wide.select(*docs.columns)


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) + 1 AS n_tokens FROM documents
), s AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source
), b AS (
  SELECT list(CAST(tokens AS DOUBLE) ORDER BY tokens) AS sizes, CAST(max(tokens) AS DOUBLE) AS biggest FROM s
), r AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1,
         CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi,
               list_max(list_transform(sizes, lambda t: pow(t / biggest, (lo + hi) / 2 - 1)))
               / list_min(list_transform(sizes, lambda t: pow(t / biggest, (lo + hi) / 2 - 1))) <= 1.5 AS ok
        FROM r, b WHERE i < 50)
), e AS (SELECT round(hi, 9) AS exponent FROM r WHERE i = 50
), w AS (
  SELECT source, tokens, pow(tokens / biggest, exponent) / sum(pow(tokens / biggest, exponent)) OVER () AS weight FROM s, b, e
), q AS (
  SELECT source, tokens, CAST(round((SELECT max(tokens / weight) FROM w) * weight) AS BIGINT) AS quota FROM w
), c AS (
  SELECT d.doc_id, d.source, d.n_tokens, q.tokens, q.quota, CAST(unnest(range(0, q.quota // q.tokens + 1)) AS INTEGER) AS epoch
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), p AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY md5(concat(epoch, ':', coalesce(CAST(doc_id AS VARCHAR), '')))) AS upto FROM c
)
SELECT doc_id, source, epoch, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch * tokens + upto - n_tokens AS BIGINT) AS position,
       CAST(epoch * tokens + upto - n_tokens AS BIGINT) / quota AS mix_key
FROM p WHERE epoch < quota // tokens OR upto <= quota % tokens
"""
