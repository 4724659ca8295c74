"""Packing token sequences: encoding, cutting, two histogram planners, placing.

Whatever the number of documents, their piece lengths take at most ``capacity`` different
values, so both planners work on the histogram of lengths (a proven bound) and return
*patterns*: a combination of lengths with the number of sequences that repeat it.  Pieces
are ranked within their length by distributed windows and each rank is mapped to its
pattern, copy and place by a join with the small table of patterns.  No piece passes through
the driver, and the plan is the one a sequential run over all pieces would make.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import materialize, tidied
from kestrel.llm.token_fst import safe_slices

# ---------------------------------------------------------------- encoding

#: Both libraries split and merge alike for the characters of this encoding (checked by a test, one by
#: one); texts with other characters, or with a special string, go to the slower library.
PLAIN = "latin-1"


def _plain(text: str) -> bool:
    try:
        text.encode(PLAIN)
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for ``path``.

    ``ranks_path`` names the same vocabulary as a rank file; it serves plain texts faster.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def lib(self):
        """The tokenizers library's own tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate([self._encode(part) for part in safe_slices(text)])

    def _encode(self, text: str) -> np.ndarray:
        if self.fast is not None and _plain(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def _encoder(path: str, ranks_path: str | None, pattern: str | None) -> Encoder:
    return Encoder(path, ranks_path, pattern)


def encoded(text: str, path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 0, width: int = 4) -> Column:
    """Binary column: the ids of a text and then ``end_id``, little-endian unsigned of ``width`` bytes."""
    kind = {2: "<u2", 4: "<u4"}[width]

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(path, ranks_path, pattern)
        for texts in tidied(batches):
            yield pd.Series([np.append(enc.encode(t if isinstance(t, str) else ""), end_id).astype(kind).tobytes() for t in texts])

    return ids(F.col(text))


def pieces(docs: DataFrame, capacity: int, ids: Column, width: int, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids (binary): documents over ``capacity`` are cut losslessly into
    full pieces, where the first may be shorter; others are one piece."""
    one = docs.select(F.col(doc_id).alias("doc_id"), ids.alias("all_ids")).withColumn("n", (F.octet_length("all_ids") / width).cast("long"))
    one = one.withColumn("head", F.expr(f"if(n % {capacity} = 0, {capacity}L, n % {capacity})"))
    cut = one.withColumn("piece", F.explode(F.expr(f"sequence(0, cast(ceil(n / {capacity}) as int) - 1)")))
    cut = cut.withColumn("start", F.expr(f"if(piece = 0, 0L, head + (piece - 1L) * {capacity})"))
    cut = cut.withColumn("length", F.expr(f"if(piece = 0, head, {capacity}L)"))
    return cut.select("doc_id", "piece", "start", "length", F.expr(f"substring(all_ids, cast(start * {width} + 1 as int), cast(length * {width} as int))").alias("ids"))


# ---------------------------------------------------------------- planners

Pattern = tuple[list[tuple[int, int]], int]  # ([(length, copies in a sequence)], sequences)


def minimum_bin_slack(hist: dict[int, int], capacity: int) -> list[Pattern]:
    """Per bin: the longest piece left, and the fullest completion that bitset subset-sum dynamic
    programming finds among all lengths left.  The same bin is repeated while its lengths last."""
    left = {n: c for n, c in hist.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("piece lengths must be 1 to capacity")
    out: list[Pattern] = []
    while left:
        seed = max(left)
        rest = capacity - seed
        reach, steps, mask = 1, [], (1 << (rest + 1)) - 1
        for n in sorted((n for n in left if n <= rest), reverse=True):
            spare = min(left[n] - (n == seed), rest // n)
            k = 1
            while spare > 0 and not reach >> rest & 1:
                k = min(k, spare)
                more = (reach | reach << n * k) & mask
                if more != reach:
                    steps.append((n, k, reach))
                    reach = more
                spare, k = spare - k, 2 * k
            if reach >> rest & 1:
                break
        total, use = reach.bit_length() - 1, {seed: 1}
        for n, k, before in reversed(steps):
            if not before >> total & 1:
                use[n] = use.get(n, 0) + k
                total -= n * k
        times = min(left[n] // c for n, c in use.items())
        for n, c in use.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        out.append((sorted(use.items(), reverse=True), times))
    return out


class CapacityTree:
    """Segment tree over room left in open bins: the least room of at least n, in log time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, present: bool) -> None:
        i = room + self.size
        self.any[i] = present
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least(self, n: int) -> int | None:
        i = n + self.size
        if self.any[i]:
            return n
        while i > 1:  # up to the first right sibling that holds a bin, then down its left edge
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(hist: dict[int, int], capacity: int) -> list[Pattern]:
    """Longest pieces first, each into the open bin with the least room that still holds it.

    Bins of equal content are kept as one class with a count, so equal steps are taken at once.
    """
    if any(n < 1 or n > capacity for n, c in hist.items() if c > 0):
        raise ValueError("piece lengths must be 1 to capacity")
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[tuple, int]]] = {}

    def add(room: int, content: tuple, times: int) -> None:
        if not times:
            return
        open_bins.setdefault(room, []).append((content, times))
        tree.set(room, True)

    for n in sorted((n for n, c in hist.items() if c > 0), reverse=True):
        count = hist[n]
        while count:
            room = tree.least(n)
            if room is None:
                per = capacity // n
                add(capacity - per * n, ((n, per),), count // per)
                if count % per:
                    add(capacity - count % per * n, ((n, count % per),), 1)
                break
            content, times = open_bins[room].pop()
            if not open_bins[room]:
                tree.set(room, False)
            per = room // n
            full = min(times, count // per)
            count -= full * per
            add(room - per * n, (*content, (n, per)), full)
            if full < times:
                if count:  # fewer than fill one bin: all of them go to one
                    add(room - count * n, (*content, (n, count)), 1)
                    times, count = times - 1, 0
                add(room, content, times - full)
    return [(list(content), times) for classes in open_bins.values() for content, times in classes]


# ---------------------------------------------------------------- placing


def place(items: DataFrame, plan, capacity: int, bucket_rows: int = 2_000) -> tuple[DataFrame, int]:
    """``items`` (a stored table with doc_id, piece, start and length) with sequence_id and offset; and the
    number of sequences, whose ids run from 0.

    Rows have a stored number each (row_number; added and stored where it is missing), so rows of equal ids are told
    apart, are dealt to different buckets, and keep their places when a lost part is computed again.
    Ranks within a length: rows are dealt to hash buckets whose number grows with the table, counted
    per (length, bucket), and numbered within each; so a length that holds a third of all pieces
    is still numbered by many tasks.
    """
    spark = items.sparkSession
    if "row_number" not in items.columns:
        items = materialize(items.withColumn("row_number", F.monotonically_increasing_id()), "pack-rows")
    hist = {int(r["length"]): int(r["count"]) for r in items.groupBy("length").count().collect()}  # at most ``capacity`` rows
    buckets = max(1, sum(hist.values()) // bucket_rows)
    ranges, taken, sequence = [], dict.fromkeys(hist, 0), 0
    for content, times in plan(hist, capacity):
        at = 0
        for n, copies in content:
            ranges.append((n, taken[n], taken[n] + copies * times, copies, sequence, at))
            taken[n] += copies * times
            at += n * copies
        sequence += times
    slots = spark.createDataFrame(ranges, "length long, lo long, hi long, copies long, first_sequence long, first_offset long")
    keyed = items.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(row_number), {buckets}) as int)"))
    counts = keyed.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("length", "bucket").orderBy("row_number")
    ranked = keyed.withColumn("rank", F.row_number().over(inner) - 1).join(base, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))
    # The patterns are bounded by the number of lengths, whatever the table: safe to broadcast.
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["lo"]) & (ranked["rank"] < slots["hi"])).drop(slots["length"])
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        *(c for c in items.columns if c != "row_number"),
        (F.col("first_sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (nth % F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    ), sequence


# ---------------------------------------------------------------- operators


def pack_tightly(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, ranks_path: str | None = None,
                 pattern: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Best-fit packing by minimum bin slack: every piece with its sequence and offset.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves
    (little-endian unsigned 32-bit) with ``with_ids``.  A null text is empty: its piece is the end
    id alone.  Null ids and repeated rows are packed one to one; other columns are ignored; an
    empty table gives an empty result.  Offsets are gapless from 0 in every sequence.
    """
    cut = pieces(docs.withColumn(doc_id, F.col(doc_id).cast("long")), capacity, encoded(text, path, ranks_path, pattern, end_id, 4), 4, doc_id)
    cut = cut.withColumn("ids_crc32", F.crc32("ids"))
    cut = cut.withColumn("row_number", F.monotonically_increasing_id())
    stored = materialize(cut if with_ids else cut.drop("ids"), "pack-pieces")
    return place(stored, minimum_bin_slack, capacity)[0]


def packed_matrix(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, pad_id: int = 0, width: int = 2,
                  ranks_path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Best-fit-decreasing packing written as binary rows of an id matrix.

    One row per sequence: sequence_id, n_tokens, n_segments, ids (binary, ``capacity`` ids of ``width``
    bytes, little-endian, padded with ``pad_id``), cu_seqlens (0, then the end of every segment),
    position_ids (binary, unsigned 16-bit: counts from 0 again at each segment; padding 0), and
    doc_ids, pieces (array, by segment).  Joining a document's pieces in order gives its ids back.
    Pieces that fill a sequence are rows as they stand: best fit would give each a bin of its own, so
    their ids are not shuffled.  Sequence ids are unique, those of full pieces not consecutive.
    A null text is empty: the end id alone.  Null ids and repeated rows are packed one to one; other
    columns are ignored; an empty table gives an empty result.
    """
    if capacity > 1 << 16:
        raise ValueError("positions are written in 16 bits")
    ramp = np.arange(capacity, dtype="<u2").tobytes()
    pad = np.full(capacity, pad_id, {2: "<u2", 4: "<u4"}[width]).tobytes()
    cut = pieces(docs.withColumn(doc_id, F.col(doc_id).cast("long")), capacity, encoded(text, path, ranks_path, pattern, end_id, width), width, doc_id)
    # The row number is written with the pieces, so it stays the same however often they are read.
    stored = materialize(cut.withColumn("row_number", F.monotonically_increasing_id()), "matrix-pieces")
    placed, bins = place(stored.filter(F.col("length") < capacity), best_fit_decreasing, capacity)
    segment = F.struct("offset", "length", "doc_id", "piece", "ids")
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(segment)).alias("s"))  # at most ``capacity`` segments
    full = stored.filter(F.col("length") == capacity).withColumn("offset", F.lit(0).cast("long"))
    rows = rows.unionByName(full.select((F.col("row_number") + bins).alias("sequence_id"), F.array(segment).alias("s")))
    rows = rows.withColumn("n_tokens", F.expr("cast(aggregate(s, 0L, (n, x) -> n + x.length) as int)"))
    position = F.aggregate("s", F.lit(b""), lambda acc, x: F.concat(acc, F.substring(F.lit(ramp), F.lit(1), (x["length"] * 2).cast("int"))))
    joined = F.aggregate("s", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.select(
        "sequence_id", "n_tokens", F.size("s").alias("n_segments"),
        F.substring(F.concat(joined, F.lit(pad)), 1, capacity * width).alias("ids"),
        F.expr("concat(array(0), transform(s, x -> cast(x.offset + x.length as int)))").alias("cu_seqlens"),
        F.substring(F.concat(position, F.lit(bytes(2 * capacity))), 1, 2 * capacity).alias("position_ids"),
        F.expr("transform(s, x -> x.doc_id)").alias("doc_ids"),
        F.expr("transform(s, x -> x.piece)").alias("pieces"),
    )
