"""SimHash near-duplicates: fingerprints, Golay-code fuzzy keys, verified links, components.

Candidate keys.  A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each
read as a word of the perfect binary Golay code (23, 12, 7).  With at most two differing bits
in all, some segment i agrees exactly and the segment after it (cyclically) differs in at most
one bit: two errors in one segment leave the other two intact, and errors in two segments are
one each.  So one key is the exact segment i with the Golay codeword index of segment i + 1.
A word one bit away may decode to another codeword, therefore one side of the join takes the
codeword of the word itself and the other the codewords of the word and all its one-bit
neighbours: one or six keys, because the code is perfect.  Candidates are then verified
on all 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import connected_components, free_name, materialize, tidied

SEED = 42
WHITE = re.compile(rb"[\x20\x09-\x0D]")
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, fixed value of the Golay code


# ---------------------------------------------------------------- fingerprints


def _word_blocks(data: bytes, size: int) -> Iterator[list[bytes]]:
    """Words of a text in blocks of about ``size`` bytes, so a very long text is never split whole."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = WHITE.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[at:end].split()  # bytes split at exactly the blanks of WHITE
        at = end


def fingerprint(text: str | None, shingle: int = 3, block: int = 1 << 20) -> int:
    """64-bit SimHash of the ``shingle``-word shingles (A-Z lower-cased, repeats included), unsigned.

    No words: 0.  Fewer words than a shingle: the whole sequence is the one shingle.
    """
    from xxhash import xxh64_intdigest

    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower touches A-Z only
    tail: list[bytes] = []
    ones, n = np.zeros(64, np.int64), 0
    for words in _word_blocks(data, block):
        words = tail + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
            stops = (ends[shingle - 1 :] - 1).tolist()
            h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))
            for i in range(0, len(h), 1 << 16):
                part = h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(h)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if n == 0 and tail:
        return xxh64_intdigest(b" ".join(tail), SEED)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))) if n else 0


def fingerprint_column(text: str, shingle: int) -> Column:
    """Signed 64-bit fingerprint of a text column (a null text has no words: 0)."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in tidied(batches):
            got = np.array([fingerprint(t if isinstance(t, str) else None, shingle) for t in texts], np.uint64)
            yield pd.Series(got.view(np.int64))

    return of(F.col(text))


# ---------------------------------------------------------------- Golay keys


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    r = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> bit & 1, GENERATOR << (bit - 11), 0)
    return r


def _error_table() -> np.ndarray:
    """Syndrome -> the one error pattern of weight three or less (the code is perfect)."""
    table = np.zeros(1 << 11, np.int64)
    ones = [1 << i for i in range(23)]
    errors = [0, *ones]
    errors += [a | b for i, a in enumerate(ones) for b in ones[:i]]
    errors += [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]
    e = np.array(errors, np.int64)
    table[_syndromes(e)] = e
    return table


_ERRORS: list[np.ndarray] = []


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword that each 23-bit word decodes to."""
    if not _ERRORS:
        _ERRORS.append(_error_table())
    return (words ^ _ERRORS[0][_syndromes(words)]) >> 11


def nearby_indices(words: np.ndarray) -> np.ndarray:
    """Codeword indices of each word and of its 23 one-bit neighbours, shape (n, 24)."""
    flips = np.concatenate(([0], 1 << np.arange(23, dtype=np.int64)))
    return codeword_index(words[:, None] ^ flips[None, :])


def fuzzy_keys(fp: np.ndarray, several: bool) -> list[np.ndarray]:
    """Per fingerprint the join keys: one per segment, or with ``several`` one or six per segment."""
    u = fp.astype(np.int64).view(np.uint64)
    seg = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    parts = []
    for i in range(3):
        exact, fuzzy = seg[i], seg[(i + 1) % 3]
        index = nearby_indices(fuzzy) if several else codeword_index(fuzzy)[:, None]
        parts.append((np.int64(i) << 40) | (exact[:, None] << 12) | index)
    keys = np.concatenate(parts, axis=1)
    return [np.unique(row) for row in keys]


def _keys_column(fp: str, several: bool) -> Column:
    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(fuzzy_keys(s.to_numpy(np.int64), several))

    return keys(F.col(fp))


def fingerprint_links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a < b) of different values of ``nodes.fp`` that differ in at most ``max_bits`` bits.

    ``nodes`` holds distinct fingerprints, so copies make no pairs; a fingerprint has at most 2080
    others within two bits, so the verified links grow with the number of fingerprints.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys of three segments cover at most two differing bits")
    left = nodes.select(F.col("fp").alias("a"), F.explode(_keys_column("fp", False)).alias("key"))
    right = nodes.select(F.col("fp").alias("b"), F.explode(_keys_column("fp", True)).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return left.join(right, "key").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


# ---------------------------------------------------------------- operator


def _classes(spark: SparkSession, prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component_id, label) per distinct fingerprint; ``prints`` has doc_id and fp."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    labels = connected_components(spark, fingerprint_links(nodes, max_bits))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return materialize(named.select("fp", "label").join(smallest, "label"), "simhash-classes")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Rows link when their fingerprints differ in at most ``max_bits`` bits; components are the
    transitive closure.  Texts are read once, in a narrow pass; everything after works on distinct
    fingerprints.  Null and word-free texts have fingerprint zero and link like any other.  A row
    with a null doc_id takes part but never names a component (null if no member has an id);
    repeated rows are kept one to one; other columns are ignored; an empty table gives an
    empty result.
    """
    prints = docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint_column(text, shingle).alias("fp"))
    return near_duplicates_of_fingerprints(prints, max_bits)


def near_duplicates_of_fingerprints(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """The same from fingerprints already made: ``prints`` has doc_id (long) and fp (signed 64-bit)."""
    prints = materialize(prints, "simhash-prints")
    out = prints.join(_classes(prints.sparkSession, prints, max_bits).select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest doc_id, then of the
    smallest fingerprint (rows without an id come last).  All columns are kept.

    A component is kept by its label, not by its id: one doc_id on rows of different texts names several
    components, and each keeps a row.  Rows are stored once with their fingerprint and a number, so equal
    rows are told apart and the same one stays whenever a part is computed again.
    """
    spark = docs.sparkSession
    fp, row = free_name(docs, "fp_of_row"), free_name(docs, "number_of_row")
    rows = docs.withColumn(fp, fingerprint_column(text, shingle)).withColumn(row, F.monotonically_increasing_id())
    rows = materialize(rows, "simhash-rows")
    classes = _classes(spark, rows.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp")), max_bits)
    place = F.struct(F.col(doc_id).isNull().alias("nameless"), F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    # Combinable minima, first per fingerprint: a large group of copies is one row before it meets its label.
    first = rows.groupBy(F.col(fp).alias("fp")).agg(F.min(place).alias("place"))
    first = first.join(classes.select("fp", "label"), "fp").groupBy("label").agg(F.min("place").alias("place"))
    return rows.join(first.select(F.col("place.row").alias(row)), row, "left_semi").select(*docs.columns)
