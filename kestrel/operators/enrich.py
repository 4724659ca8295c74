"""Index build: documents -> overlapping pages -> keyed chunk rows with vectors and entity tags.

The whole build is one lazy plan.  Chunking, keys, projection of parent fields and the
hashed embedder are narrow (no shuffle): a document's pages are produced by ``posexplode``
on the row that holds the document.  Entity tagging of tokens at hand is narrow too while the gazetteer is
bounded; else it joins the n-grams of the chunks with the gazetteer and regroups the matches by chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.text import (
    PAGE_LENGTH,
    PAGE_OVERLAP,
    base64url,
    chunk_key,
    encoded,
    hash_bucket,
    hashed_embedding,
    hashed_tokens,
    list_array,
    page_windows,
    tokens,
)
from kestrel.session import materialize

SHARED_BYTES = 4 * 1024 * 1024  # of gazetteer terms and names that tasks are sent


def non_blank(text: Column) -> Column:
    return text.isNotNull() & (F.trim(text) != F.lit(""))


def chunk_text(docs: DataFrame, text_col: str = "content", size: int = PAGE_LENGTH, overlap: int = PAGE_OVERLAP) -> DataFrame:
    """One row per page window of each non-blank document: adds ``page`` (0-based) and ``chunk``.

    Every other column of ``docs`` is carried along (this is the index projection: parent
    properties are copied to each chunk so no chunk->parent join is ever needed).
    """
    keep = [c for c in docs.columns if c != text_col]
    return docs.where(non_blank(F.col(text_col))).select(
        *keep, F.posexplode(page_windows(F.col(text_col), size, overlap)).alias("page", "chunk")
    )


def index_projection(docs: DataFrame, size: int = PAGE_LENGTH, overlap: int = PAGE_OVERLAP, extra: list[str] | None = None) -> DataFrame:
    """Documents ``(content, file_name, source_url, ...)`` -> flat chunk rows with parent fields.

    Output: ``parent_id, title, source_url, source_file_name, chunk_id, page, chunk`` plus ``extra``.
    Parent rows themselves are not emitted.
    """
    extra = extra or []
    chunks = chunk_text(docs.select("content", "file_name", "source_url", *extra), "content", size, overlap)
    return chunks.select(
        base64url(F.col("source_url")).alias("parent_id"),
        F.col("file_name").alias("title"),
        "source_url",
        F.col("file_name").alias("source_file_name"),
        chunk_key(F.col("source_url"), F.col("page")).alias("chunk_id"),
        "page",
        "chunk",
        *extra,
    )


def embed_text(df: DataFrame, text_col: str = "chunk", out_col: str = "text_vector", dims: int = 1024, toks_col: str | None = None) -> DataFrame:
    """Append a unit-length hashed term-count vector of ``dims`` float32 values (from the tokens in
    ``toks_col`` where they are at hand)."""
    return df.withColumn(out_col, hashed_tokens(F.col(toks_col), dims) if toks_col else hashed_embedding(F.col(text_col), dims))


def derive_gazetteer(docs: DataFrame, min_share: float = 0.02, min_len: int = 5, text_col: str = "text") -> DataFrame:
    """A ``(term, canonical, df)`` table: all tokens of at least ``min_len`` letters that occur in at least
    ``min_share`` of the documents (null texts count as documents without tokens).

    Document frequency is a combinable count, so a token present in every document costs no more than any
    other.  The table is bounded whatever the number of documents: a document that holds d different tokens
    supports d of them, so there are at most ``average d / min_share`` terms.
    """
    n = docs.count()
    toks = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    df = toks.where(F.length("term") >= min_len).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.where(F.col("df") >= F.lit(min_share) * F.lit(n)).select("term", F.col("term").alias("canonical"), "df")


def ngrams(toks: Column, n: int) -> Column:
    """All runs of ``n`` tokens, space-joined (empty when there are fewer tokens)."""
    if n == 1:
        return toks
    starts = F.sequence(F.lit(0), F.greatest(F.size(toks) - n, F.lit(0)))
    runs = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(toks, i + k) for k in range(n)]))
    return F.when(F.size(toks) >= n, runs).otherwise(F.array().cast("array<string>"))


def extract_locations(
    chunks: DataFrame, gazetteer: DataFrame, text_col: str = "chunk", key_col: str = "chunk_id", out_col: str = "locations", toks_col: str | None = None
) -> DataFrame:
    """Tag each chunk with the sorted distinct canonical names of the gazetteer terms it contains.

    Terms are read like texts (lower case, split at anything but letters and digits), so a term of any number
    of words matches the same run of words in any spelling of case; a term with several canonical
    names gives all of them.  A chunk without a match keeps its row with an empty array.

    Where the tokens are at hand (``toks_col``) and the gazetteer has at most ``SHARED_BYTES``, chunks are tagged in the
    task that reads them, and no chunk is shuffled.  Else the distinct n-grams, of the lengths that the gazetteer has, are
    joined with it and the matches regrouped by chunk, by a strategy left to the planner.  Either way rows of one
    key share their tags, and rows without a key have none.
    """
    gaz = gazetteer.select(tokens(F.col("term")).alias("t"), "canonical").where((F.size("t") > 0) & F.col("canonical").isNotNull())
    gaz = gaz.select(F.array_join("t", " ").alias("term"), F.size("t").alias("n"), "canonical").distinct()
    lengths = sorted(r["n"] for r in gaz.select("n").distinct().collect())  # different lengths of terms: a handful
    if not lengths:
        return chunks.withColumn(out_col, F.array().cast("array<string>"))
    if toks_col and gaz.agg(F.sum((F.octet_length("term") + F.octet_length("canonical")).cast("long")).alias("b")).first()["b"] <= SHARED_BYTES:
        return _tagged(chunks, [(r["term"], r["canonical"]) for r in gaz.select("term", "canonical").collect()], key_col, out_col, toks_col)
    toks = chunks.select(key_col, (F.col(toks_col) if toks_col else tokens(F.col(text_col))).alias("toks"))
    grams = F.array_distinct(F.concat(*[ngrams(F.col("toks"), n) for n in lengths]))
    found = toks.select(key_col, F.explode(grams).alias("term")).join(gaz.select("term", "canonical"), "term")
    tags = found.groupBy(key_col).agg(F.array_sort(F.collect_set("canonical")).alias("tag_names"))
    return chunks.join(tags, key_col, "left").withColumn(out_col, F.coalesce("tag_names", F.array().cast("array<string>"))).drop("tag_names")


def _tagged(chunks: DataFrame, names: list[tuple[str, str]], key_col: str, out_col: str, toks_col: str) -> DataFrame:
    """``extract_locations`` by a trie of the terms' words that every task has; ``names``: (term, canonical) pairs."""
    canonical = sorted({c for _, c in names}, key=str.encode)
    number = {c: i for i, c in enumerate(canonical)}
    ids: dict[str, int] = {}
    for term, _ in names:
        for w in term.split(" "):
            ids.setdefault(w, len(ids))
    n_words, child, ending = len(ids), {}, [set()]
    for term, c in names:
        state = 0
        for w in term.split(" "):
            key = state * n_words + ids[w]
            if key not in child:
                child[key] = len(ending)
                ending.append(set())
            state = child[key]
        ending[state].add(number[c])
    keys = np.array(sorted(child), np.int64)
    targets = np.array([child[k] for k in keys.tolist()], np.int64)
    starts = np.cumsum([0] + [len(e) for e in ending])  # the names of a state s: held[starts[s] : starts[s + 1]]
    held = np.array([c for e in ending for c in e], np.int64)
    shared = chunks.sparkSession.sparkContext.broadcast((ids, keys, targets, starts, held, canonical))

    @F.arrow_udf("array<string>")
    def tag(toks: pa.Array) -> pa.Array:
        ids, keys, targets, starts, held, canonical = shared.value
        lengths, codes, distinct = encoded(toks)
        word = np.fromiter((ids.get(t, -1) for t in distinct.to_pylist()), np.int64, len(distinct))[codes]
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(word >= 0)
        state, found = np.zeros(len(at), np.int64), [np.zeros(0, np.int64)]
        while len(at):  # one more word each time: the runs of words that begin a term
            key = state * len(ids) + word[at]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = keys[place] == key
            at, state = at[there], targets[place[there]]
            n = starts[state + 1] - starts[state]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.repeat(row[at], n) * len(canonical) + held[np.repeat(starts[state], n) + nth])
            on = np.flatnonzero(at + 1 < len(word))
            on = on[(row[at[on] + 1] == row[at[on]]) & (word[at[on] + 1] >= 0)]
            at, state = at[on] + 1, state[on]
        pairs = np.unique(np.concatenate(found))  # numbers of names are in the order of the names
        values = pa.array(canonical, pa.string()).take(pa.array(pairs % len(canonical)))
        return list_array(pairs // len(canonical), len(lengths), values)

    none = F.array().cast("array<string>")
    tagged = chunks.withColumn(out_col, F.when(F.col(key_col).isNotNull(), tag(F.col(toks_col))).otherwise(none))
    mark = F.xxhash64(key_col).alias("mark")
    marks = chunks.where(F.col(key_col).isNotNull()).groupBy(mark).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    marks = materialize(marks.select("mark"), "repeated-keys")  # usually none
    if marks.isEmpty():
        return tagged
    again = tagged.where(F.col(key_col).isNotNull()).withColumn("mark", mark).join(marks, "mark", "left_semi").select(key_col, F.explode(out_col).alias("name"))
    again = again.groupBy(key_col).agg(F.array_sort(F.collect_set("name")).alias("all_names"))
    return tagged.join(again, key_col, "left").withColumn(out_col, F.coalesce("all_names", out_col)).drop("all_names")


def embed_request_batches(
    df: DataFrame,
    key_col: str = "chunk_id",
    text_col: str = "chunk",
    batch_size: int = 16,
    model: str = "text-embedding",
) -> DataFrame:
    """Pack texts into ``{"input": [...], "model": ...}`` request payloads of at most ``batch_size``.

    Rows are spread over ``ceil(n / batch_size)`` hash groups of their key, then cut into
    consecutive runs of ``batch_size`` inside each group (ordered by key).  Groups have the
    expected size of one batch, so no group concentrates the input, and every payload is
    bounded.  Output: ``group_id, batch_no, batch_id, n_inputs, first_key, payload``.
    """
    n = df.count()
    n_groups = max(1, -(-n // batch_size))
    grouped = df.select(key_col, text_col).withColumn("group_id", hash_bucket(F.col(key_col), n_groups))
    w = Window.partitionBy("group_id").orderBy(key_col)
    numbered = grouped.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / F.lit(batch_size)).cast("int"))
    batches = numbered.groupBy("group_id", "batch_no").agg(
        F.array_sort(F.collect_list(F.struct(F.col(key_col).alias("k"), F.col(text_col).alias("t")))).alias("items")
    )
    return batches.select(
        "group_id",
        "batch_no",
        F.concat_ws("-", F.col("group_id").cast("string"), F.col("batch_no").cast("string")).alias("batch_id"),
        F.size("items").alias("n_inputs"),
        F.col("items")[0]["k"].alias("first_key"),
        F.to_json(F.struct(F.transform("items", lambda x: x["t"]).alias("input"), F.lit(model).alias("model"))).alias("payload"),
    )


def embedding_dim_check(responses: DataFrame, declared_dim: int, response_col: str = "response") -> DataFrame:
    """Parse ``{"data": [{"embedding": [...]}]}`` responses and count vectors by length.

    Output: ``dim, n_vectors, matches_declared`` (one row per distinct length found).
    """
    parsed = responses.select(
        F.explode(F.from_json(F.col(response_col), "data array<struct<embedding: array<double>>>")["data"]).alias("d")
    )
    return (
        parsed.groupBy(F.size(F.col("d.embedding")).alias("dim"))
        .agg(F.count(F.lit(1)).alias("n_vectors"))
        .withColumn("matches_declared", F.col("dim") == F.lit(declared_dim))
    )


def dim_mismatches(responses: DataFrame, declared_dim: int, key_col: str, response_col: str = "response") -> DataFrame:
    """Side table of the vectors whose length differs from the declared dimension."""
    parsed = responses.select(
        key_col,
        F.posexplode(F.from_json(F.col(response_col), "data array<struct<embedding: array<double>>>")["data"]).alias("pos", "d"),
    )
    return parsed.select(key_col, "pos", F.size("d.embedding").alias("dim")).where(F.col("dim") != declared_dim)
