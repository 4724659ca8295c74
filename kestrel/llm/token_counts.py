"""Token counts of whole texts with counting transducers (see ``token_fst``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COUNTERS: dict[str, object] = {}


def _counter(path: str):
    """One compiled counter per worker process; its states grow as texts are read."""
    from kestrel.llm.token_fst import TokenCounter

    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_count(text: str, tokenizer_path: str) -> Column:
    """Column with the number of tokens of text column ``text``; null counts as the empty text (0)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(tokenizer_path)
        for texts in batches:
            yield pd.Series(counter.counts(texts.fillna("").tolist()), dtype="int64")

    return count(F.col(text))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    The counts are those of the tokenizer library for the byte-level BPE file ``tokenizer_path``
    without added begin or end tokens; special strings inside a text count as one token.  One
    narrow pass over whole texts, no shuffle.  A null text counts as empty (0 bytes, 0 tokens); null
    ids and repeated rows pass through one to one; other columns are ignored; an empty table gives
    an empty result.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count("text", tokenizer_path).alias("n_tokens")
    ).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
