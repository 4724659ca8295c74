"""Places of gazetteer terms in texts: leftmost-longest matches of whole words, with character offsets.

The distinct terms become word-level automata (a trie with failure links, in flat arrays), each built in a task
of its own from a hash shard of at most ``SHARD_BYTES`` of terms.  Usually that is one automaton, sent to all
tasks once; the texts are then read in one narrow pass.  A larger gazetteer takes one pass for each shard, with only that
shard's automaton in a task, and only matches (never texts) are shuffled to settle which stand.  The canonical
names, of which a term may have any number, never travel with the automata: they are joined to the matches.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.session import materialize

SHARD_BYTES = 4 * 1024 * 1024  # of term text in one automaton
SLICE_CHARS = 4 * 1024 * 1024  # of texts that are looked at together
PIECE_WORDS = 256  # a longer run of known words is cut, with an overlap as long as the longest term

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORD = re.compile(r"[0-9a-z]+")


def words(text: str) -> tuple[list[str], list[int]]:
    """Lower-case words (runs of letters and digits) and the places of their first characters."""
    found, starts = [], []
    if text.isascii():
        for m in _ASCII_WORD.finditer(text.lower()):
            found.append(m.group())
            starts.append(m.start())
    else:
        for m in _WORD.finditer(text):
            found.append(m.group().lower())
            starts.append(m.start())
    return found, starts


class Automaton:
    """Word-level trie of terms.  State 0 is the root; ``fail`` is the longest proper suffix that is a state, ``size`` the
    number of words of the term that ends in a state (or 0), ``shorter`` the next suffix state that ends a term."""

    ARRAYS = ("keys", "targets", "fail", "size", "shorter")

    def __init__(self, vocabulary: list[str], arrays: dict[str, np.ndarray]):
        self.vocabulary = vocabulary
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        self.longest_term = int(self.size.max())

    @classmethod
    def of_terms(cls, terms: list[str]) -> "Automaton":
        split = [t.split(" ") for t in terms]
        vocabulary = sorted({w for t in split for w in t})
        ids, n_words = {w: i for i, w in enumerate(vocabulary)}, len(vocabulary)
        child: dict[int, int] = {}
        parent, last, depth, size = [0], [0], [0], [0]
        for t in split:
            s = 0
            for w in t:
                key = s * n_words + ids[w]
                if key not in child:
                    child[key] = len(parent)
                    parent.append(s), last.append(ids[w]), depth.append(depth[s] + 1), size.append(0)
                s = child[key]
            size[s] = len(t)
        fail, shorter = [0] * len(parent), [0] * len(parent)
        for s in np.argsort(depth, kind="stable").tolist()[1:]:
            if parent[s]:
                f = fail[parent[s]]
                while f and f * n_words + last[s] not in child:
                    f = fail[f]
                fail[s] = child.get(f * n_words + last[s], 0)
            shorter[s] = fail[s] if size[fail[s]] else shorter[fail[s]]
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        targets = np.fromiter(child.values(), np.int64, len(child))[order]
        return cls(vocabulary, {"keys": keys[order], "targets": targets, "fail": np.array(fail), "size": np.array(size), "shorter": np.array(shorter)})

    def dump(self) -> bytes:
        out = io.BytesIO()
        text = np.frombuffer(" ".join(self.vocabulary).encode(), np.uint8)
        np.savez(out, vocabulary=text, **{name: getattr(self, name) for name in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Automaton":
        with np.load(io.BytesIO(data)) as z:
            return cls(z["vocabulary"].tobytes().decode().split(" "), {name: z[name] for name in cls.ARRAYS})

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each."""
        out = np.zeros_like(state)
        todo, n_words = np.arange(len(state)), len(self.vocabulary)
        while len(todo):
            key = state[todo] * n_words + word[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            out[todo[there]] = self.targets[at[there]]
            todo = todo[~there]
            todo = todo[state[todo] > 0]
            state[todo] = self.fail[state[todo]]
        return out

    def longest(self, ids: np.ndarray) -> np.ndarray:
        """For each word, the number of words of the longest term that begins there (0: none).  Unknown words, and the
        borders of texts, have the id -1.  Runs of known words are walked side by side."""
        n = len(ids)
        out = np.zeros(n, np.int64)
        known = np.concatenate(([False], ids >= 0, [False]))
        begin, end = np.flatnonzero(known[1:-1] & ~known[:-2]), np.flatnonzero(known[1:-1] & ~known[2:]) + 1
        piece = max(PIECE_WORDS, 4 * self.longest_term)
        count = -(-(end - begin) // piece)
        first = np.repeat(begin, count) + piece * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        own_end = np.minimum(first + piece, np.repeat(end, count))  # a piece reports the terms that begin before this
        stop = np.minimum(own_end + self.longest_term - 1, np.repeat(end, count))
        order = np.argsort(first - stop, kind="stable")
        first, own_end, length = first[order], own_end[order], (stop - first)[order]
        state = np.zeros(len(first), np.int64)
        for j in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -j, side="left"))  # pieces longer than j
            at = first[:m] + j
            state[:m] = self.step(state[:m], ids[at])
            s = state[:m]
            ending = np.where(self.size[s] > 0, s, self.shorter[s])
            live = np.flatnonzero(ending)
            while len(live):
                begins = at[live] - self.size[ending[live]] + 1
                own = begins < own_end[live]
                out[begins[own]] = self.size[ending[live[own]]]  # later steps end later, so they are longer
                ending[live] = self.shorter[ending[live]]
                live = live[ending[live] > 0]
        return out


def leftmost(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the candidates (by rising place, one per place) stand: the first, then each time the first that does not
    begin before the end of the one that stands.  The chain of successors is followed by pointer doubling."""
    n = len(begins)
    follow = np.append(np.searchsorted(begins, ends), n)
    stands = np.zeros(n + 1, bool)
    stands[0] = True
    for _ in range(n.bit_length()):
        stands[follow[stands]] = True
        follow = follow[follow]
    return stands[:n]


def _slices(texts: list[str | None]) -> Iterator[list[int]]:
    held, chars = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        held.append(i)
        chars += len(t)
        if chars >= SLICE_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _matches(automaton: Automaton, texts: list[str | None], settle: bool) -> Iterator[pd.DataFrame]:
    """Rows ``at`` (place of the text), ``span_start``, ``span_end``, ``surface``, ``term``: of all candidates (the longest term at
    each word), or of those that stand."""
    for held in _slices(texts):
        ids, found, starts, owner = [], [], [], []
        for i in held:
            w, s = words(texts[i])
            found += w + [""]
            starts += s + [0]
            owner += [i] * (len(w) + 1)
            ids += [automaton.ids.get(x, -1) for x in w] + [-1]
        size = automaton.longest(np.array(ids, np.int64))
        begins = np.flatnonzero(size)
        if settle:
            begins = begins[leftmost(begins, begins + size[begins])]
        rows = []
        for b in begins.tolist():
            last = b + int(size[b]) - 1
            start, end, i = starts[b], starts[last] + len(found[last]), owner[b]
            rows.append((i, start, end, texts[i][start:end], " ".join(found[b : last + 1])))
        yield pd.DataFrame(rows, columns=["at", "span_start", "span_end", "surface", "term"])


def _spaced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"term": [" ".join(words(t)[0]) for t in b["term"]], "canonical": b["canonical"]})


def _build(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"automaton": [Automaton.of_terms(sorted(group["term"])).dump()]})


def _finder(shared, settle: bool):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton.load(shared.value)
        for b in batches:
            for rows in _matches(automaton, b["text"].tolist(), settle):
                rows.insert(0, "key", b["key"].iloc[rows["at"]].to_numpy() if len(rows) else [])
                yield rows.drop(columns="at")

    return find


def location_spans(chunks: DataFrame, gazetteer: DataFrame, text_col: str = "chunk", key_col: str = "chunk_id") -> DataFrame:
    """Where the terms of ``gazetteer`` (``term, canonical``) stand in the texts: ``key_col, span_start, span_end, surface, term,
    canonical``.

    Terms and texts are read as lower-case words (runs of letters and digits), so case and what stands between words
    do not matter.  From left to right the longest term that begins at a word is taken and the search goes on behind
    it: in "New York City" neither "York" nor "New York" is reported beside the whole.  Offsets count
    characters (code points) from 0, the end exclusive; ``surface`` is the text between them, ``term`` its words.

    A term with several canonical names gives a row for each.  Null and wordless terms and null names match nothing; null
    and empty texts have no rows; repeated rows and keys each have their own; a null key is carried.
    """
    spark = chunks.sparkSession
    names = gazetteer.select("term", "canonical").where("term is not null and canonical is not null")
    names = materialize(names.mapInPandas(_spaced, "term string, canonical string").where("term <> ''").distinct(), "term-names")
    terms = names.select("term").distinct()
    held = terms.agg(F.coalesce(F.sum(F.octet_length("term").cast("long")), F.lit(0)).alias("b")).first()["b"]
    n_shards = -(-held // SHARD_BYTES)
    key_type = chunks.schema[key_col].dataType
    fields = [("span_start", T.LongType()), ("span_end", T.LongType()), ("surface", T.StringType()), ("term", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in [("key", key_type), *fields]])
    out = [F.col("key").alias(key_col), F.col("span_start").cast("int").alias("span_start"), F.col("span_end").cast("int").alias("span_end"), "surface", "term", "canonical"]
    if n_shards == 0:
        return spark.createDataFrame([], schema).withColumn("canonical", F.lit("")).select(*out)
    shard = F.pmod(F.xxhash64("term"), F.lit(n_shards)).cast("int")
    automata = materialize(terms.withColumn("shard", shard).groupBy("shard").applyInPandas(_build, "automaton binary"), "term-automata")
    texts = chunks.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    shared = [spark.sparkContext.broadcast(bytes(r["automaton"])) for r in automata.toLocalIterator()]  # one bounded shard at a time
    if len(shared) == 1:
        found = texts.mapInPandas(_finder(shared[0], True), schema)
        return found.join(names, "term").select(*out)

    # More than one shard: candidates of all shards meet by a stored row number; a row's candidates are at most its words.
    numbered = T.StructType([T.StructField("key", T.LongType()), *schema.fields[1:]])
    texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "span-texts")
    keyed = texts.select(F.col("row").alias("key"), "text")
    passes = [keyed.mapInPandas(_finder(b, False), numbered) for b in shared]
    found = passes[0]
    for p in passes[1:]:
        found = found.unionAll(p)
    longest = found.groupBy("key", "span_start").agg(F.max(F.struct("span_end", "surface", "term")).alias("m"))
    by_row = longest.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("span_start", "m.span_end", "m.surface", "m.term"))).alias("c"))
    ends = F.aggregate(  # the places where a match that stands begins
        "c",
        F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<bigint>").alias("kept")),
        lambda a, x: F.when(x["span_start"] >= a["end"], F.struct(x["span_end"].alias("end"), F.concat(a["kept"], F.array(x["span_start"])).alias("kept"))).otherwise(a),
    )["kept"]
    stand = by_row.select("key", F.explode(ends).alias("span_start")).join(longest, ["key", "span_start"])
    stand = stand.select(F.col("key").alias("row"), "span_start", "m.span_end", "m.surface", "m.term")
    return texts.select("row", "key").join(stand, "row").join(names, "term").select(*out)
