"""Alignment of two tokenizers' tokens over the same bytes, and corpus counts of the linked ids.

A is a byte-level BPE (tokenizers library), B a SentencePiece BPE (its library; long words by ``piece_codec``).  Places
where tokens of both end cut a text into groups; every A token is linked to every B token of its group.

Fast path.  Each id of A is mapped once to the id of B with the same bytes.  Of a link that the map says the A id
is all that is kept.  Such links are counted in vectors as long as A's vocabulary, one per task, and their counts come
back as such a vector.  Only the other links become (A id, B id) pairs, which are shuffled.

Both tokenizers cut before a run of white space that begins with a blank, or with a line end or tab that is in no
longer piece of B, so a text falls into words; a word's tokens do not depend on its neighbours, and both tokenizers
end one where it ends.  So groups lie within words, and each worker remembers what a word adds to a text: sizes,
the digest's text and links.  A text is a sum over its words; only new words are encoded, many in a string.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import materialize
from kestrel.llm.piece_codec import BLANK, WALKED_TOGETHER, PieceEncoder, decoder

REMEMBERED = 150_000  # words that a worker keeps, those met last, when it has twice as many (results do not depend on it)
TOGETHER = 100  # new words that are encoded in one string
FILLER = "x"  # before such a string, in the place of the blank that B adds to a text
SLICE = 1 << 20  # characters that are cut into words at once
LINKS_AT_ONCE = 1 << 12
SHIFT = 20  # a pair is (A id << SHIFT) + B id


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level BPE vocabularies: printable Latin-1 characters stand for their own byte, the
    code points from 256 on for the other bytes, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tally:
    """What the alignment of one text adds up to; a very long text adds its slices one by one."""

    def __init__(self):
        self.spelled, self.sizes = True, np.zeros(4, np.int64)  # n_a, n_b, n_groups, n_links
        self.digest = None
        self.mapped = self.pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # keys, links

    def add(self, sizes: np.ndarray, text: bytes, mapped: tuple, pairs: tuple) -> None:
        self.sizes = self.sizes + sizes
        if self.digest is None:
            self.digest, self.mapped, self.pairs = hashlib.sha256(text), mapped, pairs
        else:
            self.digest.update(b";" + text)
            self.mapped, self.pairs = (_summed(*map(np.concatenate, zip(x, y))) for x, y in ((self.mapped, mapped), (self.pairs, pairs)))

    def refuse(self) -> None:
        self.__init__()
        self.spelled = False


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and the sum of ``n`` of each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first)


def _ranges(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places start[r] to start[r + 1] of all these rows, one behind the other, and how many each has."""
    n = start[rows + 1] - start[rows]
    return np.arange(n.sum()) + np.repeat(start[rows] - (np.cumsum(n) - n), n), n


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = PieceEncoder(b_path)
        back = byte_alphabet()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values(), default=-1))
        for t, i in self.a.get_vocab().items():
            if i not in special:
                self.a_bytes[i] = bytes(map(back.__getitem__, t))
        self.b_bytes = [b""] * self.b.size
        spelled = {}
        for p, i in self.b.id.items():
            self.b_bytes[i] = p.replace(BLANK, " ").encode()
            spelled[self.b_bytes[i]] = i
        for byte, i in self.b.byte.items():
            self.b_bytes[i] = bytes([byte])
            spelled.setdefault(bytes([byte]), i)  # where a piece has the same byte, the piece is what B takes
        self.size = len(self.a_bytes)
        #: A id -> the B id of the same bytes, or -1
        self.identity = np.array([spelled.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # Each id in decimal with the mark that follows it: inside its side of a group, or as the last of it.
        self.a_inner, self.a_last, self.b_inner, self.b_last = (
            np.array([b"%d%s" % (i, mark) for i in range(n)], object) for n, mark in ((self.size, b","), (self.size, b"|"), (self.b.size, b","), (self.b.size, b";"))
        )
        # A word: leading white space, then characters up to the next blank or lone line end or tab.  White space of other
        # kinds stays inside, because B has pieces that hold it.
        inner = {c for p in self.b.id if len(p) > 1 for c in p}
        lone = " " + "".join(c for c in "\n\t\r" if c not in inner)
        self.word = re.compile(rf"\s*\S+(?:[^\S{lone}]\s*\S*)*|\s+")
        self.word_end = re.compile(rf"(?<=\S)[{lone}]")
        self.library = decoder(b_path)
        self.filler = len(self.library.encode(FILLER))
        # What is known of words: the row of each, and by row the digest's text, the sizes, the last block that held the word
        # and, from start[row] to start[row + 1], its links as pairs.
        self._row: dict[str, int] = {}
        self._shown: list[bytes] = []
        self._sizes, self._met, self._start = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self._pairs = self._links = np.zeros(0, np.int64)
        self._blocks = 0

    # -------------------------------------------------------------- words

    def _learn(self, words: list[str]) -> None:
        """Adds a row for each of these new words; one that A or B does not spell gets no tokens and no groups."""
        words, n_a, n_b, a, b = self._ids(words)
        count, known = len(words), len(self._shown)
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)

        # Groups: the tokens of A and of B up to a byte at which both end.
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        at = np.searchsorted(b_end, a_end)
        last_a = np.flatnonzero(b_end[at] == a_end)
        last_b = at[last_a]
        first_a, first_b = (np.concatenate(([0], last + 1))[:-1] for last in (last_a, last_b))
        in_a, in_b = last_a - first_a + 1, last_b - first_b + 1
        part = np.searchsorted(stop_a, last_a, side="right")  # the word of each group
        groups, links = (np.bincount(part, weights=w, minlength=count).astype(np.int64) for w in (None, in_a * in_b))

        # The digest's text: tokens in order of group, side and place.
        text = np.empty(len(a) + len(b), object)
        shown_a, shown_b = self.a_inner[a], self.b_inner[b]
        shown_a[last_a], shown_b[last_b] = self.a_last[a[last_a]], self.b_last[b[last_b]]
        text[np.arange(len(a)) + np.repeat(first_b, in_a)] = shown_a
        text[np.arange(len(b)) + np.repeat(last_a + 1, in_b)] = shown_b
        text, stops = text.tolist(), (stop_a + stop_b).tolist()
        self._shown += [b"".join(text[t0:t1]) for t0, t1 in zip([0, *stops], stops)]

        step = np.int64(self.size) << SHIFT
        owner, x, y, n = self._linked(a, b, first_a, first_b, in_a, in_b, part)
        keys, n = _summed(owner * step + (x << SHIFT) + y, n)
        owner, pairs = np.divmod(keys, step)
        self._row.update(zip(words, range(known, known + count)))
        self._sizes = np.concatenate((self._sizes, np.stack((n_a, n_b, groups, links), 1)))
        self._met = np.concatenate((self._met, np.zeros(count, np.int64)))
        self._start = np.concatenate((self._start, self._start[-1] + np.cumsum(np.bincount(owner, minlength=count))))
        self._pairs, self._links = np.concatenate((self._pairs, pairs)), np.concatenate((self._links, n))

    def _ids(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words in another order, how many ids of A and of B each has, and these ids; none for a word not spelled."""
        # Words that may follow each other in a text are encoded in strings of many.
        plain = [w for w in words if len(w) <= WALKED_TOGETHER and not w[-1].isspace() and BLANK not in w]
        alone = [w for w in words if len(w) > WALKED_TOGETHER or w[-1].isspace() or BLANK in w]
        ends = np.cumsum([len(w.encode()) for w in plain])
        strings = ["".join(plain[i : i + TOGETHER]) for i in range(0, len(plain), TOGETHER)]
        ids = [
            [e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)],
            [self.library.encode(FILLER + s)[self.filler :] for s in strings],
        ]
        raw, sizes, flat = "".join(strings).encode(), [], []
        for own, parts, lengths in zip(ids, (self.a_bytes, self.b_bytes), (self.a_length, self.b_length)):
            own = np.fromiter(chain.from_iterable(own), np.int64)
            stops = np.searchsorted(np.cumsum(lengths[own]), ends) + 1
            if b"".join([parts[i] for i in own.tolist()]) != raw:  # some word is not spelled: find it
                plain, alone, sizes, flat = [], words, [], []
                break
            sizes.append(np.diff(stops, prepend=0))
            flat.append(own)
        if not alone:
            return plain, *sizes, *flat
        ids = [[e.ids for e in self.a.encode_batch_fast(alone, add_special_tokens=False)], [x.tolist() for x in self.b.encode_words(alone)]]
        for i, w in enumerate(alone):
            if any(b"".join([parts[t] for t in own[i]]) != w.encode() for own, parts in zip(ids, (self.a_bytes, self.b_bytes))):
                ids[0][i] = ids[1][i] = []
        none = np.zeros(0, np.int64)
        sizes = [np.concatenate((x, np.array(list(map(len, own)), np.int64))) for x, own in zip(sizes or (none, none), ids)]
        flat = [np.concatenate((x, np.fromiter(chain.from_iterable(own), np.int64))) for x, own in zip(flat or (none, none), ids)]
        return plain + alone, *sizes, *flat

    def _keep(self, rows: np.ndarray) -> None:
        """Forgets all words but those of these rows, which ascend."""
        words = list(self._row)
        self._row = {words[r]: i for i, r in enumerate(rows.tolist())}
        self._shown = [self._shown[r] for r in rows.tolist()]
        own, _ = _ranges(self._start, rows)
        self._pairs, self._links = self._pairs[own], self._links[own]
        self._start = np.concatenate(([0], np.cumsum(np.diff(self._start)[rows])))
        self._sizes, self._met = self._sizes[rows], self._met[rows]

    # -------------------------------------------------------------- texts

    def documents(self, texts: list[str | None]) -> list[Tally]:
        """Alignment of each whole text; words of about ``SLICE`` characters of texts are worked on at once."""
        out = [Tally() for _ in texts]
        block: list[list[str]] = []
        owners: list[Tally] = []
        size = 0
        for t, tally in zip(texts, out):
            text, at = " " + t if t else "", 0
            while at < len(text):
                cut = self.word_end.search(text, at + SLICE) if at + SLICE < len(text) else None
                stop = cut.start() if cut else len(text)
                block.append(self.word.findall(text, at, stop))
                owners.append(tally)
                size, at = size + stop - at, stop
                if size >= SLICE:
                    self._align(block, owners)
                    block, owners, size = [], [], 0
        if block:
            self._align(block, owners)
        return out

    def _align(self, block: list[list[str]], owners: list[Tally]) -> None:
        if new := set().union(*block).difference(self._row):
            self._learn(sorted(new, key=lambda w: len(w) > WALKED_TOGETHER))
        rows = list(map(self._row.__getitem__, chain.from_iterable(block)))
        cuts = [0, *accumulate(map(len, block))]
        row = np.array(rows, np.int64)
        self._blocks += 1
        self._met[row] = self._blocks
        sizes = np.add.reduceat(self._sizes[row], cuts[:-1])
        spelled = np.logical_and.reduceat(self._sizes[row, 2] > 0, cuts[:-1])  # a word that is not has no groups

        # Links of a slice's different words, as keys slice * step + pair.
        step, known = np.int64(self.size) << SHIFT, len(self._shown)
        held, times = np.unique(np.repeat(np.arange(len(block)), np.diff(cuts)) * known + row, return_counts=True)
        part, row = np.divmod(held, known)
        own, n = _ranges(self._start, row)
        keys, links = _summed(np.repeat(part, n) * step + self._pairs[own], np.repeat(times, n) * self._links[own])
        part, pair = np.divmod(keys, step)
        x = pair >> SHIFT
        same = self.identity[x] == pair - (x << SHIFT)  # links that the map says
        sides = [(part[w], key[w], links[w]) for w, key in ((same, x), (~same, pair))]
        at = [np.searchsorted(p, np.arange(len(block) + 1)).tolist() for p, _, _ in sides]

        for i, tally in enumerate(owners):
            if not spelled[i]:
                tally.refuse()
            elif tally.spelled:
                text = b"".join(map(self._shown.__getitem__, rows[cuts[i] : cuts[i + 1]]))[:-1]
                tally.add(sizes[i], text, *((key[c[i] : c[i + 1]], n[c[i] : c[i + 1]]) for (_, key, n), c in zip(sides, at)))

        keep = np.arange(known)
        if known > 2 * REMEMBERED:
            keep = np.sort(np.argsort(-self._met, kind="stable")[:REMEMBERED])
        if new and max(map(len, new)) > WALKED_TOGETHER:  # these came last
            keep = keep[: np.searchsorted(keep, known - sum(len(w) > WALKED_TOGETHER for w in new))]
        if len(keep) < known:
            self._keep(keep)

    def _linked(self, a, b, first_a, first_b, in_a, in_b, part):
        """(word, A id, B id, links) of the links of groups.

        A group of many tokens is taken by its different ids, so that a long run of repeats stays small.
        """
        several = in_a * in_b
        g = np.flatnonzero(several <= LINKS_AT_ONCE)
        times = several[g]
        of = np.repeat(g, times)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        found = [(part[of], a[first_a[of] + nth // in_b[of]], b[first_b[of] + nth % in_b[of]], np.ones(len(of), np.int64))]
        for i in np.flatnonzero(several > LINKS_AT_ONCE).tolist():
            xs, n = np.unique(a[first_a[i] : first_a[i] + in_a[i]], return_counts=True)
            ys, m = np.unique(b[first_b[i] : first_b[i] + in_b[i]], return_counts=True)
            found.append((np.full(len(xs) * len(ys), part[i]), np.repeat(xs, len(ys)), np.tile(ys, len(xs)), np.outer(n, m).ravel()))
        return tuple(np.concatenate(c) for c in zip(*found))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker process."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


STORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, mapped binary, mapped_links binary, pairs array<long>, pair_links array<long>"


def align_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the sizes and digest of its alignment, its links by mapped A id (packed ids and numbers of links) and by
    other pair.  One narrow pass over whole texts."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = own.documents(batch.column(1).to_pylist())
            columns = [
                batch.column(0), *(pa.array([int(r.sizes[i]) for r in rows], pa.int64()) for i in range(4)),
                pa.array([r.digest.hexdigest() if r.digest else "" for r in rows], pa.string()),
                *(pa.array([x.astype("<u4").tobytes() for x in column], pa.binary()) for column in zip(*(r.mapped for r in rows))),
                *(pa.array(column, pa.list_(pa.int64())) for column in zip(*(r.pairs for r in rows))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in STORED.split(", ")])

    return slim.mapInArrow(run, STORED)


def mapped_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """How many rows hold the mapped link of each A id: a vector per task, added up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["a", "n"])

    out = np.zeros(size, np.int64)
    for r in aligned.select("mapped").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():
        out[r["a"]] = r["n"]  # a row for each id of the vocabulary at most
    return out


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    An id pair's count is the number of rows of ``docs`` in which it is linked.  ``n_best``: links whose
    count is the highest of their A id over all rows, ties included; ``count_sum``: the counts of all links.
    A text that is null, empty or not spelled alike by both tokenizers (one with U+2581, say) has no
    tokens: zeros and ''.  Null ids and repeated rows pass through one to one and each row counts as a
    document; other columns are ignored; an empty table gives an empty result.

    Texts are read once and their alignments stored.  What is shuffled is a row's different pairs that the
    identity map does not say.  A pair that very many rows hold is a hot key of the join with the counts, whose
    sides AQE splits; the sums per row after it are combinable.  The driver gets vectors of A's vocabulary.
    """
    spark = docs.sparkSession
    own = Aligner(a_path, b_path)
    aligned = materialize(align_documents(docs, a_path, b_path, doc_id, text), "aligned")
    aligned = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned-rows")
    count = mapped_counts(aligned, own.size)

    zipped = F.explode(F.arrays_zip("pairs", "pair_links")).alias("x")
    links = aligned.select("row", zipped).select("row", F.col("x.pairs").alias("pair"), F.col("x.pair_links").alias("links"))
    counts = materialize(links.groupBy("pair").agg(F.count(F.lit(1)).alias("count")).withColumn("a", F.shiftright("pair", SHIFT)), "pair-counts")
    best = count.copy()
    for r in counts.groupBy("a").agg(F.max("count").alias("most")).collect():  # likewise
        best[r["a"]] = max(best[r["a"]], r["most"])
    highest = spark.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a long, most long")
    counts = counts.join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("is_best"))
    others = (
        links.join(counts, "pair")
        .groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("best_links"), F.sum(F.col("links") * F.col("count")).alias("link_counts"))
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_best = (count == best).astype(np.int64)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4") for x in batch.column(7).to_pylist()]
            n = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(8).to_pylist()]
            more = [pa.array([int(m @ v[i]) for i, m in zip(ids, n)], pa.int64()) for v in (is_best, count)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(7)), *more], names=[*kept, "mapped_best", "mapped_counts"])

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, mapped_best long, mapped_counts long"
    out = aligned.select(*kept, "mapped", "mapped_links").mapInArrow(sums, schema).join(others, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("mapped_best") + F.coalesce("best_links", F.lit(0))).alias("n_best"),
        (F.col("mapped_counts") + F.coalesce("link_counts", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
