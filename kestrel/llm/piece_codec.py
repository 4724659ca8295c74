"""Exact merge-type encoding of SentencePiece BPE models by backtracking, and decoding.

A BPE model merges, again and again, the adjacent pair of symbols whose joined string is the piece of
the highest score, the leftmost of equal ones.  A sequence of pieces is the result of that process if
and only if every two adjacent pieces are: merging the two pieces' characters anew gives just these
two.  (The first merge to cross a border would also be the first choice among the two pieces alone.)
So the encoder never runs the merge process over a text.  It walks left to right, takes the longest
piece at each place, and goes to shorter ones, then back, while a piece does not fit its neighbour.

* Longest pieces come from an Aho-Corasick automaton of the reversed pieces, run once over the
  reversed characters: its first match at a place is the longest piece that begins there.
* Whether two pieces may stand side by side is found by re-merging their characters; answers are kept.
* A bit per position records that the rest from there was found to have no encoding, so each position is
  left for good at most once and the walk stays linear.

No piece of the vocabulary has a blank after another character (checked when the model is read), so a text
falls into words with their leading blanks.  Each worker remembers words it has met; those that are new to
a batch of texts are walked together, one step of all words at a time, in arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "\u2581"
REMEMBERED = 200_000  # words that a worker keeps twice over, before it forgets (results do not depend on it)
REMEMBERED_PAIRS = 2_000_000
WALKED_TOGETHER = 64  # characters: a longer word is walked alone and not remembered
SLICE = 1 << 20  # characters that are cut into words, or walked, at once
WORD = re.compile(" *[^ ]+| +")
WORD_END = re.compile("(?<=[^ ]) ")
CODE_POINTS = 0x110000


class PieceEncoder:
    """Encoder of one SentencePiece BPE model with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        normal, byte = 1, 6
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or kinds - {1, 2, 3, 6}:
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep the text as it is, but for blanks, are supported")
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == normal}
        self.score = {p.piece: p.score for p in model.pieces if p.type == normal}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == byte}
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a piece with a blank after another character: texts would not fall into words")
        # Tokens: the ids of pieces, and behind all ids the code points of characters that are no piece.
        self.size = len(model.pieces)
        self.text_of = {i: p for p, i in self.id.items()}
        self.length = np.ones(self.size + CODE_POINTS, np.int32)
        self.shorter = np.full(self.size + CODE_POINTS, -1, np.int64)  # the next shorter token with which a token begins
        for p, i in self.id.items():
            self.length[i] = len(p)
            if len(p) > 1:
                self.shorter[i] = next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), self.size + ord(p[0]))
        self.character = np.arange(CODE_POINTS, dtype=np.int64) + self.size  # code point -> token
        for p, i in self.id.items():
            if len(p) == 1:
                self.character[ord(p)] = i
        self._build_automaton()
        self._pairs = np.zeros(0, np.int64)  # sorted: left token + 1, right token
        self._fits = np.zeros(0, bool)
        self._young: dict[str, bytes] = {}  # words met lately, and
        self._old: dict[str, bytes] = {}  # those before: words met again are kept, the others forgotten

    # -------------------------------------------------------------- longest pieces

    def _build_automaton(self) -> None:
        """Aho-Corasick automaton of the reversed pieces, in flat arrays.

        ``goto`` maps state * CODE_POINTS + code point to a state; ``fail`` is the state of the longest proper
        suffix; ``longest_at`` is the longest piece that is a suffix of a state, or -1.
        """
        goto: dict[int, int] = {}
        own, parent, letter, depth = [-1], [0], [0], [0]
        for piece, i in self.id.items():
            state = 0
            for c in map(ord, reversed(piece)):
                to = goto.setdefault(state * CODE_POINTS + c, len(own))
                if to == len(own):
                    own.append(-1)
                    parent.append(state)
                    letter.append(c)
                    depth.append(depth[state] + 1)
                state = to
            own[state] = i
        fail, best = [0] * len(own), own[:]
        for state in sorted(range(1, len(own)), key=depth.__getitem__):
            if depth[state] > 1:
                back = fail[parent[state]]
                while (to := goto.get(back * CODE_POINTS + letter[state])) is None and back:
                    back = fail[back]
                fail[state] = to or 0
            if best[state] < 0:
                best[state] = best[fail[state]]
        self.goto, self.fail, self.longest_at = goto, np.array(fail, np.int64), np.array(best, np.int64)
        self._fail_list, self._longest_list = fail, best
        # The same transitions as an open-addressing table, for many states at a time.
        self._mask = (1 << (8 * len(goto)).bit_length()) - 1
        self._keys, self._to = np.full(self._mask + 1, -1, np.int64), np.zeros(self._mask + 1, np.int32)
        keys, states = np.fromiter(goto.keys(), np.int64, len(goto)), np.fromiter(goto.values(), np.int32, len(goto))
        slot = self._slot(keys)
        while len(keys):
            free = self._keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self._keys[slot[put]], self._to[slot[put]] = keys[put], states[put]
            keys, states, slot = keys[~put], states[~put], (slot[~put] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(30)).astype(np.int64) & self._mask

    def _step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The automaton's next states."""
        out = np.zeros(len(states), np.int64)
        row, state = np.arange(len(states)), states
        key = state * CODE_POINTS + codes
        slot = self._slot(key)
        while len(row):
            held = self._keys[slot]
            hit = held == key
            out[row[hit]] = self._to[slot[hit]]
            none = held < 0  # no such transition: try the failure state's, or stay at the root
            go = ~hit & ~(none & (state == 0))
            row, state, key, slot, none = row[go], state[go], key[go], slot[go], none[go]
            state = np.where(none, self.fail[state], state)
            key = np.where(none, state * CODE_POINTS + codes[row], key)
            slot = np.where(none, self._slot(key), (slot + 1) & self._mask)
        return out

    def _longest(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The longest token that begins at each place (the single character where no piece does)."""
        out = self.character[codes]
        if len(start) == 1:
            goto, fail, best, state = self.goto, self._fail_list, self._longest_list, 0
            for at in range(int(stop[0]) - 1, int(start[0]) - 1, -1):
                c = int(codes[at])
                while (to := goto.get(state * CODE_POINTS + c)) is None and state:
                    state = fail[state]
                state = to or 0
                if best[state] >= 0:
                    out[at] = best[state]
            return out
        at, state, first = stop - 1, np.zeros(len(stop), np.int64), start
        while len(at):
            state = self._step(state, codes[at].astype(np.int64))
            found = self.longest_at[state]
            some = found >= 0
            out[at[some]] = found[some]
            at = at - 1
            left = at >= first
            at, state, first = at[left], state[left], first[left]
        return out

    # -------------------------------------------------------------- pieces side by side

    def remerge(self, text: str) -> list[str]:
        """The merge process itself over a short string."""
        score, none = self.score.get, float("-inf")
        parts = list(text)
        scores = [score(x + y, none) for x, y in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)  # the leftmost of equal ones
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def _text(self, token: int) -> str:
        return "" if token < 0 else self.text_of[token] if token < self.size else chr(token - self.size)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each token of ``right`` may follow that of ``left`` (-1: nothing, so whether it is reachable at all)."""
        keys = (left + 1) * np.int64(self.size + CODE_POINTS) + right
        at = np.searchsorted(self._pairs, keys)
        known = at < len(self._pairs)
        known[known] = self._pairs[at[known]] == keys[known]
        if not known.all():
            new, first = np.unique(keys[~known], return_index=True)
            pairs = [(self._text(a), self._text(b)) for a, b in zip(left[~known][first].tolist(), right[~known][first].tolist())]
            answers = np.array([self.remerge(a + b) == ([a, b] if a else [b]) for a, b in pairs], bool)
            if len(self._pairs) > REMEMBERED_PAIRS:
                self._pairs, self._fits = self._pairs[:0], self._fits[:0]
                return self.fits(left, right)
            places = np.searchsorted(self._pairs, new)
            self._pairs, self._fits = np.insert(self._pairs, places, new), np.insert(self._fits, places, answers)
            at = np.searchsorted(self._pairs, keys)
        return self._fits[at]

    # -------------------------------------------------------------- the walk

    def walk(self, words: list[str]) -> list[np.ndarray]:
        """Tokens of each word (not empty; blanks as U+2581), all words one step at a time.

        ``before[p]`` is the token that ends at place p.  There is one at most: tokens that fit up to p are the
        encoding of the word up to p.
        """
        codes = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
        stop = start + sizes
        longest = self._longest(codes, start, stop)
        if len(words) == 1:
            return [self._walk_alone(longest.tolist())]
        before = np.full(len(longest) + 1, -1, np.int64)
        failed = np.zeros(len(longest) // 8 + 1, np.uint8)  # a bit a place: the rest of the word from there has no encoding
        at, end = start.copy(), stop
        token = longest[at]
        while len(at):
            back = token < 0  # nothing shorter is left here: the place fails, and the token before it must be shorter
            if back.any():
                p = at[back]
                np.bitwise_or.at(failed, p >> 3, (1 << (p & 7)).astype(np.uint8))
                last = before[p]  # the first place of a word never fails: the merge process gives an encoding
                before[p] = -1
                at[back] = p - self.length[last]
                token[back] = self.shorter[last]
            to = at + np.where(token < 0, 0, self.length[token])
            open_ = (token >= 0) & (failed[to >> 3] >> (to & 7).astype(np.uint8) & 1 == 0)
            ok = open_.copy()
            ok[open_] = self.fits(before[at[open_]], token[open_])
            no = ~ok & (token >= 0)
            token[no] = self.shorter[token[no]]
            before[to[ok]] = token[ok]
            at = np.where(ok, to, at)
            left = at < end
            more = ok & left
            token[more] = longest[at[more]]
            at, end, token = at[left], end[left], token[left]
        return self._collect(before, start, stop)

    def _walk_alone(self, longest: list[int]) -> np.ndarray:
        """The same walk over a single (long) word."""
        n = len(longest)
        failed, taken, known = bytearray(n // 8 + 1), [], {}
        at, token, left = 0, longest[0], -1
        while at < n:
            while token < 0:
                failed[at >> 3] |= 1 << (at & 7)
                last = taken.pop()
                at -= int(self.length[last])
                token, left = int(self.shorter[last]), taken[-1] if taken else -1
            end = at + int(self.length[token])
            fits = not failed[end >> 3] >> (end & 7) & 1
            if fits and (fits := known.get((left, token))) is None:
                a, b = self._text(left), self._text(token)
                fits = known[left, token] = self.remerge(a + b) == ([a, b] if a else [b])
            if fits:
                taken.append(token)
                at, left = end, token
                token = longest[at] if at < n else -1
            else:
                token = int(self.shorter[token])
        return self._ids(np.array(taken, np.int64), np.zeros(n and len(taken), np.int64))[0]

    def _collect(self, before: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        taken, place, rank = [], stop.copy(), np.arange(len(stop))
        while len(place):
            token = before[place]
            place = place - self.length[token]
            taken.append((place, rank, token))
            left = place > start[rank]
            rank, place = rank[left], place[left]
        place, rank, token = (np.concatenate([t[i] for t in taken]) for i in range(3))
        order = np.argsort(place, kind="stable")  # words lie one behind the other
        ids, rank = self._ids(token[order], rank[order])
        cuts = [0, *np.cumsum(np.bincount(rank, minlength=len(stop))).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _ids(self, token: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokens and the word of each: a character that is no piece becomes its bytes."""
        alone = token >= self.size
        if alone.any():
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in (token[alone] - self.size).tolist()]
            times = np.ones(len(token), np.int64)
            times[alone] = [len(b) for b in raw]
            rank, token, alone = np.repeat(rank, times), np.repeat(token, times), np.repeat(alone, times)
            token[alone] = [self.byte[x] for b in raw for x in b]
        return token.astype(np.int32), rank

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of different words, each with its leading blanks (not empty; U+2581 counts as a blank)."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        batch: list[int] = []
        size = 0
        for i, w in enumerate(words):
            if len(w) > WALKED_TOGETHER:
                out[i] = self.walk([w.replace(" ", BLANK)])[0]
                continue
            batch.append(i)
            size += len(w) + 1
            if size > SLICE or i + 1 == len(words):
                self._walk_into(out, words, batch)
                batch, size = [], 0
        self._walk_into(out, words, batch)
        return out

    def _walk_into(self, out: list[np.ndarray], words: list[str], batch: list[int]) -> None:
        if batch:
            for i, ids in zip(batch, self.walk([words[i].replace(" ", BLANK) for i in batch])):
                out[i] = ids

    # -------------------------------------------------------------- texts

    def encode(self, texts: list[str | None], add_end: bool = False) -> list[np.ndarray]:
        """Token ids of whole texts, as the sentencepiece library gives them."""
        out, end = [], np.int32(self.end_id).tobytes() if add_end else b""
        block: list[list[str]] = []
        size = 0
        for t in texts:
            t = self.prefix + t.replace(BLANK, " ") if t else ""
            if len(t) > SLICE:  # in slices
                out += self._join(block, end)
                block, size, parts, at = [], 0, [], 0
                while at < len(t):
                    cut = WORD_END.search(t, at + SLICE)
                    stop = cut.start() if cut else len(t)
                    parts += self._join([WORD.findall(t, at, stop)], b"")
                    at = stop
                out.append(np.concatenate([*parts, np.frombuffer(end, np.int32)]))
                continue
            block.append(WORD.findall(t))
            size += len(t)
            if size > SLICE:  # the new words of these texts are walked together
                out += self._join(block, end)
                block, size = [], 0
        return out + self._join(block, end)

    def _join(self, block: list[list[str]], end: bytes) -> list[np.ndarray]:
        words = set().union(*block) if block else set()
        new = words.difference(self._young)
        again = {w for w in new if w in self._old}
        self._young.update((w, self._old[w]) for w in again)
        new = list(new.difference(again))
        got = {w: x.tobytes() for w, x in zip(new, self.encode_words(new))}
        long = {w: x for w, x in got.items() if len(w) > WALKED_TOGETHER}
        self._young.update((w, x) for w, x in got.items() if len(w) <= WALKED_TOGETHER)
        known = self._young if not long else {**{w: self._young[w] for w in words if w not in long}, **long}
        out = [np.frombuffer(b"".join(map(known.__getitem__, t)) + end, np.int32) for t in block]
        if len(self._young) > REMEMBERED:
            self._old, self._young = self._young, {}
        return out


_ENCODERS: dict[str, PieceEncoder] = {}
_LIBRARY: dict[str, object] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def decoder(path: str):
    """The library's processor, for its ``decode``: one per worker process."""
    if path not in _LIBRARY:
        import sentencepiece

        _LIBRARY[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LIBRARY[path]


def encode_and_decode(docs: DataFrame, model_path: str, add_end: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array<int>: the whole text's token ids, with the end id if ``add_end``) and
    decoded (string: the library's decoding of these ids).

    Ids are those of the sentencepiece library without sampling.  One narrow pass over whole texts, no
    shuffle.  A null text counts as empty (only the end id; decoded to the empty text); null ids and
    repeated rows pass through one to one; other columns are ignored; an empty table gives an empty
    result.  A character outside the vocabulary becomes its bytes; U+2581 reads as a blank.  Memory of a
    task is that of a batch of texts and, for a word without any blank, some hundred bytes a character.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, library = encoder(model_path), decoder(model_path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = own.encode(batch.column(1).to_pylist(), add_end)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
            decoded = pa.array([library.decode(x.tolist()) if len(x) else "" for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], names=["doc_id", "ids", "decoded"])

    return slim.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """Per row of ``encode_and_decode``: n_tokens, ids_sha256 (decimal ids joined by a blank), decoded_sha256 (UTF-8)."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
