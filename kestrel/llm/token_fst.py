"""Byte-level BPE compiled to two deterministic transducers that count tokens.

1. ``WordSplitter`` is a deterministic automaton over character classes for the splitting
   pattern of the vocabulary (contractions, letters, numbers, others, white space).  Every
   transition is annotated with the word starts it emits.  A text is cut into chunks; each
   chunk yields a *state map* (entry state -> exit state) and the maps are composed by a
   parallel prefix scan (doubling), which gives each chunk its true entry state.
2. ``CountTransducer`` reads the bytes of one word.  A transition carries the change in the
   number of tokens, so the sum along a word is exactly the number of tokens BPE gives it.
   It is determinised on demand: a state is the set of vocabulary-trie nodes that are still
   open, each with the tokens that may legally end there, and the relative count.

Why the transducer is exact: a token sequence is the BPE encoding of its bytes if and only
if every adjacent pair is stable, i.e. BPE leaves the pair's bytes as those two tokens.  So
for each prefix of a word exactly one token can come last, and it is found from the open
trie nodes and the last token before each of them, which is what a state holds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

# ---------------------------------------------------------------- long texts

_CUT = re.compile(r"(?<=\S) (?=\S)")


def safe_slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in slices of about ``size`` characters whose tokens, one after the other, are the text's.

    A slice ends before a single blank between two other characters: a word always starts there, whatever stands
    before, so the words of the slices are those of the text.  A text without such a place stays whole.
    """
    at = 0
    while len(text) - at > 2 * size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


# ---------------------------------------------------------------- vocabulary


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves,
    the others take the code points from 256 upwards in byte order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary and merge ranks of a byte-level BPE ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        added = {t["content"] for t in spec.get("added_tokens", [])}
        self.special = sorted(added, key=lambda s: (-len(s), s))
        self.bytes_of = {i: bytes(alphabet[c] for c in s) for s, i in model["vocab"].items() if s not in added}
        ids = {b: i for i, b in self.bytes_of.items()}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, m in enumerate(model["merges"]):
            left, right = (m.split(" ") if isinstance(m, str) else m)
            lb, rb = (bytes(alphabet[c] for c in s) for s in (left, right))
            self.rank[ids[lb], ids[rb]] = (n, ids[lb + rb])

    def encode(self, word: bytes) -> list[int]:
        """Plain BPE of a short byte string: merge the lowest-ranked pair, leftmost first."""
        seq = [self.byte_id[b] for b in word]
        while len(seq) > 1:
            best = min(range(len(seq) - 1), key=lambda i: (self.rank.get((seq[i], seq[i + 1]), (1 << 60, 0))[0], i))
            hit = self.rank.get((seq[best], seq[best + 1]))
            if hit is None:
                break
            seq[best : best + 2] = [hit[1]]
        return seq


# ---------------------------------------------------------------- word splitting

# Character classes of the splitting automaton.
C_LETTER, C_NUMBER, C_OTHER, C_SPACE, C_WHITE, C_APOS, C_STMD, C_RV, C_E, C_L, C_END = range(11)
N_CLASSES = 16  # row length of the tables (a power of two)
UNKNOWN = 255
# States.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_W1S, S_W1O, S_WNS, S_WNO, S_APOS, S_APOS_E, S_APOS_L, S_DONE = range(12)
N_STATES = 12
HERE, BEFORE = 1, 2  # annotations: a word starts at this character / at the one before


def _splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    nxt = np.zeros((N_STATES, N_CLASSES), np.uint8)
    out = np.zeros((N_STATES, N_CLASSES), np.uint8)
    letters = (C_LETTER, C_STMD, C_RV, C_E, C_L)

    def kind(c: int) -> int:
        return S_LETTER if c in letters else {C_NUMBER: S_NUMBER, C_OTHER: S_OTHER, C_APOS: S_OTHER}[c]

    for s in range(N_STATES):
        for c in range(11):
            white, o = c in (C_SPACE, C_WHITE), 0
            if s in (S_APOS_E, S_APOS_L) and not (s == S_APOS_E and c == C_E) and not (s == S_APOS_L and c == C_L):
                o |= BEFORE  # no contraction after all: the letter before starts a word
            at = S_LETTER if s in (S_APOS_E, S_APOS_L) else s
            in_white = at in (S_W1S, S_W1O, S_WNS, S_WNO)
            if c == C_END:
                n = S_START
            elif s == S_APOS_E and c == C_E or s == S_APOS_L and c == C_L:
                n = S_DONE
            elif white:
                if in_white:
                    n = S_WNS if c == C_SPACE else S_WNO
                else:
                    n, o = (S_W1S if c == C_SPACE else S_W1O), o | HERE
            elif at == S_APOS and c in (C_STMD, C_RV, C_L):
                n = {C_STMD: S_DONE, C_RV: S_APOS_E, C_L: S_APOS_L}[c]
            elif in_white:
                if at in (S_WNS, S_WNO):
                    o |= BEFORE  # the last white-space character leaves the run
                if at in (S_W1S, S_WNS):
                    n = kind(c)  # ... and a blank joins the word
                else:
                    n, o = (S_APOS if c == C_APOS else kind(c)), o | HERE
            elif at == S_OTHER and c in (C_OTHER, C_APOS) or at == S_APOS and c in (C_OTHER, C_APOS):
                n = S_OTHER
            elif at == S_LETTER and c in letters or at == S_NUMBER and c == C_NUMBER:
                n = at
            else:
                n, o = (S_APOS if c == C_APOS else kind(c)), o | HERE
            nxt[s, c], out[s, c] = n, o
    return nxt.ravel(), out.ravel()


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (row i: entry state -> exit state of chunk i).

    Doubling: after step k every row is the composition of the 2^k chunks that end with it.
    """
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


class WordSplitter:
    """Word starts of the splitting pattern.  Character classes are asked from the tokenizer
    library itself, once per code point seen, so they agree with its Unicode version."""

    def __init__(self, split):
        self._split = split  # text -> [(piece, (start, end))]
        self.nxt, self.out = _splitter_tables()
        self.cls = np.full(0x110001, UNKNOWN, np.uint8)
        for c in range(128):
            self._ask(c)
        for chars, k in (("'", C_APOS), ("stmd", C_STMD), ("rv", C_RV), ("e", C_E), ("l", C_L), (" ", C_SPACE)):
            for ch in chars:
                self.cls[ord(ch)] = k
        self.cls[0x110000] = C_END

    def _ask(self, c: int) -> None:
        ch = chr(c)
        for probe, k in (("a", C_LETTER), ("1", C_NUMBER), ("!", C_OTHER)):
            if len(self._split(probe + ch)) == 1:
                self.cls[c] = k
                return
        self.cls[c] = C_WHITE

    def classes(self, points: np.ndarray) -> np.ndarray:
        sym = self.cls[points]
        if (sym == UNKNOWN).any():
            for c in np.unique(points[sym == UNKNOWN]):
                self._ask(int(c))
            sym = self.cls[points]
        return sym

    def starts(self, sym: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """Boolean word-start flags of a symbol stream in which every text ends with C_END."""
        n = len(sym)
        if n == 0:
            return np.zeros(0, bool)
        m = -(-n // chunk)
        grid = np.full(m * chunk, C_END, np.uint8)
        grid[:n] = sym
        grid = np.ascontiguousarray(grid.reshape(m, chunk).T)
        emitted = np.zeros((chunk, m), np.uint8)
        # Every entry state at once, until all of a chunk's states have met; then one state per chunk.
        maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[None, :], m, axis=0)
        p = 0
        while p < chunk and (maps != maps[:, :1]).any():
            maps = self.nxt[maps * np.uint8(N_CLASSES) + grid[p][:, None]]
            p += 1
        state = maps[:, 0].copy()
        for q in range(p, chunk):
            at = state * np.uint8(N_CLASSES) + grid[q]
            emitted[q] = self.out[at]
            state = self.nxt[at]
        if p < chunk:
            maps = np.repeat(state[:, None], N_STATES, axis=1)
        ends = compose_scan(maps)
        entry = np.full(m, S_START, np.uint8)
        entry[1:] = ends[:-1, S_START]
        for q in range(p):  # the chunk heads again, now from their true entry states
            at = entry * np.uint8(N_CLASSES) + grid[q]
            emitted[q] = self.out[at]
            entry = self.nxt[at]
        flat = emitted.T.reshape(-1)[:n]
        flags = (flat & HERE).astype(bool)
        flags[:-1] |= (flat[1:] & BEFORE).astype(bool)
        return flags


# ---------------------------------------------------------------- token counting

WIDE = 4  # subtrees of more tokens keep the last token itself instead of the tokens it allows


class CountTransducer:
    """Bytes of a word -> number of BPE tokens, determinised on demand.

    ``max_states`` bounds memory: when it is passed, the states are forgotten and built anew
    as needed (the counts never depend on it).
    """

    def __init__(self, bpe: Bpe, max_states: int = 120_000):
        self.bpe, self.max_states = bpe, max_states
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        parent = [0]
        for i, b in sorted(bpe.bytes_of.items()):
            node = 0
            for byte in b:
                nxt = self.child[node].get(byte)
                if nxt is None:
                    nxt = len(self.child)
                    self.child[node][byte] = nxt
                    self.child.append({})
                    self.token.append(-1)
                    parent.append(node)
                node = nxt
            self.token[node] = i
        size = [int(t >= 0) for t in self.token]
        for v in range(len(parent) - 1, 0, -1):
            size[parent[v]] += size[v]
        self.size = size
        self._below: dict[int, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._open: dict[tuple[int, int], object] = {}
        self._reset()

    # -- stability of pairs

    def whole(self, t: int) -> bool:
        got = self._whole.get(t)
        if got is None:
            got = self._whole[t] = self.bpe.encode(self.bpe.bytes_of[t]) == [t]
        return got

    def stable(self, last: int, t: int) -> bool:
        if last < 0:
            return self.whole(t)
        got = self._pairs.get((last, t))
        if got is None:
            b = self.bpe.bytes_of
            got = self._pairs[last, t] = self.whole(t) and self.bpe.encode(b[last] + b[t]) == [last, t]
        return got

    def below(self, v: int) -> tuple[int, ...]:
        got = self._below.get(v)
        if got is None:
            found, todo = [], [v]
            while todo:
                u = todo.pop()
                if u != v and self.token[u] >= 0:
                    found.append(self.token[u])
                todo.extend(self.child[u].values())
            got = self._below[v] = tuple(sorted(found))
        return got

    def opened(self, v: int, last: int):
        """What may still end below trie node v after token ``last``: None if nothing, the
        token itself for a wide subtree, else the frozen set of stable tokens."""
        if self.size[v] > WIDE:
            return last
        got = self._open.get((v, last), 0)
        if got == 0:
            got = frozenset(t for t in self.below(v) if self.stable(last, t)) or None
            self._open[v, last] = got
        return got

    # -- states

    def _reset(self) -> None:
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self.col = np.full(256, -1, np.int32)  # byte -> column, given on first use
        self.n_cols = 0
        self.table = np.full((1 << 12, 64), -1, np.int32)  # (next state << 8) | (change + 128)
        self._id(((0, -1, 0),))

    def _id(self, state: tuple) -> int:
        i = self._ids.get(state)
        if i is None:
            i = self._ids[state] = len(self._states)
            self._states.append(state)
            if i >= len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        return i

    def step(self, s: int, byte: int) -> int:
        """Build (or look up) one transition; returns the packed entry."""
        c = self.col[byte]
        if c < 0:
            if self.n_cols == self.table.shape[1]:
                self.table = np.hstack([self.table, np.full_like(self.table, -1)])
            c = self.col[byte] = self.n_cols
            self.n_cols += 1
        got = self.table[s, c]
        if got >= 0:
            return int(got)
        found, opened = None, []
        for v, may, rel in self._states[s]:
            w = self.child[v].get(byte)
            if w is None:
                continue
            t = self.token[w]
            if t >= 0 and found is None and (t in may if type(may) is frozenset else self.stable(may, t)):
                found = (t, rel + 1)
            if self.child[w]:
                opened.append((w, may, rel))
        t, change = found
        new = []
        for w, may, rel in opened:
            if type(may) is frozenset:
                may = may.intersection(self.below(w)) or None
            else:
                may = self.opened(w, may)
            if may is not None:
                new.append((w, may, rel - change))
        new.append((0, t, 0))
        entry = (self._id(tuple(new)) << 8) | (change + 128)
        self.table[s, c] = entry
        return entry

    def count_word(self, word: bytes) -> int:
        """Scalar path, for words too long to sit in a lockstep batch."""
        s = n = 0
        for i, b in enumerate(word):
            if len(self._states) > self.max_states and i % 1024 == 0:
                s = self._again(s)
            e = self.step(s, b)
            s, n = e >> 8, n + (e & 255) - 128
        return n

    def _again(self, s: int) -> int:
        state = self._states[s]
        self._reset()
        return self._id(state)

    def count_words(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray, long_word: int = 256) -> np.ndarray:
        """Token counts of the words buf[start : start + length], all words in lockstep."""
        counts = np.zeros(len(start), np.int64)
        order = np.argsort(-length, kind="stable")
        first = int(np.searchsorted(-length[order], -long_word, side="left"))  # words of more than long_word bytes
        for i in order[:first]:
            counts[i] = self.count_word(buf[start[i] : start[i] + length[i]].tobytes())
        order = order[first:]
        if not len(order):
            return counts
        if len(self._states) > self.max_states:
            self._reset()
        at, left = start[order], length[order]
        state = np.zeros(len(order), np.int32)
        total = np.zeros(len(order), np.int32)
        active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right")
        for p, n in enumerate(active):
            byte = buf[at[:n] + p]
            col = self.col[byte]
            e = self.table[state[:n], col]
            e[col < 0] = -1
            miss = np.flatnonzero(e < 0)
            if len(miss):
                key, inv = np.unique(state[miss].astype(np.int64) << 8 | byte[miss], return_inverse=True)
                e[miss] = np.array([self.step(int(k >> 8), int(k & 255)) for k in key], np.int32)[inv]
            state[:n] = e >> 8
            total[:n] += (e & 255) - 128
        counts[order] = total
        return counts


class TokenCounter:
    """Token counts of whole texts, by the two transducers."""

    def __init__(self, path: str, batch_bytes: int = 1 << 20):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        self.bpe = Bpe(path)
        self.splitter = WordSplitter(lib.pre_tokenizer.pre_tokenize_str)
        self.transducer = CountTransducer(self.bpe)
        self.batch_bytes = batch_bytes

    def _pieces(self, text: str) -> tuple[list[str], int]:
        """Special strings inside a text are one token each (the library's default)."""
        parts, n = [text], 0
        for s in self.bpe.special:
            if s and any(s in p for p in parts):
                cut = [p.split(s) for p in parts]
                n += sum(len(c) - 1 for c in cut)
                parts = [x for c in cut for x in c]
        return [p for p in parts if p], n

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = [0] * len(texts)
        pieces: list[str] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            parts, extra = self._pieces(text or "")
            out[i] += extra
            for p in (x for part in parts for x in safe_slices(part)):
                pieces.append(p)
                owner.append(i)
                size += len(p)
                if size >= self.batch_bytes:
                    self._count(pieces, owner, out)
                    pieces, owner, size = [], [], 0
        self._count(pieces, owner, out)
        return out

    def _count(self, pieces: list[str], owner: list[int], out: list[int]) -> None:
        if not pieces:
            return
        joined = "\0".join(pieces) + "\0"  # one place per END symbol
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        sym = self.splitter.classes(points)
        sym[ends] = C_END
        flags = self.splitter.starts(sym)
        flags[ends] = True  # an END place closes the last word; it is no word itself
        width = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
        offset = np.cumsum(width) - width
        buf = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        where = np.flatnonzero(flags)
        at = offset[where]
        length = np.diff(at, append=len(buf))
        word = sym[where] != C_END
        n = self.transducer.count_words(buf, at[word], length[word])
        piece = np.searchsorted(ends, where[word], side="left")
        per = np.bincount(piece, weights=n, minlength=len(pieces)).astype(np.int64)
        for i, c in zip(owner, per.tolist()):
            out[i] += c
