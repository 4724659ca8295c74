"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad from features of the line and of its neighbours.  The
marginals of forward-backward, weighted by line length, give a share of good text, which a logistic
curve fitted on the same bounded sample turns into the document's score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import crc32_mod, hash_sample, materialize, tidied

N_OWN = 11  # features of a line itself
N_FEATURES = 3 * N_OWN + 3  # own, previous, next; first, last, bias
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so its powers can be undone modulo 2^64
_UNDO = np.uint64(pow(int(_STEP), -1, 1 << 64))
SLICE = 1 << 19  # bytes of a text whose features are computed at once (cut at line ends, in a long line at blanks)
BLANK = re.compile(rb"[ \t\r\v\f]")


def _class_table() -> np.ndarray:
    """Byte -> bit set: 1 letter, 2 upper case, 4 digit, 8 blank, 16 plain punctuation, 32 other sign."""
    t = np.full(256, 32, np.uint8)
    for b in range(256):
        ch = chr(b)
        if b >= 0x80 or ch.isalpha():
            t[b] = 1 | (2 if ch.isupper() and b < 0x80 else 0)
        elif ch.isdigit():
            t[b] = 4
        elif ch in " \t\r\v\f\n":
            t[b] = 8
        elif ch in ".,;:'\"?()-/":
            t[b] = 16
    return t


_CLASS = _class_table()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            _POWERS[size] = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, r, np.uint64))), dtype=np.uint64) for r in (_STEP, _UNDO))
    return _POWERS[size]


@dataclass
class Lines:
    """Sums over the bytes of each line; parts of one line add up."""

    length: np.ndarray
    sums: np.ndarray  # letters, upper case, digits, blanks, signs, words, repeated words, words ending in a sign, capitalised words
    line: np.ndarray  # rolling hash of the line
    first: np.ndarray  # hashes of its first and last words
    last: np.ndarray

    def joined(self, then: "Lines") -> "Lines":
        """``then`` begins in the middle of this one's last line, after a blank."""
        with np.errstate(over="ignore"):
            far = np.uint64(pow(int(_STEP), int(self.length[-1]), 1 << 64))
            line = self.line[-1:] + far * then.line[:1]
        sums = self.sums[-1] + then.sums[0]
        had, has = self.sums[-1, 5] > 0, then.sums[0, 5] > 0
        sums[6] += bool(had and has and self.last[-1] == then.first[0])
        pairs = [
            (self.length, self.length[-1:] + then.length[:1], then.length), (self.sums, sums[None], then.sums), (self.line, line, then.line),
            (self.first, (self.first if had else then.first[:1])[-1:], then.first), (self.last, then.last[:1] if has else self.last[-1:], then.last),
        ]
        return Lines(*(np.concatenate((x[:-1], one, y[1:])) for x, one, y in pairs))

    def features(self) -> np.ndarray:
        letter, upper, digit, blank, sign, words, repeats, sign_end, shout = self.sums.T
        same = np.zeros(len(self.length))
        same[1:] = (self.line[1:] == self.line[:-1]) & (self.length[1:] > 0)
        size, count = np.maximum(self.length, 1), np.maximum(words, 1)
        return np.stack([
            np.log1p(self.length) / 8, letter / size, upper / np.maximum(letter, 1), digit / size, blank / size, np.minimum(1, 4 * sign / size),
            repeats / count, sign_end / count, shout / count, same, np.minimum(1, (letter + digit) / count / 16),
        ], axis=1)


def line_sums(buf: np.ndarray) -> Lines:
    """Sums of every line of a byte buffer that ends with a line end."""
    n = len(buf)
    stop = np.flatnonzero(buf == 10)
    start = np.concatenate(([0], stop[:-1] + 1))
    cls = _CLASS[buf]

    def share(bit: int) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum((cls & bit) != 0)))
        return (c[stop] - c[start]).astype(float)

    space = (cls & 8) != 0
    ws = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    we = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        roll = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)))
        word = (roll[we] - roll[ws]) * down[ws]
        line = (roll[stop] - roll[start]) * down[start]
    m = len(stop)
    line_of = np.searchsorted(stop, ws)
    words = np.bincount(line_of, minlength=m).astype(float)
    again = np.zeros(len(ws), bool)
    again[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
    by_word = [again, (cls[we - 1] & 32) != 0, (cls[ws] & 2) != 0]
    ends = np.cumsum(words).astype(np.int64)
    held = np.concatenate((word, np.zeros(1, np.uint64)))  # a line without words has the hash of its neighbour, which is not looked at
    first, last = held[np.minimum(ends - words.astype(np.int64), len(word))], held[ends - 1] if len(word) else np.zeros(m, np.uint64)
    sums = [share(1), share(2), share(4), share(8), share(32), words, *(np.bincount(line_of, weights=w, minlength=m) for w in by_word)]
    return Lines(stop - start, np.stack(sums, axis=1), line, first, last)


def line_features(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own features of every line of a byte buffer that ends with a line end; and line lengths in bytes."""
    lines = line_sums(buf)
    return lines.features(), lines.length


def text_lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines of a whole text, with their neighbours', and line lengths.

    A text is read in slices of whole lines.  A longer line is read in parts that end at blanks and add up, so it
    stays one line; a word longer than a slice is read whole.
    """
    data = (text or "").encode("utf-8", "surrogatepass").replace(b"\r\n", b"\n")
    data += b"\n"
    done: list[Lines] = []
    at, goes_on = 0, False
    while at < len(data):
        end = len(data) if at + SLICE >= len(data) else data.find(b"\n", at + SLICE) + 1
        cut = BLANK.search(data, at + SLICE, end - 1) if end - at > 2 * SLICE else None
        if cut:
            end = cut.end()
        part = line_sums(np.frombuffer(data[at:end] + b"\n", np.uint8) if cut else np.frombuffer(data, np.uint8, end - at, at))
        if goes_on:
            part = done.pop().joined(part)
        done.append(part)
        at, goes_on = end, cut is not None
    f, n = _with_repeats(done)
    x = np.zeros((len(f), N_FEATURES))
    x[:, :N_OWN] = f
    x[1:, N_OWN : 2 * N_OWN] = f[:-1]
    x[:-1, 2 * N_OWN : 3 * N_OWN] = f[1:]
    x[0, -3] = x[-1, -2] = x[:, -1] = 1.0
    return x, n


def _with_repeats(parts: list[Lines]) -> tuple[np.ndarray, np.ndarray]:
    whole = parts[0] if len(parts) == 1 else Lines(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("length", "sums", "line", "first", "last")))
    return whole.features(), whole.length


def _grid(unary: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences (longest first) as one (step, sequence) grid and how many reach each step."""
    lens = np.array([len(u) for u in unary])
    order = np.argsort(-lens, kind="stable")
    grid = np.zeros((lens.max(), len(unary)))
    for col, i in enumerate(order):
        grid[: lens[i], col] = unary[i]
    alive = np.searchsorted(-lens[order], -np.arange(lens.max()), side="left")
    return grid, alive, order


def forward_backward(unary: list[np.ndarray], trans: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Marginal probability of 'good' per line, log partition per sequence, summed pair marginals (2, 2).

    State scores are 0 for bad (0) and ``unary`` for good (1); all sequences run in lockstep.
    """
    grid, alive, order = _grid(unary)
    steps, k = grid.shape
    fwd = np.zeros((steps, k, 2))
    fwd[0, :, 1] = grid[0]
    for s in range(1, steps):
        a = alive[s]
        prev = fwd[s - 1, :a]
        for j in (0, 1):
            fwd[s, :a, j] = np.logaddexp(prev[:, 0] + trans[0, j], prev[:, 1] + trans[1, j])
        fwd[s, :a, 1] += grid[s, :a]
    bwd = np.zeros((steps, k, 2))
    lens = np.array([len(u) for u in unary])[order]
    log_z = np.logaddexp(fwd[lens - 1, np.arange(k), 0], fwd[lens - 1, np.arange(k), 1])
    pair = np.zeros((2, 2))
    for s in range(steps - 1, 0, -1):
        a = alive[s]
        own = bwd[s, :a].copy()
        own[:, 1] += grid[s, :a]
        for i in (0, 1):
            both = own + trans[i][None, :]
            bwd[s - 1, :a, i] = np.logaddexp(both[:, 0], both[:, 1])
            pair[i] += np.exp(fwd[s - 1, :a, i, None] + both - log_z[:a, None]).sum(axis=0)
    good = np.exp(np.minimum(0, fwd[:, :, 1] + bwd[:, :, 1] - log_z[None, :]))
    out: list[np.ndarray] = [np.zeros(0)] * k
    z = np.zeros(k)
    for col, i in enumerate(order):
        out[i], z[i] = good[: lens[col], col], log_z[col]
    return out, z, pair


def blocked_forward_backward(unary: list[np.ndarray], trans: np.ndarray, cells: int = 200_000) -> tuple[list[np.ndarray], np.ndarray]:
    """``forward_backward`` in blocks of sequences of like length, whose grids stay small: marginals and pair sums."""
    good: list[np.ndarray] = [np.zeros(0)] * len(unary)
    pair = np.zeros((2, 2))
    order = sorted(range(len(unary)), key=lambda i: len(unary[i]))
    while order:
        block = [order.pop()]  # the longest left
        while order and (len(block) + 1) * len(unary[block[0]]) <= cells:
            block.append(order.pop())
        got, _, pairs = forward_backward([unary[i] for i in block], trans)
        for i, g in zip(block, got):
            good[i] = g
        pair += pairs
    return good, pair


@dataclass
class QualityModel:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float

    def shares(self, lines: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean of the 'good' marginals of each text (an empty line weighs one byte)."""
        good, _ = blocked_forward_backward([x @ self.weights for x, _ in lines], self.trans)
        return np.array([float((g * (n + 1)).sum() / (n + 1).sum()) for g, (_, n) in zip(good, lines)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        block: list[int] = []
        lines: list[tuple[np.ndarray, np.ndarray]] = []
        width = 0
        for i, t in enumerate(texts):  # blocks whose grid stays small, also with very long texts
            x = text_lines(t)
            if lines and (len(lines) + 1) * max(width, len(x[1])) > 200_000:
                out[block] = self._curve(self.shares(lines))
                block, lines, width = [], [], 0
            block.append(i)
            lines.append(x)
            width = max(width, len(x[1]))
        if lines:
            out[block] = self._curve(self.shares(lines))
        return out

    def _curve(self, share: np.ndarray) -> np.ndarray:
        share = np.clip(share, 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(share / (1 - share)) + self.offset, -500, 500)))


def fit(lines: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 200, rate: float = 0.1, l2: float = 1e-3) -> QualityModel:
    """Maximum likelihood with the document's label on each of its lines (Adam on the CRF gradient; a
    text's lines share its weight, so long texts do not outweigh others), then the logistic curve."""
    if not len(y):
        return QualityModel(np.zeros(N_FEATURES), np.zeros((2, 2)), 1.0, 0.0)
    w, t = np.zeros(N_FEATURES), np.zeros((2, 2))
    m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    total = sum(len(x) for x, _ in lines)
    x_all = np.concatenate([x for x, _ in lines])
    weight = np.concatenate([np.full(len(x), len(x) ** -0.5) for x, _ in lines])
    y_all = np.concatenate([np.full(len(x), float(k)) for (x, _), k in zip(lines, y)])
    pairs = np.zeros((2, 2))
    for (x, _), k in zip(lines, y):
        pairs[int(k), int(k)] += len(x) - 1
    for r in range(1, rounds + 1):
        good, pair = blocked_forward_backward([x @ w for x, _ in lines], t)
        g_w = x_all.T @ ((np.concatenate(good) - y_all) * weight) / weight.sum() + l2 * w
        g_t = (pair - pairs) / max(1, total) + l2 * t
        g = np.concatenate((g_w, g_t.ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        w, t = w - move[:N_FEATURES], t - move[N_FEATURES:].reshape(2, 2)
    model = QualityModel(w, t, 1.0, 0.0)
    share = np.clip(model.shares(lines), 1e-9, 1 - 1e-9)
    z = np.log(share / (1 - share))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps for the logistic curve, slightly regularised
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-2]])
        step = np.linalg.solve(h, np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b]))
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return QualityModel(w, t, float(max(a, 1e-3)), float(b))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fold: int = 0, folds: int = 5,
          per_class: int = 1500, max_bytes: int = 24_000_000, max_lines: int = 150_000) -> QualityModel:
    """Fit on labelled rows whose crc32(doc_id as text) mod ``folds`` is not ``fold``.

    The sample is bounded: ``per_class`` ids of each label with the smallest hashes, and of those as many as hold
    ``max_bytes`` and ``max_lines`` in all, texts of up to a hundredth of these bounds first, so that long ones
    are learned from where short ones do not fill it.  The first one always counts; texts are never
    shortened.  Of an id on several texts the one of the smallest text hash counts.  A doc_id with contradicting labels is
    left out.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
    known = known.filter(crc32_mod("doc_id", folds) != fold).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top"))
    known = known.filter(F.col("y") == F.col("top")).select("doc_id", "y")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    picked = hash_sample(known.join(slim.select("doc_id").distinct(), "doc_id", "left_semi"), "y", "doc_id", per_class)
    sample = slim.join(F.broadcast(picked), "doc_id")  # at most two classes of per_class ids
    # One text an id, by a rule: a combinable minimum, so an id on very many rows is reduced where they lie.
    sample = sample.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("t")).select("doc_id", "y", "t.text")
    sample = materialize(sample.withColumn("bytes", F.octet_length("text")).withColumn("lines", F.length("text") - F.length(F.translate("text", "\n", "")) + 1), "quality-sample")
    long = (F.col("bytes") > max_bytes / 100) | (F.col("lines") > max_lines / 100)
    order = Window.partitionBy("y").orderBy(long, F.xxhash64("doc_id"), "doc_id")
    fill = sample.select("doc_id", F.row_number().over(order).alias("nth"), F.sum("bytes").over(order).alias("b"), F.sum("lines").over(order).alias("l"))
    sample = sample.join(F.broadcast(fill.filter(f"nth = 1 OR b <= {max_bytes} AND l <= {max_lines}").select("doc_id")), "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in tidied(batches):
            got = [text_lines(t) for t in b["text"]]
            yield pd.DataFrame({
                "key": b["doc_id"].astype(str), "y": b["y"],
                "x": [x.astype("<f4").tobytes() for x, _ in got], "n": [n.astype("<i8").tobytes() for _, n in got],
            })

    rows = sample.mapInPandas(features, "key string, y int, x binary, n binary").toPandas()
    rows = rows.sort_values("key", kind="stable")
    lines_of = [(np.frombuffer(x, "<f4").reshape(-1, N_FEATURES).astype(float), np.frombuffer(n, "<i8")) for x, n in zip(rows["x"], rows["n"])]
    return fit(lines_of, rows["y"].to_numpy(float))


def score_column(text: str, model: QualityModel) -> Column:
    """Score from 0 to 1 of a text column; a null text is empty (one empty line)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in tidied(batches):
            yield pd.Series(model.scores([t if isinstance(t, str) else None for t in texts]))

    return score(F.col(text))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                  fold: int = 0, folds: int = 5, per_class: int = 1500) -> DataFrame:
    """Per row: doc_id, held_out, score (higher: label 1 likelier), predicted (score >= ``threshold``).

    A null or empty text is one empty line and is scored as such; without any usable label every score
    is 0.5.  A null doc_id is never learned from and not held out.  Repeated rows get equal results, one
    to one; other columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, doc_id, text, label, fold, folds, per_class)
    held = F.coalesce(crc32_mod("doc_id", folds) == fold, F.lit(False))
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), score_column(text, model).alias("score"))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
