"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all learnable documents by Spark.  The weights are fitted
by follow-the-regularised-leader (FTRL-proximal, L1 + L2) on a bounded sample of feature vectors and a
temperature is then fitted on the part of the sample that the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import crc32_mod, hash_sample, tidied

BUCKETS = 1 << 14  # hashed n-grams
ORDERS = (1, 2, 3)
SLICE = 1 << 20  # characters of a text that are hashed at once
LETTER = regex.compile(r"\p{L}")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)  # odd multipliers


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of the lower-cased characters of a whole text."""
    out = np.zeros(BUCKETS, np.int64)
    text = text.lower()
    for at in range(0, len(text), SLICE):
        part = np.frombuffer(text[max(0, at - 2) : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        back = at - max(0, at - 2)  # characters before the slice: only n-grams that end inside it are new
        h = np.zeros(len(part), np.uint32)
        for order in ORDERS:
            if len(part) < order:
                break
            h = (h[: len(part) - order + 1] + part[order - 1 :]) * _MIX[order]
            mixed = (h ^ (h >> np.uint32(15))) * _MIX[0]
            bucket = (mixed >> np.uint32(32 - 14)).astype(np.int64)
            out += np.bincount(bucket[max(0, back - order + 1) :], minlength=BUCKETS)
    return out


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray  # (BUCKETS,)
    weights: np.ndarray  # (BUCKETS + 1, labels); the last row is the bias
    temperature: float

    def features(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf
        return (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and self.labels and LETTER.search(t)]
        for a in range(0, len(known), 32):
            block = known[a : a + 32]
            x = self.features(np.stack([ngram_counts(texts[i]) for i in block]))
            p = _softmax((x @ self.weights[:-1] + self.weights[-1]) / self.temperature)
            for row, i in enumerate(block):
                best = int(p[row].argmax())
                names[i], score[i] = self.labels[best], min(1.0, float(p[row, best]))
        return names, score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, alpha: float = 0.5, beta: float = 1.0,
             l1: float = 0.002, l2: float = 0.002, epochs: int = 3, seed: int = 7) -> np.ndarray:
    """FTRL-proximal for multinomial logistic regression; rows are (feature indices, values)."""
    z = np.zeros((BUCKETS + 1, n_labels))
    n = np.zeros_like(z)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(z[at], n[at])
            p = _softmax(x @ w)
            p[y[i]] -= 1.0
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature that minimises the log loss (golden section over its logarithm)."""
    if not len(y):
        return 1.0

    def loss(t):
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    a, b, r = np.log(0.01), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Document frequency of every bucket and the number of documents, over all rows of ``docs``."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in tidied(batches):
            for t in batch["t"]:
                df += ngram_counts(t or "") > 0
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], n)})

    got = docs.select(F.col(text).alias("t")).mapInPandas(partial, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS)
    for r in got:  # at most BUCKETS + 1 rows
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
    return df, next((int(r["n"]) for r in got if r["bucket"] == -1), 0)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 2, folds: int = 4,
          per_language: int = 800, max_languages: int = 200) -> LanguageModel:
    """Fit on rows with text, lang and id whose crc32(doc_id as text) mod ``folds`` is not ``fold``.

    ``per_language`` bounds the sample the weights see (the ids of each language with the smallest hashes, and of
    an id on several texts the one of the smallest text hash) and ``max_languages`` the languages: those of most
    rows, ties to the first name, so that dirty values of ``lang`` make neither weights nor sample grow.
    Document frequencies cover all such rows.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    learn = slim.filter((crc32_mod("doc_id", folds) != fold) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n_docs = document_frequencies(learn, "text")
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
    known = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(max_languages).select("lang")
    picked = hash_sample(learn.select("doc_id", "lang").join(F.broadcast(known), "lang").distinct(), "lang", "doc_id", per_language)
    sample = learn.join(F.broadcast(picked), ["doc_id", "lang"])  # at most max_languages * per_language ids
    # One text an id and language, by a rule: a combinable minimum, so an id on very many rows is reduced where they lie.
    sample = sample.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("t")).select("doc_id", "lang", "t.text")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in tidied(batches):
            counts = [ngram_counts(t) for t in b["text"]]
            at = [np.flatnonzero(c) for c in counts]
            yield pd.DataFrame({
                "key": b["doc_id"].astype(str), "lang": b["lang"],
                "at": [a.astype("<u2").tobytes() for a in at],
                "n": [c[a].astype("<u4").tobytes() for c, a in zip(counts, at)],
            })

    rows = sample.mapInPandas(vectors, "key string, lang string, at binary, n binary").toPandas()
    rows = rows.sort_values(["key", "lang"], kind="stable").reset_index(drop=True)
    labels = sorted(rows["lang"].unique())
    if not labels:
        return LanguageModel([], idf, np.zeros((BUCKETS + 1, 0)), 1.0)
    y = rows["lang"].map({name: i for i, name in enumerate(labels)}).to_numpy()
    x = []
    for a, c in zip(rows["at"], rows["n"]):
        at = np.frombuffer(a, "<u2").astype(np.int64)
        v = np.frombuffer(c, "<u4").astype(float) * idf[at]
        x.append((np.append(at, BUCKETS), np.append(v / max(np.sqrt((v * v).sum()), 1e-12), 1.0)))
    held = np.arange(len(x)) % 5 == 0  # for the temperature
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(x))
    w = fit_ftrl([x[i] for i in fit], y[fit], len(labels))
    check = np.flatnonzero(held)
    logits = np.array([x[i][1] @ w[x[i][0]] for i in check]).reshape(len(check), len(labels))
    return LanguageModel(labels, idf, w, fit_temperature(logits, y[check]))


def prediction(text: str, model: LanguageModel) -> Column:
    """Column struct(lang, score): ``und`` and 0 for a null text or one without a letter."""

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in tidied(batches):
            names, score = model.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang": names, "score": score})

    return predict(F.col(text))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 2, folds: int = 4,
             per_language: int = 800) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (calibrated probability of lang_pred).

    A null text, or one without a letter, is ``und`` with score 0; so is every row when nothing can be
    learned (no labelled rows).  A null doc_id is never learned from and not held out.  Repeated
    rows get equal results, one to one; other columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, doc_id, text, lang, fold, folds, per_language)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), prediction(text, model).alias("p"))
    held = F.coalesce(crc32_mod("doc_id", folds) == fold, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
