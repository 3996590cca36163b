"""Language identification: sparse multinomial logistic regression.

Character n-grams are hashed to a fixed number of features and weighted by
TF-IDF, document frequencies being counted over every row that may be learnt
from. Weights are trained with follow-the-regularised-leader and elastic-net
penalties, then one temperature calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_TYPE, held_out, row_key

#: Hashed features; n-grams of 1 to GRAMS characters.
DIMENSIONS, GRAMS = 1 << 14, 3
#: At most about this many labelled documents of each language, and of all, train the weights
#: and the temperature; of many languages each has the fewer. Frequencies are counted over all.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 600, 6000
#: Follow-the-regularised-leader: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.02
EPOCHS = 3
UNDETERMINED = "und"

_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(text: str, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Which hashed n-grams the whole lower-cased text has, ascending, and how often.
    White space of any length is one blank, and there is one at either end."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    code = np.zeros(len(points), np.uint64)
    hashed = []
    for n in range(min(GRAMS, len(points))):
        code = code[: len(points) - n] * np.uint64(_MIX[1]) + points[n:] * np.uint64(_MIX[0]) + np.uint64(n + 1)
        mixed = code ^ (code >> np.uint64(29))
        hashed.append(((mixed * np.uint64(_MIX[2])) >> np.uint64(16)) & np.uint64(dimensions - 1))
    every = np.concatenate(hashed).astype(np.int64)
    if len(every) < dimensions // 8:  # short texts are sorted, long ones counted in cells
        at, total = np.unique(every, return_counts=True)
        return at.astype(np.int32), total
    total = np.bincount(every, minlength=dimensions)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[at]
    return x / max(np.sqrt(np.dot(x, x)), 1e-12)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language (the first of equal ones) and its probability; ``und``, 0 without a letter."""
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        at, counts = gram_counts(text)
        p = softmax(self.logits(at, weigh(at, counts, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, dimensions: int, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal, a row at a time: per-coordinate rates from the sums of squared
    gradients; a weight is zero while its accumulated gradient is within L1."""
    z, n = np.zeros((dimensions + 1, classes)), np.zeros((dimensions + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, label = rows[k]
            at, x = np.append(at, dimensions), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            error = softmax(x @ w)
            error[label] -= 1
            g = np.outer(x, error)
            squared = ns + g * g
            z[at] = zs + g - (np.sqrt(squared) - np.sqrt(ns)) / ALPHA * w
            n[at] = squared
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition: how many documents have each n-gram; feature -1 counts the documents."""
    seen, rows = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            at, _ = gram_counts(text)
            seen[at] += 1
            rows += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], rows))], ["feature", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [gram_counts(text) for text in batch.column("text").to_pylist()]
        ends = pa.array(np.concatenate(([0], np.cumsum([len(at) for at, _ in grams]))).astype(np.int32))
        at, counts = (np.concatenate([np.zeros(0, t), *(g[k] for g in grams)]) for k, t in ((0, np.int32), (1, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(counts))], ["lang", "doc_id", "at", "counts"])


def fit(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the text and lang of the rows of ``docs`` that are not held out.

    Which rows are in the bounded sample depends on a hash of their id alone.
    One row in five of the sample sets the temperature, the rest the weights."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    frequency = {f: n for f, n in rows.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect()}  # DIMENSIONS + 1 rows at most
    total = frequency.pop(-1, 0)
    seen = np.zeros(DIMENSIONS)
    seen[list(frequency)] = list(frequency.values())
    idf = np.log((1 + total) / (1 + seen)) + 1

    by_language = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    languages = tuple(sorted(lang for lang, _ in by_language))
    if not languages:
        return Model((), idf, np.zeros((DIMENSIONS, 0)), np.zeros(0), 1.0)
    spread = (F.xxhash64("doc_id") % 1_000_000 + 1_000_000) / 2_000_000
    each = min(sample_per_language, max(1, sample_rows // len(languages)))
    share = F.element_at(F.create_map(*[F.lit(v) for lang, n in by_language for v in (lang, min(1.0, each / n))]), F.col("lang"))
    chosen = rows.where(spread < share)
    sample = chosen.mapInArrow(_sparse, "lang string, doc_id long, at array<int>, counts array<long>").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    ready = []
    for lang, at, counts in zip(sample["lang"].to_pylist(), sample["at"], sample["counts"], strict=True):
        at, counts = np.asarray(at.values), np.asarray(counts.values)
        ready.append((at, weigh(at, counts, idf), languages.index(lang)))
    apart = [k % 5 == 4 for k in range(len(ready))]
    weights, bias = train_ftrl([r for r, a in zip(ready, apart, strict=True) if not a], len(languages), DIMENSIONS)
    checks = [r for r, a in zip(ready, apart, strict=True) if a]
    logits = np.array([x @ weights[at] + bias for at, x, _ in checks]).reshape(-1, len(languages))
    return Model(languages, idf, weights, bias, fit_temperature(logits, np.array([y for *_, y in checks], int)))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keyed: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1); ``keyed``: and key, the row_key.

    ``und`` with score 0: null text, text without a letter, and every text where
    nothing could be learnt. Ties go to the alphabetically first language. Every language
    of the rows that may be learnt from is learnt. Repeated rows are predicted each; a null id is
    kept and may be learnt from; an empty table gives no rows. Other columns are not looked at."""
    extra = ["key"] if keyed else []
    key = [row_key(F.col(id_col), F.col(text_col)).alias("key")] if keyed else []
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), *key)
    model = fit(slim)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), *map(batch.column, extra)], ["doc_id", "held_out", "lang_pred", "score", *extra])

    return slim.select("doc_id", "text", held_out().alias("held_out"), *extra).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + KEY_TYPE * len(extra))
