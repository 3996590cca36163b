"""Quality classifier: regularised quadratic discriminant analysis.

Whole texts become transformed statistics; each class has a mean and a
covariance shrunk towards a multiple of the identity; a score is the logistic
of the difference of the two Gaussian log densities, from Mahalanobis
distances by Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_TYPE, chunks, held_out, lighten, materialize, row_key, utf8
from .shingles import span_hashes, spans

FEATURES = (
    "log_chars", "word_length", "upper", "stops", "symbols", "exclaim", "bars", "spaces", "line_length",
    "variety", "echo", "top_word", "repeated_lines", "bare_symbols", "shouted", "wide", "entropy", "marked_words",
)
#: Words of plain prose that are added to a text's own before ratios are taken,
#: so that very short texts are near plain prose and not extreme; and what such words have of letters, upper
#: case, marks, blanks, and their entropy and variety.
SMOOTH = 20
PROSE = {"letters": 5.0, "upper": 0.15, "stops": 0.15, "blanks": 1.0, "entropy": 2.9, "variety": 0.9}
#: Weight of the identity in a class covariance.
SHRINKAGE = 0.3
#: A score from here on predicts label 1.
THRESHOLD = 0.7

_KINDS = np.zeros((256, 8))
_KINDS[65:91, 0] = 1  # upper case
_KINDS[97:123, 1] = 1  # lower case
_KINDS[[ord(c) for c in ".,;:'\"()-?"], 2] = 1  # marks of prose
_KINDS[[ord(c) for c in "#$%&*@^~<>=+_\\/{}[]`"], 3] = 1  # other marks
_KINDS[ord("!"), 4] = 1
_KINDS[ord("|"), 5] = 1
_KINDS[[32, 9, 10, 11, 12, 13], 6] = 1  # white space
_KINDS[128:, 7] = 1  # parts of wider characters
_CONTINUES = np.zeros(256, bool)
_CONTINUES[128:192] = True
_ALPHA = (_KINDS[:, 0] + _KINDS[:, 1] + _KINDS[:, 7]) > 0
_LOWER = (_KINDS[:, 1] + _KINDS[:, 7]) > 0
_PLAIN = _ALPHA.copy()
_PLAIN[48:58] = True  # and digits
_MARK = (_KINDS[:, 3] + _KINDS[:, 4] + _KINDS[:, 5]) > 0


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def _distinct(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the number of distinct values, and the count of the commonest."""
    if not len(values):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    fresh = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (r[1:] != r[:-1]))))
    counts = np.diff(np.concatenate((fresh, [len(v)])))
    most = np.zeros(rows)
    np.maximum.at(most, r[fresh], counts)
    return np.bincount(r[fresh], minlength=rows).astype(float), most


def document_statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; raw, offsets: the texts' UTF-8 bytes."""
    rows = len(offsets) - 1
    if not rows:
        return np.zeros((0, len(FEATURES)))
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    histogram = np.bincount(owner * 256 + raw, minlength=rows * 256).reshape(rows, 256).astype(float)
    size = np.diff(offsets).astype(float)
    upper, lower, stop, symbol, exclaim, bar, space, wide = (histogram @ _KINDS).T
    chars = size - histogram[:, _CONTINUES].sum(axis=1)
    share = histogram / np.maximum(size, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log(share), 0).sum(axis=1)

    starts, stops, counts = spans(raw, offsets)
    n = counts.astype(float)
    word_row = np.repeat(np.arange(rows), counts)
    hashes = span_hashes(raw, starts, stops)
    distinct, most = _distinct(hashes, word_row, rows)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    alpha, low, mark, plain = (_running(kind[raw]) for kind in (_ALPHA, _LOWER, _MARK, _PLAIN))
    letters = alpha[stops] - alpha[starts]
    bare = plain[stops] == plain[starts]
    shouted = (letters >= 2) & (low[stops] == low[starts])
    marked = mark[stops] > mark[starts]
    per_row = lambda flags: np.bincount(word_row[flags], minlength=rows)

    breaks = np.flatnonzero(raw == 10)
    line_row = np.concatenate((np.arange(rows), np.searchsorted(offsets, breaks, side="right") - 1))
    line_start = np.concatenate((offsets[:-1], breaks + 1))
    order = np.lexsort((line_start, line_row))
    line_row, line_start = line_row[order], line_start[order]
    line_stop = np.minimum(np.concatenate((line_start[1:], [len(raw)])), offsets[line_row + 1])
    lines = np.bincount(line_row, minlength=rows).astype(float)
    distinct_lines, _ = _distinct(span_hashes(raw, line_start, line_stop), line_row, rows)

    prose = {k: v * SMOOTH for k, v in PROSE.items()}
    base, letter_base = n + SMOOTH, upper + lower + wide + prose["letters"]
    size_base = size + prose["letters"] + prose["blanks"]
    root = lambda part, whole: np.sqrt(part / whole)
    return np.stack([
        np.log(chars + prose["letters"] + prose["blanks"]),
        (size - space + prose["letters"]) / base,
        root(upper + prose["upper"], letter_base),
        root(stop + prose["stops"], base),
        root(symbol, base),
        root(exclaim, base),
        root(bar, base),
        root(space + prose["blanks"], size_base),
        np.log(size_base / (lines + 1)),
        (np.log1p(distinct) / np.log(n + 3) * n + prose["variety"]) / base,
        root(per_row(same), base),
        root(most, base),
        root(lines - distinct_lines, lines + 3),
        root(per_row(bare), base),
        root(per_row(shouted), base),
        root(wide, size_base),
        (entropy * n + prose["entropy"]) / base,
        root(per_row(marked), base),
    ], axis=1)


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every whole text; null as empty. A column ``key`` is passed on."""
    keyed = [c for c in ("key",) if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for batch in batches:
            for part in chunks(batch, "text"):
                x = document_statistics(*utf8(part.column("text")))
                listed = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed, *map(part.column, keyed)], ["doc_id", "x", *keyed])

    return docs.select("doc_id", "text", *keyed).mapInArrow(run, "doc_id long, x array<double>" + KEY_TYPE * len(keyed))


@dataclass(frozen=True)
class Gaussian:
    """One class: log prior minus half the log determinant, mean, inverse Cholesky factor of the covariance."""

    offset: float
    mean: np.ndarray
    factor: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        # einsum sums in the same order for any number of rows, so equal texts score equally
        z = np.einsum("nj,ij->ni", x - self.mean, self.factor)
        return self.offset - 0.5 * (z * z).sum(axis=1)


@dataclass(frozen=True)
class Discriminant:
    """scale: divides the statistics; low, high: the classes of label 0 and 1, None where nothing was learnt."""

    scale: np.ndarray
    low: Gaussian | None
    high: Gaussian | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.low is None and self.high is None:
            return np.full(len(x), 0.5)
        if self.low is None or self.high is None:
            return np.full(len(x), 0.0 if self.high is None else 1.0)
        difference = self.high.log_density(x / self.scale) - self.low.log_density(x / self.scale)
        return 1 / (1 + np.exp(-np.clip(difference, -500, 500)))


def fit_moments(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Discriminant:
    """moments: label -> rows, sum of x, sum of outer products of x."""
    d = len(FEATURES)
    present = {k: m for k, m in moments.items() if m[0] > 0}
    total = sum(m[0] for m in present.values())
    if not total:
        return Discriminant(np.ones(d), None, None)
    mean = sum(m[1] for m in present.values()) / total
    scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in present.values())) / total - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)

    def gaussian(n: float, total_x: np.ndarray, outer: np.ndarray) -> Gaussian:
        mu = total_x / n / scale
        covariance = outer / n / np.outer(scale, scale) - np.outer(mu, mu)
        target = max(np.trace(covariance) / d, 0.01)
        covariance = (1 - shrinkage) * covariance + shrinkage * target * np.eye(d)
        lower = np.linalg.cholesky(covariance)
        return Gaussian(float(np.log(n / total) - np.log(np.diag(lower)).sum()), mu, np.linalg.inv(lower))

    return Discriminant(scale, *(gaussian(*present[k]) if k in present else None for k in (0, 1)))


def fit(table: DataFrame, labels: DataFrame) -> Discriminant:
    """Learns from all labelled rows of ``table`` that are not held out: each
    partition adds up its moments, and only their sums come to the driver. A
    document labelled more than once counts once, as what most of its labels
    say (1 on a tie). Labels other than 0 and 1 and null ids are ignored."""
    d = len(FEATURES)
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    rows = table.where(~held_out()).join(known, "doc_id").select("label", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            label = np.asarray(batch.column("label"))
            for k in (0, 1):
                own = x[label == k]
                sums[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)))
        label, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[label, at])], ["label", "at", "value"])

    parts = rows.mapInArrow(run, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    sums = np.zeros((2, 1 + d + d * d))
    for label, at, value in parts.collect():  # 2 * (1 + d + d * d) numbers at most
        sums[label, at] = value
    return fit_moments({k: (s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)) for k, s in enumerate(sums)})


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keyed: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted; ``keyed``: and key, the row_key.

    Null texts count as empty, and empty ones are scored like any other. Repeated
    rows are scored each. Without labels of both classes the score is constant
    (0.5 without any). A null id is kept; an empty table gives no rows. Columns of ``docs`` other than the two named are not looked at."""
    extra = ["key"] if keyed else []
    key = [row_key(F.col(id_col), F.col(text_col)).alias("key")] if keyed else []
    table = materialize(statistics_table(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *key)), "quality-statistics")
    model = fit(table, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *map(batch.column, extra)], ["doc_id", "held_out", "score", "predicted", *extra])

    return table.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + KEY_TYPE * len(extra))
