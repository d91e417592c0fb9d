"""Quality as regularised quadratic discriminant analysis of document statistics.

Each class is a normal distribution over transformed statistics of a text (lengths,
character shares, repetition), with the class covariance shrunk towards the pooled one and
towards its diagonal.  The score is the probability of class 1 from the difference of the
Mahalanobis log-densities, by Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import TextBatch, letter_table, upper_table
from .common import held_out, slices, texts
from .toxicity import labelled

#: Labelled rows of each class whose statistics shape the model, at most (by hash order of the id).
SAMPLE = 20_000
TO_POOLED = 0.1
TO_DIAGONAL = 0.05
FEATURES = 14


def statistics(batch_texts: list[str]) -> np.ndarray:
    """Transformed statistics of each text, one row each; the empty text has defined ones."""
    b = TextBatch(batch_texts)
    p, size = b.points, np.maximum(b.size, 1)
    letter = b.letters()
    upper = upper_table()[np.minimum(p, 0xFFFF)]
    digit = (p >= 48) & (p <= 57)
    space = (p == 32) | ((p >= 9) & (p <= 13))
    plain = (p == 46) | (p == 44)
    share = lambda x: b.per_text(x) / size
    symbols = share(~(letter | digit | space | plain))
    start, stop, owner = b.runs(letter)
    words = np.bincount(owner, minlength=b.n).astype(float)
    many = np.maximum(words, 1)
    length = (stop - start).astype(float)
    mean = np.bincount(owner, length, b.n) / many
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, b.n) / many - mean**2, 0))
    h = b.hashes(start, stop)
    order = np.lexsort((h, owner))
    o, s = owner[order], h[order]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (s[1:] != s[:-1])))[: len(o)]
    distinct = np.bincount(o[new], minlength=b.n)
    count = np.diff(np.append(np.flatnonzero(new), len(o)))
    top = np.zeros(b.n)
    np.maximum.at(top, o[new], count)
    again = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (h[1:] == h[:-1])], minlength=b.n)
    spaced_start, spaced_stop, spaced_owner = b.runs(~space)
    spaced = np.maximum(np.bincount(spaced_owner, minlength=b.n), 1)
    ends = p[np.maximum(spaced_stop - 1, 0)] if len(p) else p
    odd_end = np.bincount(spaced_owner[~(letter_or_plain(ends))], minlength=b.n) / spaced
    lines = b.per_text(p == 10) + 1
    eps = 1e-3
    log = lambda x: np.log(x + eps)
    return np.column_stack([
        np.log1p(b.size), np.log1p(words / lines), log(share(upper) / np.maximum(share(letter), eps)), log(symbols), log(odd_end), log(share(digit)), log(share(plain)),
        log(share(space)), log(mean), log(spread), log(distinct / many), log(top / many), log(again / many), log(np.bincount(owner[length <= 3], minlength=b.n) / many),
    ])


def letter_or_plain(p: np.ndarray) -> np.ndarray:
    """Does a word end in a letter, digit, full stop or comma?"""
    b = np.minimum(p, 0xFFFF)
    return letter_table()[b] | ((p >= 48) & (p <= 57)) | (p == 46) | (p == 44)


class Model:
    """Means, Cholesky factors and log-determinants of the two classes, and the log prior odds."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, classes: list[tuple[np.ndarray, np.ndarray]], constant: float | None = None):
        self.centre, self.scale, self.constant = centre, scale, constant
        self.parts = []
        for mean, covariance in classes:
            factor = np.linalg.cholesky(covariance)
            self.parts.append((mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        density = [-0.5 * ((((z - mean) @ inverse.T) ** 2).sum(1) + logdet) for mean, inverse, logdet in self.parts]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / np.sqrt(FEATURES), -30, 30)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """From each class's count, sums and sums of products.  Classes have equal priors; the
    log-density difference is divided by the square root of the number of statistics, which
    keeps its sign and softens the overconfidence of correlated statistics."""
    d = FEATURES
    if set(moments) != {0, 1}:
        return Model(np.zeros(d), np.ones(d), [], 1.0 if 1 in moments else 0.0)
    n = sum(m[0] for m in moments.values())
    centre = sum(m[1] for m in moments.values()) / n
    scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments.values())) / n - centre**2, 1e-6))
    means, covariances, pooled = [], [], np.zeros((d, d))
    for c in (0, 1):
        k, s, ss = moments[c]
        mean = s / k
        covariance = (ss / k - np.outer(mean, mean)) / np.outer(scale, scale)
        means.append((mean - centre) / scale)
        covariances.append(covariance)
        pooled += covariance * k / n
    shrunk = []
    for c in covariances:
        c = (1 - TO_POOLED) * c + TO_POOLED * pooled
        shrunk.append((1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + 0.01 * np.eye(d))
    return Model(centre, scale, list(zip(means, shrunk)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and products of each class over the rows of one task."""
    total: dict[int, np.ndarray] = {}
    for b in slices(batches):
        x = statistics(texts(b))
        x = np.column_stack([np.ones(len(x)), x])
        y = b.column("label").to_numpy()
        for c in (0, 1):
            if (y == c).any():
                total[c] = total.get(c, 0) + x[y == c].T @ x[y == c]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.ravel().tolist() for m in total.values()], pa.list_(pa.float64()))], names=["label", "m"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows of each class; tasks return moments, not rows.

    Null texts are empty; a doc_id that occurs several times counts as often; without rows
    of both classes the score is constant.
    """
    chosen = F.broadcast(labelled(labels, "quality", sample))  # at most 2 * sample ids
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("text", "label")
    total: dict[int, np.ndarray] = {}
    for r in docs.mapInArrow(_moments, "label int, m array<double>").groupBy("label").agg(F.sort_array(F.collect_list("m")).alias("m")).collect():
        total[r.label] = np.sum([np.reshape(m, (FEATURES + 1, FEATURES + 1)) for m in r.m], axis=0)
    return fit({c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in total.items()})


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.scores(statistics(texts(b))), pa.float64())], names=["doc_id", "score"])

    return score


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row.

    Null and empty texts have the statistics of the empty text; repeated rows are kept;
    other columns are ignored; an empty table gives an empty result.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(_scorer(sent), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
