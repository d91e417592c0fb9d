"""Toxicity as a factorization machine over hashed terms.

score(x) = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the x_i are
hashed terms of the text: each word and its leading letters, so that a stem is known
whatever ending it takes.  The pairwise part learns combinations (an insult next to a
group) that the linear part cannot weigh.  In the pairwise part a long text's terms are
scaled to a bounded norm, so that thousands of chance pairs do not drown the few that tell.

The machine is fitted on every hashed term that at least two rows of a bounded labelled
sample hold: none is dropped for what it tells on its own, as a term may tell only in
company.  Weights are kept sparse by a proximal step instead, factors by decay.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import TextBatch
from .common import held_out, slices, staged, texts

#: Hashed terms, the length of each term's factor, and the squared norm of a text's terms in pairs.
BUCKETS = 1 << 20
FACTORS = 4
PAIR_NORM = 64.0
#: Labelled rows of each class that the model is fitted on, at most (by hash order of the id).
SAMPLE = 5000
#: Passes over the sample at most, those before the factors join, and the loss that ends them.
PASSES = 12
LINEAR_PASSES = 4
LOSS = 0.03
STEMS = (4, 5)
REJECT = 0.7


def counts(batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed terms of each text: number of the text, bucket, count; sorted."""
    b = TextBatch([t.lower() for t in batch_texts])
    start, stop, owner = b.runs(b.letters())
    none = np.zeros(0, np.int64)
    keys = [none]
    for stem in (None, *STEMS):
        long = np.ones(len(start), bool) if stem is None else stop - start >= stem
        if long.any():
            h = b.hashes(start[long], stop[long] if stem is None else start[long] + stem) ^ np.uint64(0 if stem is None else stem)
            keys.append(owner[long] * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def values(count: np.ndarray) -> np.ndarray:
    """The value of a term that stands so often: 1 + ln(count)/2."""
    return (1 + 0.5 * np.log(np.maximum(count, 1))).astype(np.float32)


def features(batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed terms of each text: number of the text, bucket, value; sorted."""
    owner, bucket, count = counts(batch_texts)
    return owner, bucket, values(count)


def packed(bucket: np.ndarray, count: np.ndarray) -> bytes:
    """A row's sorted terms in about two bytes each: the gaps between buckets, then the counts, as
    32-bit numbers whose first, second, third and fourth bytes stand together, deflated."""
    numbers = np.concatenate((np.diff(bucket, prepend=0), count)).astype("<u4")
    return zlib.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(terms: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a ``packed`` row."""
    planes = np.frombuffer(zlib.decompress(terms), np.uint8).reshape(4, -1)
    gaps, count = np.ascontiguousarray(planes.T).view("<u4").reshape(2, -1)
    return np.cumsum(gaps, dtype=np.int64), count


def _in_pairs(owner: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The values as the pairwise part takes them."""
    return x * np.sqrt(PAIR_NORM / np.maximum(PAIR_NORM, np.bincount(owner, x * x, n)))[owner]


def _raw(bias: float, w: np.ndarray, v: np.ndarray, owner: np.ndarray, x: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The machine's value of each row before the sigmoid, the factor sums of the rows, and
    ``v * x`` of the terms; ``w`` and ``v`` are those of each term."""
    vx = v * pair[:, None]
    sums = np.stack([np.bincount(owner, vx[:, f], n) for f in range(v.shape[1])], 1)
    return bias + np.bincount(owner, w * x, n) + 0.5 * ((sums**2).sum(1) - np.bincount(owner, (vx**2).sum(1), n)), sums, vx


class Model:
    """Bias, and weights and factors of the sorted ``buckets``; all others have none.  At most
    BUCKETS of them, so the model has a bounded size."""

    def __init__(self, bias: float, buckets: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.buckets, self.w, self.v = bias, buckets, w, v
        self.row = np.full(BUCKETS, -1, np.int32)
        self.row[buckets] = np.arange(len(buckets))

    def __reduce__(self):
        """``row`` is not sent, but made again from the buckets."""
        return Model, (self.bias, self.buckets, self.w, self.v)

    def scores(self, batch_texts: list[str]) -> np.ndarray:
        """Probability of toxicity of each text."""
        owner, bucket, x = features(batch_texts)
        n, x = len(batch_texts), x.astype(float)
        pair = _in_pairs(owner, x, n)
        at = self.row[bucket]
        known = at >= 0
        owner, x, pair, at = owner[known], x[known], pair[known], at[known]
        raw, _, _ = _raw(self.bias, self.w[at], self.v[at], owner, x, pair, n)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(cuts: np.ndarray, bucket: np.ndarray, x: np.ndarray, y: np.ndarray, rows: int = 128, factors: int = FACTORS, seed: int = 11) -> Model:
    """Stochastic gradient on the logistic loss, both classes weighted alike.

    ``bucket`` and ``x`` are the terms of all rows, those of row ``i`` from ``cuts[i]`` to
    ``cuts[i + 1]``; ``y`` are the rows' classes.
    """

    def take(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = cuts[r + 1] - cuts[r]
        idx = np.arange(size.sum()) + np.repeat(cuts[r] - np.cumsum(size) + size, size)
        return size, bucket[idx], x[idx]

    return fit_rows(take, y, rows, factors, seed)


def fit_rows(take: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, rows: int = 128, factors: int = FACTORS, seed: int = 11) -> Model:
    """``fit`` on rows that ``take`` gives by their numbers: how many terms each has, and the
    buckets and values of those terms, row after row.  Only ``rows`` of them are held at a time.

    Terms of a single row are left out.  Each step touches only the terms of its rows.  Weights
    follow the regularised leader (a weight stays zero until its evidence passes ``sparse``),
    factors follow adaptive steps with decay.  The factors join after LINEAR_PASSES, to explain
    what the weights leave.
    """
    alpha, sparse, rate, decay, start = 0.15, 10.0, 0.05, 0.05, 0.03
    n, positive = len(y), int(y.sum())
    if not 0 < positive < n:
        return Model(30.0 if positive else -30.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    held_by = np.zeros(BUCKETS, np.int32)
    for a in range(0, n, rows):
        held_by += np.bincount(take(np.arange(a, min(a + rows, n)))[1], minlength=BUCKETS).astype(np.int32)
    buckets = np.flatnonzero(held_by > 1)
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 * n / positive, 0.5 * n / (n - positive))
    bias, bias_seen = 0.0, 1.0
    z, seen = np.zeros(len(buckets)), np.zeros(len(buckets))
    v, v_seen = np.zeros((len(buckets), factors)), np.full((len(buckets), factors), 0.01)
    weights = lambda i: -np.sign(z[i]) * np.maximum(np.abs(z[i]) - sparse, 0) * alpha / (1 + np.sqrt(seen[i]))
    for step in range(PASSES):
        loss, shuffled = 0.0, rng.permutation(n)
        if step == LINEAR_PASSES:
            v = rng.normal(0, start, v.shape)
        for a in range(0, n, rows):
            r = shuffled[a : a + rows]
            size, at, xs = take(r)
            own, at, xs = np.repeat(np.arange(len(r)), size), place[at], xs.astype(float)
            pair, known = _in_pairs(own, xs, len(r)), at >= 0
            own, xs, pair = own[known], xs[known], pair[known]
            ids, j = np.unique(at[known], return_inverse=True)
            w = weights(ids)
            raw, sums, vx = _raw(bias, w[j], v[ids][j], own, xs, pair, len(r))
            loss += (weight[r] * np.logaddexp(0, np.where(y[r] == 1, -raw, raw))).sum()
            g = weight[r] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[r])
            gw = np.bincount(j, g[own] * xs, len(ids))
            more = seen[ids] + gw * gw
            z[ids] += gw - (np.sqrt(more) - np.sqrt(seen[ids])) / alpha * w
            seen[ids] = more
            if step >= LINEAR_PASSES:
                gp = g[own] * pair
                gv = np.stack([np.bincount(j, gp * (sums[own, f] - vx[:, f]), len(ids)) for f in range(factors)], 1) / len(r) + decay * v[ids]
                v_seen[ids] += gv * gv
                v[ids] -= rate * gv / np.sqrt(v_seen[ids])
            bias_seen += g.mean() ** 2
            bias -= 0.1 * g.mean() / np.sqrt(bias_seen)
        if step >= LINEAR_PASSES and loss < LOSS * n:
            break
    return Model(float(bias), buckets, weights(np.arange(len(buckets))), v)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        owner, bucket, count = counts(texts(b))
        cuts = np.searchsorted(owner, np.arange(b.num_rows + 1)).tolist()
        terms = [packed(bucket[i:j], count[i:j]) for i, j in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(terms, pa.binary())], names=["doc_id", "label", "terms"])


def labelled(labels: DataFrame, column: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled ids of each class, in hash order of the id, none held out.  An
    id labelled twice has the larger label."""
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(column).alias("label"))
    part = lambda y: rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return part(0).union(part(1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows of each class.

    Only the hashed terms of the sampled rows, and the rows' classes, reach the driver: at
    most 2 * sample rows, whose texts have at most BUCKETS different terms each.  They come
    packed and stay so; each step unpacks those of its own rows.

    Null texts are empty; of rows with one doc_id the one of least text counts; without
    rows of both classes the score is constant (1 if all rows are toxic, else 0).
    """
    chosen = F.broadcast(labelled(labels, "toxic", sample))  # at most 2 * sample ids
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = staged(docs.mapInArrow(_extract, "doc_id long, label int, terms binary"))
    got = rows.orderBy("doc_id").select("label", "terms").toArrow()
    y, terms = got.column("label").to_numpy(), got.column("terms")

    def take(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [unpacked(terms[i].as_buffer()) for i in r.tolist()]
        return np.array([len(b) for b, _ in parts]), np.concatenate([b for b, _ in parts]), values(np.concatenate([c for _, c in parts]))

    return fit_rows(take, y)


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(model.value.scores(texts(b)))], names=["row", "score"])

    return score


def scores(documents: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id) of every row, and its ``score``.

    Null and empty texts have no terms and get the model's bias; repeated rows are scored
    alike and kept; an empty table gives an empty result.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.struct(*(columns or ["doc_id"])).alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_scorer(sent), f"row {kind}, score double").select("row.*", "score")


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
