"""Language-model scores: base column by brute force, probabilities that sum to one, gradients by differences."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voxelake.llm import language_model as lm

SCHEMA = "doc_id long, text string, lang string, row long, block int, at string, score double"
SPACED = re.compile(r"[^\x20\x09-\x0D]+").findall


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    tongues = [[f"{stem}{i}{end}" for i in range(40)] for stem, end in (("w", "ing"), ("ü", "tié"))]
    out = []
    for i in range(70):
        words = [rng.choice(tongues[i % 2][: rng.randint(1, 40)]) for _ in range(rng.randint(0, 80))]
        words += [f"Only{i}"] * (i % 5 == 0)
        out.append((i, rng.choice([" ", "\n", "\x0b "]).join(words).replace("w1", "W1"), "en", 1, 2, "x", 0.5))
    return out + out[:4] + [(None, "null id w3ing", None, 1, 2, "x", 0.5), (500, None, None, 1, 2, "x", 0.5), (501, " \t ", None, 1, 2, "x", 0.5), (502, "w1ing " * 3000, None, 1, 2, "x", 0.5)]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base_rows(rows):
    said = lambda t: [*SPACED(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    c = Counter(w for i, t, *_ in rows if not held_out(i) for w in said(t))
    n, v = sum(c.values()), len(c)
    return [(i, held_out(i), len(said(t)), sum(c[w] > 0 for w in said(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in said(t))) for i, t, *_ in rows]


def test_base_columns_and_gain(spark, rows):
    got = lm.language_scores(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (str(r[0]), r[2], r[5])
    found, want = sorted(map(tuple, got.collect()), key=key), sorted(base_rows(rows), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in want], rel=1e-9)
    tested = [r for r in found if r[1]]
    assert sum(r[6] for r in tested) > sum(r[5] for r in tested) and all(r[6] < 0 for r in found)


def test_blocks_and_parts_do_not_matter(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    a, b = (sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in lm.language_scores(docs, 2, *size).collect()) for size in ((lm.BLOCK, lm.PART), (37, 50)))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert np.allclose([x[2:] for x in a], [x[2:] for x in b], rtol=1e-5)


def test_no_rows_and_no_training_rows(spark):
    assert lm.language_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    out = next(i for i in range(100) if held_out(i))
    (row,) = lm.language_scores(spark.createDataFrame([(out, "a b", None, 1, 2, "x", 0.5)], SCHEMA)).collect()
    assert tuple(row)[:6] == (out, True, 3, 0, 0, 0.0) and row.score < 0 and math.isfinite(row.score)


def vocabulary(words):
    sums = np.zeros(3 + lm.ENDINGS, np.int64)
    for w, n in words.items():
        sums[:3] += (n, n > 0, n == 1)
        if n > 1:
            sums[3 + lm.ending(w)] += n
    top = sorted(((w, n) for w, n in words.items() if n > 1), key=lambda x: (-x[1], x[0]))
    return lm.Vocabulary(top[: lm.BUCKETS], sums, 7)


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    words = {f"w{i}{rng.choice('abcdefg')}{rng.choice('uvxyz')}": rng.choice([1, 1, 2, 5, 100 + i]) for i in range(3000)}
    v = vocabulary(words)
    n = np.array([*words.values(), 0, 7])
    kind, _ = v.describe([*words, "unseen", ""], n)
    kind[-1] = lm.END
    share = np.bincount(kind, np.exp(v.within(kind.astype(int), n)), lm.CLASSES)
    assert np.allclose(share[share > 0], 1)
    weights = np.random.default_rng(3).normal(0, 1, (lm.ROWS + 1, lm.CLASSES))
    z = lm.logits(weights, lm.features(np.array([0, 5, 1023]), np.array([0, 1023, 7])))
    assert np.allclose(np.exp(z - lm.normaliser(z)[:, None]).sum(1), 1)


def test_gradient_meets_differences():
    rng = np.random.default_rng(5)
    cell = np.unique(rng.integers(0, 9 * lm.CLASSES, 200) + rng.choice([0, lm.BUCKETS * lm.CLASSES * 3], 200))
    n = rng.integers(1, 6, len(cell))
    weights = rng.normal(0, 0.3, (lm.ROWS + 1, lm.CLASSES))
    observed, expected, scratch = (np.zeros_like(weights) for _ in range(3))
    lm.sums(cell, n, None, observed)
    lm.sums(cell, n, weights, expected)
    gradient = observed - expected
    rows = lm.features(cell // lm.CLASSES // lm.BUCKETS, cell // lm.CLASSES % lm.BUCKETS)
    for r, k in [(lm.ROWS, 3), (rows[0, 0], cell[0] % lm.CLASSES), (rows[9, 1], 5), (rows[20, 2], cell[20] % lm.CLASSES)]:
        step = np.zeros_like(weights)
        step[r, k] = 1e-4
        slope = (lm.sums(cell, n, weights + step, scratch) - lm.sums(cell, n, weights - step, scratch)) / 2e-4
        assert slope == pytest.approx(gradient[r, k], rel=1e-4, abs=1e-4)
