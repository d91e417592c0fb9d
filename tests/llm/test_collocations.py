"""Collocations against SQL over all phrases, the perfect hash against its keys."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelake.llm import collocations

SCHEMA = "doc_id long, text string, lang string, key long, words string, n long, f int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(9)] + ["Ä", "x\x00y", "a-b", "É", "é"]
    out = []
    for i in range(90):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(["w0 W1 w2 w3 w4", "w5 w6", "w5 w6 w7", "a-b É", "w8 w8 w8 w8 w8 w8", *vocabulary, *vocabulary]) + rng.choice([" ", " ", "\t", "  ", ".", "\n", ", ", "\x0b", " "])
        out.append((i, text, rng.choice(["en", "en", "de", None, "und", "en:w"]), 1, "w", 2, 3))
    return out + out[:7] + [(None, None, "en", 1, "w", 2, 3), (91, "", None, 1, "w", 2, 3), (92, " \t.. ", "xx", 1, "w", 2, 3)]


@pytest.mark.parametrize("least,report,shard", [(3, 7, 40), (5, 2000, 1_000_000), (2, 100, 300), (100_000, 10, 10)])
def test_collocations_meet_sql(spark, rows, least, report, shard):
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least, report, shard)
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "key", "words", "n", "f"])  # noqa: F841
    want = duckdb.sql(collocations.collocations_sql(least, report))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert least > 100 or got.count()


def test_no_phrases(spark):
    for rows in ([], [(1, None, None, None, None, None, None)]):
        assert collocations.collocations(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_scores_are_exact(spark):
    cases = [(10**16 + 7, 10**17 - 3, 10**16 + 9, 10**17 - 11), (100, 2**62 % 10**17, 100, 100), (3, 1, 7, 5), (10**15 + 1, 10**15 + 3, 10**15 + 1, 10**15 + 2)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(collocations.exact_score(*[F.col(c) for c in "anlr"])).collect()]
    assert got == [1000 * a * n // (left * right) for a, n, left, right in cases]


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        table = collocations.PerfectHash(keys)
        assert table.n == len(keys) and sorted(table.slots(keys)) == list(range(len(keys)))
        assert (table.slots(rng.integers(1, 2**63, 100).astype(np.uint64)) < max(table.n, 1)).all()


def test_slots_verify_stored_words():
    keys, words = np.array([11, 12], np.uint64), np.array([[11, 0, 0, 0, 0], [5, 6, 0, 0, 0]], np.uint64)
    shard = collocations.Shard(0, 1, keys, words)
    row, slot = shard.find(np.array([12, 12, 12], np.uint64), [np.array([5, 5, 7], np.uint64), np.array([6, 9, 6], np.uint64)])
    assert row.tolist() == [0] and shard.words[slot[0]].tolist() == [5, 6, 0, 0, 0]
    assert not len(shard.find(np.array([12], np.uint64), [np.array([5], np.uint64)])[0])


def test_long_text_is_cut_at_breaks():
    text = b"Ab cd." * 50 + b"x" * 40 + " Ä\ty".encode()
    parts = list(collocations._chunks(text, 10))
    assert b"".join(parts) == text and max(map(len, parts)) <= 52
    assert [t for p in parts for t in collocations.tokens(p)] == collocations.tokens(text)
    assert collocations.tokens("Ä!B\x1fc \x0b".encode()) == ["Ä".encode(), b".", b"b\x1fc", b"."]
