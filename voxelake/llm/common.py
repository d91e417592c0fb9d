"""Helpers shared by the operators: word rules, staging in the shared folder, Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..staging import staged as staged

# Fixed values of the query contracts: the characters that separate words.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

spaced_words = re.compile(SPACED_WORD).findall
alnum_words = re.compile(ALNUM_WORD).findall
_FOLD = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only; every other character keeps its place and length."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def word_count(text: Column) -> Column:
    """Number of space-separated words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of an Arrow batch, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of at most ``rows`` rows, so that working memory follows a few
    documents instead of a whole Arrow batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def held_out(doc_id: Column) -> Column:
    """True for rows that no classifier may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
