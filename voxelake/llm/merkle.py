"""Document fingerprints as Merkle trees over sections, paragraphs and clauses.

A paragraph is a line; a section ends with a paragraph whose hash is a multiple of four, so
that an edit moves only the section it is in; a paragraph's leaves are its clauses.  The
fingerprint is the root (128 bits) followed by the tree: each section's and paragraph's hash
(32 bits) before what it holds, and the leaves' (32 bits in five characters).  Two fingerprints are compared
from the root down: equal roots mean equal texts, equal nodes count whole, and only branches
that differ are descended into.  The share of leaves under equal nodes is the likeness.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A leaf ends with the end of a sentence or a line, or after this many characters.
LEAF_CHARS = 48
#: Hex digits of a section's or paragraph's hash, and characters of a leaf's: five digits to the
#: base 85 hold 32 bits.
NODE, LEAF = 8, 5
_DIGITS = [chr(c) for c in range(33, 127) if chr(c) not in ",/:="][:85]
_TWO = [a + b for a in _DIGITS for b in _DIGITS]
SECTION_EVERY = 4
#: Documents that one range bucket should hold, and the most buckets.
BUCKET_ROWS = 4000
MOST_BUCKETS = 65_536

_leaves = re.compile(r"[^.!?;|\n]{1,%d}[.!?;|\n]*|[.!?;|\n]+" % LEAF_CHARS).findall
_digest = xxhash.xxh32_intdigest


def _leaf(text: str) -> str:
    h = _digest(text.encode("utf-8", "surrogatepass"))
    h, low = divmod(h, 7225)
    high, middle = divmod(h, 7225)
    return _DIGITS[high] + _TWO[middle] + _TWO[low]


def fingerprint(text: str) -> str:
    """``root:section/section...``; a section is its hash, ``=`` and its paragraphs joined by
    ``,``; a paragraph is its hash and its leaves' side by side."""
    sections, paragraphs, leaves, nodes, branch = [], [], [], [], []

    def close_paragraph() -> bool:
        node = _digest("".join(leaves))
        branch.append(f"{node:08x}")
        paragraphs.append(branch[-1] + "".join(leaves))
        leaves.clear()
        return node % SECTION_EVERY == 0

    def close_section() -> None:
        nodes.append(f"{_digest(''.join(branch)):08x}")
        sections.append(f"{nodes[-1]}={','.join(paragraphs)}")
        paragraphs.clear()
        branch.clear()

    for leaf in _leaves(text):
        leaves.append(_leaf(leaf))
        if leaf[-1] == "\n" and close_paragraph():
            close_section()
    if leaves:
        close_paragraph()
    if paragraphs:
        close_section()
    root = xxhash.xxh3_128_hexdigest(f"{len(text)}:{''.join(nodes)}:{xxhash.xxh3_64_hexdigest(text.encode('utf-8', 'surrogatepass'))}")
    return f"{root}:{'/'.join(sections)}"


def _sections(fp: str) -> list[tuple[str, str]]:
    """The sections of a fingerprint: hash, paragraphs."""
    return [(s[:NODE], s[NODE + 1 :]) for s in fp[33:].split("/")] if len(fp) > 33 else []


def _paragraphs(section: str) -> list[tuple[str, str]]:
    """The paragraphs of a section: hash, leaves."""
    return [(p[:NODE], p[NODE:]) for p in section.split(",")]


def _weight(inner: str) -> int:
    """Number of leaves of a section's paragraphs."""
    paragraphs = inner.count(",") + 1
    return (len(inner) - paragraphs * (NODE + 1) + 1) // LEAF


def _apart(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> tuple[list[str], list[str], list[str]]:
    """What nodes of equal hash hold, and what the others of ``a`` and of ``b`` hold."""
    open_b, same, only_a, only_b = Counter(h for h, _ in b), [], [], []
    for h, inner in a:
        if open_b[h]:
            open_b[h] -= 1
            same.append(inner)
        else:
            only_a.append(inner)
    for h, inner in reversed(b):
        if open_b[h]:
            open_b[h] -= 1
            only_b.append(inner)
    return same, only_a, only_b[::-1]


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else twice the leaves under equal nodes over all leaves of both."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = _sections(a), _sections(b)
    total = sum(_weight(inner) for _, inner in x + y)
    same, x_only, y_only = _apart(x, y)
    common = sum(map(_weight, same))
    same, x_only, y_only = _apart([p for s in x_only for p in _paragraphs(s)], [p for s in y_only for p in _paragraphs(s)])
    common += sum(map(len, same)) // LEAF
    leaves = lambda branches: Counter(p[i : i + LEAF] for p in branches for i in range(0, len(p), LEAF))
    common += sum((leaves(x_only) & leaves(y_only)).values())
    return 2 * common / total if total else 0.0


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """Where ``b`` has branches that ``a`` has not: (section, paragraph) numbers in ``b``.  Sections
    of equal hash are not descended into."""
    if a[:32] == b[:32]:
        return []
    old = _sections(a)
    sections, paragraphs = {h for h, _ in old}, {h for _, s in old for h, _ in _paragraphs(s)}
    return [(i, j) for i, (h, s) in enumerate(_sections(b)) if h not in sections for j, (p, _) in enumerate(_paragraphs(s)) if p not in paragraphs]


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the following text's start."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, guest, order): each with the row behind it.  One row waits."""
    waiting = None
    for b in slices(batches, 256):
        rows = []
        for bucket, guest, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
            text = text or ""
            fp = fingerprint(text) if not guest or waiting else None
            if waiting and waiting[0] == bucket:
                _, its_id, its_text, its_fp = waiting
                new = edited(its_text, text)
                new_fp = fingerprint(new)
                rows.append((its_id, len(its_text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), its_fp, new_fp, likeness(its_fp, new_fp), likeness(its_fp, fp)))
            waiting = None if guest else (bucket, doc_id, text, fp)
        cols = list(zip(*rows)) or [()] * 7
        kinds = [b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` for every row of ``documents``.

    The next document is the one of next smaller doc_id (after the last: the first); null
    ids come last, rows of equal id are ordered by their text's hash, and a single row is its
    own next.  Null texts are empty.  Other columns are ignored; an empty table gives an empty
    result.

    Documents are dealt into ranges of (id, hash of text), whose bounds are quantiles over all
    ids; an id that is several quantiles, or no id, is split by the hash.  A range's last
    document finds its next one in a copy of the following range's first document, so the
    texts are shuffled once.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    ids = docs.select("doc_id", "h")
    n, known = ids.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    buckets = max(1, min(MOST_BUCKETS, known // BUCKET_ROWS))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = np.array(sorted(ids.agg(F.percentile_approx("doc_id", cuts, 10 * MOST_BUCKETS).alias("b")).first().b or []) if cuts else [], np.int64)
    without = max(1, min(MOST_BUCKETS, (n - known) // BUCKET_ROWS))

    @F.pandas_udf("int")
    def bucket_of(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        has_id, values = doc_id.notna().to_numpy(), doc_id.fillna(0).astype("int64").to_numpy()
        share = (h.to_numpy() >> 32) + (1 << 31)  # of 2**32
        first, last = (np.searchsorted(bounds, values, side) for side in ("left", "right"))
        place = len(bounds) - first - (share * (last - first) >> 32)
        return pd.Series(np.where(has_id, place, len(bounds) + without - (share * without >> 32)).astype(np.int32))

    bucket: Column = bucket_of("doc_id", "h")
    head = F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "h"))
    first = sorted((r.bucket, r.first.doc_id, r.first.h) for r in ids.withColumn("bucket", bucket).groupBy("bucket").agg(head.alias("first")).collect())  # a row a bucket
    heads = F.broadcast(spark.createDataFrame([(i, h, first[k - 1][0]) for k, (_, i, h) in enumerate(first)], "head long, head_h long, guest_of int"))
    dealt = docs.withColumn("bucket", bucket).join(heads, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")), "left")
    own = F.array(F.struct("bucket", F.lit(False).alias("guest")))
    places = F.when(F.col("guest_of").isNull(), own).otherwise(F.concat(own, F.array(F.struct(F.col("guest_of").alias("bucket"), F.lit(True).alias("guest")))))
    rows = dealt.select("doc_id", "h", "text", F.explode(places).alias("at")).select("doc_id", "h", "text", "at.bucket", "at.guest")
    ordered = rows.repartitionById(max(1, len(first)), F.col("bucket") % max(1, len(first))).sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), "text")
    return ordered.select("bucket", "guest", "doc_id", "text").mapInArrow(_pairs, f"doc_id long, {OUT}")
