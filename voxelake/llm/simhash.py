"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most four bits exactly if some value lies within two
bits of both.  So every distinct fingerprint stands for its ball of 2081 variants (itself,
64 one-bit and 2016 two-bit flips), fingerprints whose balls share a variant are linked,
and every link found this way is a true one.

The shuffle on variants sends no variants.  The 64 bits are dealt into k groups, and a
bucket is named by the k parities of a value's groups.  One flip changes one parity, so the
2081 variants of a fingerprint fall into no more than 1 + k + k(k-1)/2 of the 2**k buckets,
and the XOR of two bucket names tells which flips lead from one to the other.  A
fingerprint is sent once to each of these buckets, which makes its own share of the
variants, sorts them, and returns a spanning forest of the collisions rather than their
pairs.  k grows with the logarithm of the number of fingerprints, so a bucket's share stays
small (about a million fingerprints for 10**11 of them) while the rows sent for a fingerprint
grow with k squared only: 37 at k = 8, 79 at k = 12, 326 at k = 25.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import connected_components
from .common import ascii_lower, slices, spaced_words, staged, texts

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Fingerprints for each bucket: there are ``2**k`` buckets for up to ``2**k`` times as many.
BUCKET_FINGERPRINTS = 4096
LEAST_BITS, MOST_BITS = 8, 32
#: Bytes that a task of the bucket shuffle should read.
TASK_BYTES = 32 << 20
#: Variants that a bucket holds and sorts at a time.
VARIANTS_AT_A_TIME = 1 << 22


def fingerprint(text: str, n: int = SHINGLE_WORDS) -> int:
    """SimHash of the lower-cased text's ``n``-word shingles, as an unsigned 64-bit number."""
    words = spaced_words(ascii_lower(text))
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"), SEED)
    data = " ".join(words).encode("utf-8", "surrogatepass")
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate(([0], ends + 1))[: len(words) - n + 1].tolist()
    stops = np.concatenate((ends, [len(data)]))[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        fps = np.array([fingerprint(t) for t in texts(b)], np.uint64).view(np.int64)
        rest = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(fps)], names=[*rest, "fp"])


def fingerprints(documents: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, ``columns`` by name, ``fp`` (the 64 bits as a signed long) of every row; null
    text as empty, fp 0."""
    rest = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in (columns or {}).items()], F.col("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema if f.name != "text")
    return rest.mapInArrow(_fingerprints, f"{kinds}, fp long")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@lru_cache(8)
def _flips(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 2081 flips, and the linear hash of each of the 64 bits and of each flip: its low
    ``bits`` are the parities that name buckets, the others are mixed."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    a, b = np.triu_indices(64, 1)
    flips = np.concatenate(([np.uint64(0)], one, one[a] | one[b]))
    parity = np.array([1 << (i * bits // 64) for i in range(64)], np.uint64)
    mixed = np.array([xxhash.xxh64_intdigest(f"bit {i}", 7) for i in range(64)], np.uint64) >> np.uint64(bits)
    column = parity | (mixed << np.uint64(bits))
    return flips, column, np.concatenate(([np.uint64(0)], column, column[a] ^ column[b]))


@lru_cache(8)
def _steps(bits: int) -> np.ndarray:
    """The XORs that lead from a fingerprint's own bucket to those of its variants."""
    return np.unique(_flips(bits)[2] & np.uint64((1 << bits) - 1))


def _hashes(values: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The linear hash of each value, by a table for each byte."""
    out = np.zeros(len(values), np.uint64)
    for byte in range(8):
        table = np.zeros(256, np.uint64)
        for i in range(8):
            table[1 << i : 2 << i] = table[: 1 << i] ^ column[8 * byte + i]
        out ^= table[((values >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)]
    return out


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' component, by pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        if np.array_equal(before, root):
            return root


def collisions(fps: np.ndarray, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct ``fps`` that share a variant of this bucket, as a spanning forest.

    The variants are made and sorted in portions by further bits of a second hash, so memory
    stays at VARIANTS_AT_A_TIME however many fingerprints there are.
    """
    fps = np.unique(fps)
    flips, column, flip_hash = _flips(bits)
    portions = max(1, -(-len(fps) * len(flips) // (VARIANTS_AT_A_TIME * len(_steps(bits)))))
    more = (portions - 1).bit_length()
    fp_hash = _hashes(fps, column)
    order = np.argsort(fp_hash & np.uint64((1 << (bits + more)) - 1), kind="stable")
    fps, fp_hash = fps[order], fp_hash[order]
    links = []
    for portion in range(1 << more):
        mask = np.uint64((1 << (bits + more)) - 1)
        goal = np.uint64(bucket | (portion << bits))
        kinds, first = np.unique(fp_hash & mask, return_index=True)
        last = np.append(first[1:], len(fps))
        flip_kind = flip_hash & mask
        by_kind = np.argsort(flip_kind, kind="stable")
        at, to = (np.searchsorted(flip_kind[by_kind], kinds ^ goal, side) for side in ("left", "right"))
        value, owner = [], []
        for a, b, i, j in zip(first, last, at, to):
            if i < j:
                value.append((fps[a:b, None] ^ flips[by_kind[i:j]][None, :]).ravel())
                owner.append(np.repeat(np.arange(a, b), j - i))
        if not value:
            continue
        value, owner = np.concatenate(value), np.concatenate(owner)
        ranked = np.sort(value)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if not len(twice):
            continue
        place = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
        hit = twice[place] == value
        value, owner = value[hit], owner[hit]
        sort = np.lexsort((owner, value))
        value, owner = value[sort], owner[sort]
        same = value[1:] == value[:-1]
        same &= np.bitwise_count(fps[owner[1:]] ^ fps[owner[:-1]]) <= RADIUS
        links.append((owner[:-1][same], owner[1:][same]))
    if not links:
        return fps[:0], fps[:0]
    left, right = (np.concatenate(x) for x in zip(*links))
    nodes, both = np.unique(np.concatenate((left, right)), return_inverse=True)
    root = _roots(len(nodes), both[: len(left)], both[len(left) :])
    apart = root != np.arange(len(nodes))
    return fps[nodes[apart]], fps[nodes[root[apart]]]


def _deal(bits: int):
    """Each fingerprint to the buckets of its variants; those of a batch that meet in a bucket
    travel as one row."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, column, _ = _flips(bits)
        steps, mask = _steps(bits), np.uint64((1 << bits) - 1)
        for b in slices(batches, 8192):
            fps = b.column("fp").to_numpy().view(np.uint64)
            bucket = ((_hashes(fps, column) & mask)[:, None] ^ steps[None, :]).ravel().view(np.int64)
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            offsets = pa.array(np.append(first, len(order)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(offsets, pa.array(fps.view(np.int64)[order // len(steps)]))], names=["bucket", "fps"])

    return deal


def _bucket_links(bits: int):
    """Rows sorted by bucket: only the fingerprints of one bucket are held."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            u, v = collisions(np.concatenate(held), bucket, bits)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            for name, fps in zip(b.column("bucket").to_numpy().tolist(), b.column("fps")):
                if name != bucket and held:
                    yield from settle()
                    held = []
                bucket = name
                held.append(fps.values.to_numpy().view(np.uint64))
        if held:
            yield from settle()

    return links


def bucket_bits(n: int) -> int:
    """k for ``n`` distinct fingerprints."""
    return min(MOST_BITS, max(LEAST_BITS, (max(n - 1, 0) // BUCKET_FINGERPRINTS).bit_length()))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Edges ``u``, ``v`` whose closure links all fingerprints at RADIUS or fewer differing bits.

    ``distinct`` has one row per fingerprint, column ``fp``.  A spanning forest is returned
    for each bucket, so a group of ``g`` near copies costs at most ``g`` rows a bucket.  No
    bucket is hot by copies, as fingerprints are distinct and a ball holds 2081 values.
    """
    spark, n = distinct.sparkSession, distinct.count()
    bits = bucket_bits(n)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * n * len(_steps(bits)) // TASK_BYTES)
    tasks = min(tasks, 1 << bits)
    dealt = distinct.mapInArrow(_deal(bits), "bucket long, fps array<long>")
    ordered = dealt.repartitionById(tasks, (F.col("bucket") % tasks).cast("int")).sortWithinPartitions("bucket")
    return ordered.mapInArrow(_bucket_links(bits), "u long, v long").distinct()


def near_duplicates(documents: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, ``columns`` by name, ``fp``, ``root``, ``component_id`` for every row of ``documents``.

    root is the smallest fingerprint of the row's component, and tells components apart
    whatever their ids; component_id is the smallest doc_id reachable over links of RADIUS or fewer differing
    bits.  Null and empty texts have fingerprint 0 and link like any other; repeated rows
    are kept; rows with a null doc_id are kept, take part in links, and lend their component
    no id (a component of such rows only has a null id).  Other columns are ignored.  An
    empty table gives an empty result.
    """
    fps = staged(fingerprints(documents, columns))
    lowest = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    distinct = staged(lowest)
    comps = connected_components(fingerprint_links(distinct.select("fp")))
    grouped = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = grouped.join(ids, "root").select("fp", "root", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", *(columns or {}), "fp", "root", "component_id")
