"""Spelling variants: words one edit apart, found through the halves of the words.

A word and another one edit away from it share the word's first half at the start or its
second half at the end (pigeonhole).  Every word therefore puts its two halves into an
Aho-Corasick automaton, all words are scanned, and a hit counts if the half stands at the
start (or the end) and the lengths differ by one at most; the edit is then verified on the
whole words.

The automaton is dealt out in shards by the halves' hash, and a word goes only to the shards
that can hold a half of a word within one edit of it: at most four, as such a word is as
long, one shorter or one longer.  Halves that very many words share ("ation") are halved
again, inside a shard and, beyond ``crowd`` words, before the shuffle: the rest of the word
behind a shared half is a shorter word with the same rule.  So neither a shard nor the
number of candidates grows with the square of a common ending.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, slices, staged, texts

# Fixed values of the query contract.
runs = re.compile("[A-Za-zÀ-ÿ]+").findall
CHANGED = 31
SHORTEST = 7
LEAST = 2
TIMES = 10
#: Words of one half beyond which it is halved again before the shuffle, and rows of a shard.
CROWD = 20_000
SHARD_ROWS = 250_000
#: Candidate pairs of one half that are verified at once; more are halved again in the shard.
PAIRS = 2048
#: Code points compared as arrays; longer words are compared as texts.
WIDTH = 48
#: Distinct words that a task holds before it hands its counts on.
HELD = 200_000


def altered(run: str, key: int) -> str:
    """The run, less one code point if ``key`` (the crc32 of the document's id and the run) says so."""
    if key % CHANGED:
        return run
    at = key % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for batch in slices(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(runs(ascii_lower(text))).items():
                if len(run) >= SHORTEST:
                    word = altered(run, zlib.crc32(run.encode(), start))
                    if len(word) >= SHORTEST:
                        total[word] += n
            if len(total) >= HELD:
                yield flush()
    yield flush()


def words(documents: DataFrame) -> DataFrame:
    """``word``, ``n`` for the words of at least SHORTEST code points and LEAST occurrences."""
    counted = documents.select("doc_id", "text").mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _split(rows: DataFrame) -> DataFrame:
    """For each row the halves under which it can meet a word one edit away.

    A row's view is code points ``lo`` to ``hi`` of its word.  ``key`` names the half after all
    halves before it (``parent``), ``cut`` its length (below zero: at the end), ``own``: it is
    the row's own half."""
    view = F.expr("substring(word, lo + 1, hi - lo)")
    size = F.col("hi") - F.col("lo")
    half = F.floor(size / 2).cast("int")

    def piece(kind: str, length: Column, mine: Column) -> Column:
        text = F.substring("view", F.lit(1), length) if kind == "P" else F.substring("view", size - length + 1, length)
        return F.struct(
            F.concat("key", F.lit(kind), text, F.lit(" ")).alias("key"),
            (length if kind == "P" else -length).cast("int").alias("cut"),
            (F.col("own") & (length == mine)).alias("own"),
        )

    first = [piece("P", F.floor((size + d) / 2).cast("int"), half) for d in (-1, 1)]
    last = [piece("S", (half + d).cast("int"), size - half) for d in (0, 1)]
    parts = rows.withColumn("view", view).select("word", "n", "lo", "hi", F.col("key").alias("parent"), F.explode(F.array(*first, *last)).alias("part"))
    return parts.select("word", "n", "lo", "hi", "parent", "part.*").where("cut <> 0 and abs(cut) <= hi - lo")


def _rest(rows: DataFrame) -> DataFrame:
    """The rows' views without the half that ``cut`` names."""
    return rows.select("word", "n", F.expr("if(cut > 0, lo + cut, lo)").alias("lo"), F.expr("if(cut < 0, hi + cut, hi)").alias("hi"), "key", "own")


class Shard:
    """Rows of one shard, searched by automata of halves."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        packed = np.zeros((len(words), WIDTH), np.uint8)
        back = np.zeros_like(packed)
        for i, w in enumerate(words):
            if len(w) <= WIDTH:
                packed[i, : len(w)] = np.frombuffer(w.encode("latin-1"), np.uint8)
                back[i, : len(w)] = packed[i, : len(w)][::-1]
        self.packed, self.back = packed, back
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.scan: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.end: list[np.ndarray] = []
        self.waiting = 0

    def candidates(self, scan: list[int], owner: list[int], hi: list[int]) -> None:
        """All of ``scan`` may be near all of ``owner``, whose views end at ``hi``."""
        a, b = len(scan), len(owner)
        self.scan.append(np.repeat(np.array(scan, np.int64), b))
        self.owner.append(np.tile(np.array(owner, np.int64), a))
        self.end.append(np.tile(np.array(hi, np.int64), a))
        self.waiting += a * b
        if self.waiting > 200_000:
            self.verify()

    def verify(self) -> None:
        """Keep candidates of exactly one edit.  A pair that shares both halves would be met
        twice; under a half at the end it counts only if the words differ before the end of
        the owner's view."""
        if not self.waiting:
            return
        a, b, hi = np.concatenate(self.scan), np.concatenate(self.owner), np.concatenate(self.end)
        self.scan, self.owner, self.end, self.waiting = [], [], [], 0
        la, lb = self.size[a], self.size[b]
        near = (np.abs(la - lb) <= 1) & (a != b)
        short = near & (la <= WIDTH) & (lb <= WIDTH)
        prefix = np.zeros(len(a), np.int64)
        good = np.zeros(len(a), bool)
        at = np.flatnonzero(short)
        for part in np.array_split(at, len(at) // 50_000 + 1):
            i, j = a[part], b[part]
            start = _shared(self.packed, i, j)
            same = start + _shared(self.back, i, j)
            prefix[part] = start
            good[part] = same >= np.where(la[part] == lb[part], la[part] - 1, np.minimum(la[part], lb[part]))
        for k in np.flatnonzero(near & ~short):
            good[k], prefix[k] = one_edit(self.words[a[k]], self.words[b[k]])
        good &= (hi == lb) | (prefix < hi)
        self.found.append((a[good], b[good]))

    def search(self, scan: list[tuple[int, int, int, int]], owner: list[tuple[int, int, int, int]]) -> None:
        """Rows are (row, lo, hi, cut): with a cut, only hits on halves of that cut count; a cut
        of 0 stands for any.  ``owner`` rows put the half of their cut, or both, into the automaton."""
        trie = ahocorasick.Automaton()
        groups: list[tuple[int, int, list]] = []
        number: dict[tuple[str, int, int], int] = {}
        for row, lo, hi, cut in owner:
            n = hi - lo
            for c in (cut,) if cut else (n // 2, n // 2 - n):
                if not c:
                    continue
                seg = self.words[row][lo : lo + c] if c > 0 else self.words[row][hi + c : hi]
                known = number.get((seg, c, n))
                if known is None:
                    known = number[seg, c, n] = len(groups)
                    groups.append((c, n, []))
                    if seg not in trie:
                        trie.add_word(seg, [])
                    trie.get(seg).append(known)
                groups[known][2].append((row, lo, hi))
        if not groups:
            return
        trie.make_automaton()
        hits: dict[int, list] = {}
        for row, lo, hi, cut in scan:
            n = hi - lo
            for end, known in trie.iter(self.words[row][lo:hi]):
                for g in known:
                    c, size, _ = groups[g]
                    if -1 <= size - n <= 1 and (end + 1 == c or (c < 0 and end + 1 == n)) and cut in (0, c):
                        hits.setdefault(g, []).append((row, lo, hi))
        for g, scans in hits.items():
            c, n, owners = groups[g]
            cut = lambda rows: [(r, lo + max(c, 0), hi + min(c, 0), 0) for r, lo, hi in rows]  # noqa: B023, E731
            if len(scans) * len(owners) <= PAIRS or n - abs(c) < 2:
                self.candidates([r for r, _, _ in scans], [r for r, _, _ in owners], [hi + min(c, 0) for _, _, hi in owners])
            else:
                self.search(cut(scans), cut(owners))


def _shared(packed: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common start of rows ``i`` and ``j``, which differ."""
    return (packed[i] != packed[j]).argmax(1) if len(i) else np.zeros(0, np.int64)


def one_edit(a: str, b: str) -> tuple[bool, int]:
    """Do the texts differ by exactly one edit, and the length of their common start."""
    most = min(len(a), len(b))
    start = next((k for k in range(most) if a[k] != b[k]), most)
    if len(a) == len(b):
        return start < most and a[start + 1 :] == b[start + 1 :], start
    if abs(len(a) - len(b)) > 1:
        return False, start
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[start + 1 :] == short[start:], start


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = list(batches)
    if not sum(b.num_rows for b in read):
        return
    rows = pa.Table.from_batches(read)
    words, n, own = rows.column("word").to_pylist(), rows.column("n").to_numpy(), rows.column("own").to_pylist()
    part = list(zip(range(len(words)), rows.column("lo").to_pylist(), rows.column("hi").to_pylist(), rows.column("cut").to_pylist()))
    groups: dict[str, list[int]] = {}
    for i, parent in enumerate(rows.column("parent").to_pylist()):
        groups.setdefault(parent, []).append(i)
    shard = Shard(words)
    for members in groups.values():
        shard.search([part[i] for i in members], [part[i] for i in members if own[i]])
    shard.verify()
    near: dict[str, list] = {}
    for a, b in shard.found:
        for i, j in zip(a.tolist(), b.tolist()):
            best = near.setdefault(words[i], [0, 0, ""])
            best[0] += 1
            if n[j] > best[1] or (n[j] == best[1] and words[j] < best[2]):
                best[1], best[2] = int(n[j]), words[j]
    counts, most, form = zip(*near.values()) if near else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(list(near), pa.string()), pa.array(counts, pa.int64()), pa.array(most, pa.int64()), pa.array(form, pa.string())], names=["word", "n_near", "most", "form"])


def near_words(vocabulary: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``word``, ``n_near``, ``most``, ``form`` of the words with a word one edit away: how many,
    the largest count among them, and the smallest of those that have it.

    ``vocabulary`` has distinct words of two or more code points, all below U+0100, and their
    counts ``n``.  Halves with more than ``crowd`` words are halved again until the owners'
    rests are single code points."""
    rows = vocabulary.select("word", "n", F.lit(0).alias("lo"), F.length("word").alias("hi"), F.lit("").alias("key"), F.lit(True).alias("own"))
    ready = []
    while rows is not None:
        parts = _split(rows)
        rest = F.min(F.expr("if(own, hi - lo - abs(cut), null)"))
        full = staged(parts.groupBy("key").agg(F.count(F.lit(1)).alias("size"), rest.alias("rest")).where((F.col("size") > crowd) & (F.col("rest") > 1)).select("key"))
        if full.isEmpty():
            ready.append(parts)
            rows = None
        else:
            ready.append(parts.join(full, "key", "left_anti"))
            rows = staged(_rest(parts.join(full, "key", "left_semi")))
    shards = max(int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(4 * vocabulary.count() / SHARD_ROWS))
    dealt = reduce(DataFrame.unionByName, ready).repartition(shards, "key").drop("key")
    found = dealt.mapInArrow(_near, "word string, n_near long, most long, form string")
    best = F.min(F.struct((-F.col("most")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("most"), "best.form")


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """``word``, ``root`` from ``word``, ``form``: the last form reached in at most ``hops`` steps,
    by pointer doubling."""
    now = forms.select("word", F.col("form").alias("root"))
    done = 1
    while done < hops:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = staged(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        done *= 2
    return now


def group_spellings(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of every word of ``documents``.

    Null and empty texts have no words, a null id counts as the empty text, repeated rows count
    as often as they stand there.  Words without a near word have n_near 0, no form, and are
    their own root.  Ties of the largest count go to the smallest word in code-point order.
    An empty table gives no rows; other columns are not read.
    """
    vocabulary = staged(words(documents))
    near = near_words(vocabulary, crowd)
    joined = vocabulary.join(near, "word", "left")
    chosen = F.col("most") >= TIMES * F.col("n")
    forms = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("form")).alias("form"), F.when(chosen, F.col("most")).alias("form_n")))
    most = forms.agg(F.max("form_n")).first()[0]
    ends = roots(forms.where("form is not null"), int(math.log10(most / LEAST)) + 1 if most else 0)
    return forms.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def digest(grouped: DataFrame) -> DataFrame:
    return grouped.select("word", "form", "root", "n", "n_near", "form_n")
