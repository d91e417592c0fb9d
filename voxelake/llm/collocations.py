"""Phrase collocations: phrases of two to five words by the lowest score of their cuts.

A phrase can only be frequent if its words and its pairs are (Apriori), so the corpus is read
in ever narrower passes:

1. words are counted by language, and those of ``least`` occurrences kept;
2. the texts are written once as blocks of word hashes, with a break wherever a phrase cannot
   go on (the end of a piece, a rare word);
3. two screens count hashed pairs, then longer phrases of screened pairs.  Counts of hashes
   are never too low, so no frequent phrase is lost;
4. what passes both screens is the candidates.  Shards of them get a minimal perfect hash
   whose slots store the candidates' words.  Tasks look every phrase up, verify its words
   against the slot's, count slots in arrays, and the arrays are summed as a tree;
5. parts of a phrase are found by their slots too, and their counts read there.

What is broadcast has a fixed size: bit tables of the screens (2 MB each) and at most
SHARDS_AT_ONCE shards of SHARD candidates; more shards take further passes over the blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, slices, staged

# Fixed values of the query contract.
BREAKS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 5
LEAST = 100
REPORT = 2000
NO_LANG = "und"
#: Bits of a screen's table, tokens of a block, distinct words or phrases that a task holds.
SCREEN_BITS = 24
BLOCK = 1 << 18
HELD = 400_000
TALLY = 1 << 22
#: Hashed phrases of one group of a screen, candidates of a shard, shards of a pass, slots of a summed array.
SCREEN_ROWS = 1_000_000
SHARD = 1_000_000
SHARDS_AT_ONCE = 2
CHUNK = 1 << 16
#: Lower case, and every break as a full stop.  All of these are ASCII, so UTF-8 needs no decoding.
_FOLD = bytes.maketrans(BREAKS + ASCII_UPPER.encode(), b"." * len(BREAKS) + ASCII_LOWER.encode())
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, lower-cased, with a full stop for each break between pieces."""
    return text.translate(_FOLD).replace(b".", b" . ").split()


def word_key(lang: str, word: bytes | None, seed: int) -> int:
    """A 64-bit key of a word of a language (None: of the language), never 0."""
    text = f"{len(lang)}:{lang}".encode()
    return xxhash.xxh3_64_intdigest(text if word is None else text + b"=" + word, seed) or 1


def joined(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of phrases from the keys of all but their last word, and of that."""
    z = (h * _M1 + w) * _M2
    z ^= z >> np.uint64(32)
    z *= _M1
    return z ^ (z >> np.uint64(29))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _chunks(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes that end before a space or break."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end] not in b" \t" + BREAKS:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _count_words(seed: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in total.items():
                words.pop(b".", None)
                names = [*words, None]
                keys = np.array([word_key(lang, w, seed) for w in names], np.uint64)
                yield pa.RecordBatch.from_arrays([_long(keys), pa.array([lang] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array([*words.values(), sum(words.values())], pa.int64())], names=["key", "lang", "word", "n"])
            total.clear()

        for b in slices(batches, 128):
            for lang, text in zip(b.column("lang").to_pylist(), _texts(b)):
                words = total.setdefault(NO_LANG if lang is None else lang, Counter())
                for part in _chunks(text):
                    words.update(tokens(part))
            if sum(map(len, total.values())) >= HELD:
                yield from flush()
        yield from flush()

    return count


def frequent_words(documents: DataFrame, least: int, seed: int) -> DataFrame:
    """``key``, ``lang``, ``word``, ``f``, ``clash`` of words of ``least`` occurrences, and for each
    language a row without a word whose ``f`` is the number of its words.  ``clash``: another
    word has this key."""
    rows = documents.select("lang", "text").mapInArrow(_count_words(seed), "key long, lang string, word string, n long")
    name = F.struct("lang", "word")
    found = rows.groupBy("key").agg(F.sum("n").alias("f"), F.min(name).alias("a"), F.max(name).alias("b"))
    clash = ~F.col("a").eqNullSafe(F.col("b"))
    return found.where((F.col("f") >= least) | F.col("a.word").isNull()).select("key", "a.lang", "a.word", "f", clash.alias("clash"))


def _table(rows: DataFrame, column: str) -> np.ndarray:
    """A bit table of the low bits of a column: at most 2^SCREEN_BITS numbers reach the driver."""
    low = rows.select(F.expr(f"cast({column} & {(1 << SCREEN_BITS) - 1} as int)").alias("at")).distinct().toArrow()
    flags = np.zeros(1 << SCREEN_BITS, bool)
    flags[low.column("at").to_numpy()] = True
    return np.packbits(flags, bitorder="little")


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64((1 << SCREEN_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class _Codes(dict):
    """Numbers of tokens in order of first sight; a break is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def _encode(bits, seed: int):
    """Texts as blocks: the keys of the block's frequent words, and for each token the number of
    its key, 0 for breaks; runs of breaks are one break."""

    def block(lang: str, codes: _Codes, parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.array([0, *(word_key(lang, w, seed) for w, n in codes.items() if n)], np.uint64)
        keys[1:][~_passes(bits.value, keys[1:])] = 0
        known = np.flatnonzero(keys)
        number = np.zeros(len(keys), np.uint32)
        number[known] = np.arange(1, len(known) + 1)
        at = number[np.concatenate(parts)]
        at = at[(at != 0) | (np.concatenate(([1], at[:-1])) != 0)]
        narrow = len(known) < 1 << 16
        return pa.RecordBatch.from_arrays([pa.array([keys[known].tobytes()]), pa.array([(at.astype(np.uint16) if narrow else at).tobytes()]), pa.array([narrow])], names=["keys", "at", "narrow"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Codes, list]] = {}
        size: Counter = Counter()
        end = np.zeros(1, np.int64)
        for b in slices(batches, 128):
            for lang, text in zip(b.column("lang").to_pylist(), _texts(b)):
                lang = NO_LANG if lang is None else lang
                codes, parts = held.setdefault(lang, (_Codes(), []))
                for part in _chunks(text):
                    found = tokens(part)
                    parts.append(np.fromiter(map(codes.__getitem__, found), np.int64, len(found)))
                    size[lang] += len(found)
                parts.append(end)
                if size[lang] >= BLOCK:
                    yield block(lang, codes, parts)
                    del held[lang], size[lang]
        for lang, (codes, parts) in held.items():
            yield block(lang, codes, parts)

    return encode


def _keys(row: dict) -> np.ndarray:
    """The key of each token of a block, 0 for breaks."""
    keys = np.concatenate((np.zeros(1, np.uint64), np.frombuffer(row["keys"], np.uint64)))
    return keys[np.frombuffer(row["at"], np.uint16 if row["narrow"] else np.uint32)]


def _phrases(w: np.ndarray, pairs: np.ndarray | None, longer: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length from 2: the places where a phrase of it stands, and its keys.  A phrase
    stands where its first and its last words but one stand as a phrase, and where it passes
    the screen of its length that is given; without ``pairs`` only pairs come."""
    at = np.flatnonzero(w)
    h = w[at]
    for k in range(2, LONGEST + 1):
        stands = np.zeros(len(w) + 1, bool)
        stands[at] = True
        go = (at + k <= len(w)) & stands[at + 1]
        at, h = at[go], h[go]
        h = joined(h, w[at + k - 1])
        bits = pairs if k == 2 else longer
        if bits is not None:
            go = _passes(bits, h)
            at, h = at[go], h[go]
        yield k, at, h
        if pairs is None:
            return


class Tally:
    """Counts of keys, combined whenever many are held."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.held += len(k)
        if self.held > TALLY:
            self.combine()

    def combine(self) -> None:
        k, j = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.keys]), return_inverse=True)
        c = np.zeros(len(k), np.int64)
        np.add.at(c, j, np.concatenate([np.zeros(0, np.int64), *self.counts]))
        self.keys, self.counts, self.held = [k], [c], len(k)

    def flush(self, groups: int) -> pa.RecordBatch:
        """Keys dealt to groups by their high half; the low half and the count of each."""
        self.combine()
        k, c = self.keys[0], self.counts[0]
        group = ((k >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
        low = np.split((k[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts[1:])
        counts = np.split(np.minimum(c[order], 0xFFFFFFFF).astype(np.uint32), cuts[1:])
        n = len(cuts)
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(group[order][cuts], pa.int32()), pa.array([x.tobytes() for x in low[:n]], pa.binary()), pa.array([x.tobytes() for x in counts[:n]], pa.binary())], names=["part", "low", "counts"])


def _tally(groups: int, pairs):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()
        for b in batches:
            for row in b.to_pylist():
                for k, _, h in _phrases(_keys(row), pairs.value if pairs else None, None):
                    if k > 2 or not pairs:
                        held.add(h)
                if held.held > TALLY // 2:
                    yield held.flush(groups)
        yield held.flush(groups)

    return tally


def _frequent(least: int):
    def frequent(table: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(low)
        low, counts = low[order], counts[order]
        starts = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
        total = np.add.reduceat(counts, starts) if len(starts) else counts
        return pa.table({"key": pa.array(low[starts][total >= least].astype(np.int64))})

    return frequent


def _screen(blocks: DataFrame, least: int, groups: int, pairs=None) -> np.ndarray:
    """A bit table of the phrases (pairs, or longer ones of the pairs in ``pairs``) whose hash
    has ``least`` occurrences."""
    dealt = blocks.mapInArrow(_tally(groups, pairs), "part int, low binary, counts binary")
    return _table(dealt.groupBy("part").applyInArrow(_frequent(least), "key long"), "key")


def _once(keys: list[np.ndarray], words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, first = np.unique(np.concatenate(keys), return_index=True)
    return k, np.concatenate(words)[first]


def _candidates(groups: int, pairs, longer):
    """The phrases that pass the screens, each once a task, packed for the groups they are dealt to."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words = [np.zeros(0, np.uint64)], [np.zeros((0, LONGEST), np.uint64)]
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            k, w = _once(keys, words)
            group = ((k >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
            rows = [order[i:j] for i, j in zip(cuts, [*cuts[1:], len(order)])]
            yield pa.RecordBatch.from_arrays([pa.array(group[order][cuts], pa.int32()), pa.array([k[r].tobytes() for r in rows], pa.binary()), pa.array([w[r].tobytes() for r in rows], pa.binary())], names=["part", "keys", "words"])

        for b in batches:
            for row in b.to_pylist():
                w = np.append(_keys(row), np.zeros(LONGEST, np.uint64))
                for k, at, h in _phrases(w, pairs.value, longer.value):
                    h, first = np.unique(h, return_index=True)
                    spelled = np.zeros((len(h), LONGEST), np.uint64)
                    spelled[:, :k] = w[at[first][:, None] + np.arange(k)]
                    keys.append(h)
                    words.append(spelled)
                    held += len(h)
            if held > TALLY // 4:
                keys, words = map(lambda x: [x], _once(keys, words))
                held = len(keys[0])
                if held > TALLY // 8:
                    yield from flush()
                    keys, words, held = [np.zeros(0, np.uint64)], [np.zeros((0, LONGEST), np.uint64)], 0
        yield from flush()

    return candidates


def _distinct(table: pa.Table) -> pa.Table:
    """A group's phrases once each; ``clash``: two phrases have one key."""
    k = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
    w = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]).reshape(-1, LONGEST)
    u, first, j = np.unique(k, return_index=True, return_inverse=True)
    differs = (w != w[first][j]).any(1)
    clash = np.zeros(len(u), bool)
    clash[j[differs]] = True
    return pa.table({"key": _long(u), "words": pa.array([x.tobytes() for x in w[first]], pa.binary()), "clash": pa.array(clash)})


class PerfectHash:
    """A minimal perfect hash of 64-bit keys: each level places the keys that meet no other one
    in a bit array; a key's slot is the number of bits set before its own."""

    def __init__(self, keys: np.ndarray, spread: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        base, rest = 0, keys
        while len(rest):
            size = max(64, int(spread * len(rest)) + 63 & ~63)
            at = self._place(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            rank = base + np.concatenate(([0], np.cumsum(np.bitwise_count(bits))))[:-1]
            self.levels.append((bits, rank.astype(np.int64)))
            base += int(alone.sum())
            rest = rest[~alone[at]]
            if len(self.levels) > 200:
                raise ValueError("keys are not distinct")
        self.n = base

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (joined(keys, np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys that are not of the set any slot or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(keys[left], level, 64 * len(bits))
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = rank[at[hit] >> 6] + below[hit]
            left = left[~hit]
        return out


class Shard:
    """A perfect hash of candidates with the words of each slot."""

    def __init__(self, number: int, shards: int, keys: np.ndarray, words: np.ndarray):
        self.number, self.shards, self.hash = number, shards, PerfectHash(keys)
        self.words = np.zeros((self.hash.n, LONGEST), np.uint64)
        self.words[self.hash.slots(keys)] = words

    def find(self, keys: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the phrases are candidates of this shard, and their slots: the stored words
        must be the phrase's, and no more."""
        mine = np.flatnonzero(keys.view(np.int64) % self.shards == self.number)
        slot = self.hash.slots(keys[mine])
        good = slot >= 0
        for k in range(LONGEST):
            good[good] = self.words[slot[good], k] == (words[k][mine[good]] if k < len(words) else 0)
        return mine[good], slot[good]


def padded(words: list[bytes]) -> np.ndarray:
    """The keys of phrases' words as rows of LONGEST, zeros behind the last."""
    return np.frombuffer(b"".join(words), np.uint64).reshape(-1, LONGEST)


def _one_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as phrases of one word."""
    for b in batches:
        words = np.zeros((b.num_rows, LONGEST), np.int64)
        words[:, 0] = b.column("key").to_numpy()
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(np.zeros(b.num_rows, bool))], names=["key", "words", "clash"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of phrases, one row each."""
    for b in batches:
        w = padded(b.column("words").to_pylist())
        row, p = np.nonzero(w)
        yield pa.RecordBatch.from_arrays([_long(b.column("key").to_numpy()[row]), pa.array(p.astype(np.int32)), _long(w[row, p])], names=["key", "p", "word_key"])


def _count_slots(shards, pairs, longer):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        totals = [np.zeros(s.hash.n, np.int64) for s in shards.value]
        for b in batches:
            for row in b.to_pylist():
                w = _keys(row)
                alone = np.flatnonzero(w)
                for k, at, h in [(1, alone, w[alone]), *_phrases(w, pairs.value, longer.value)]:
                    words = [w[at + i] for i in range(k)]
                    for s, total in zip(shards.value, totals):
                        total += np.bincount(s.find(h, words)[1], minlength=len(total))
        task = TaskContext.get().partitionId()
        for s, total in zip(shards.value, totals):
            for chunk in range(0, len(total), CHUNK):
                at = np.flatnonzero(total[chunk : chunk + CHUNK])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([s.number], pa.int32()), pa.array([chunk // CHUNK], pa.int32()), pa.array([task], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([total[chunk + at].tobytes()])], names=["shard", "chunk", "task", "at", "counts"])

    return count


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for at, counts in zip(table.column("at").to_pylist(), table.column("counts").to_pylist()):
        total[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.int64)
    at = np.flatnonzero(total)
    return pa.table({"shard": table.column("shard")[:1], "chunk": table.column("chunk")[:1], "task": table.column("task")[:1], "at": pa.array([at.astype(np.uint16).tobytes()]), "counts": pa.array([total[at].tobytes()])})


def _spread(least: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                counts = np.frombuffer(row["counts"], np.int64)
                slot = np.frombuffer(row["at"], np.uint16).astype(np.int64) + row["chunk"] * CHUNK
                keep = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), row["shard"], np.int32)), pa.array(slot[keep]), pa.array(counts[keep])], names=["shard", "slot", "f"])

    return spread


_SUMS = "shard int, chunk int, task int, at binary, counts binary"


def _counted(blocks: DataFrame, shards, pairs, longer, least: int) -> DataFrame:
    """``shard``, ``slot``, ``f`` of the candidates of ``least`` occurrences: the tasks' arrays are
    summed in two rounds, so that no group holds those of all tasks."""
    rows = blocks.mapInArrow(_count_slots(shards, pairs, longer), _SUMS)
    fan = F.expr("task % 32")
    half = rows.withColumn("task", fan).groupBy("shard", "chunk", "task").applyInArrow(_sum, _SUMS)
    return half.groupBy("shard", "chunk").applyInArrow(_sum, _SUMS).mapInArrow(_spread(least), "shard int, slot long, f long")


def _placed(shards):
    """Candidates of the pass's shards with their slots, and the places of their parts there."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = padded(b.column("words").to_pylist())
            size = (w != 0).sum(1)
            own = b.column("key").to_numpy().view(np.uint64)
            for i in range(LONGEST):
                for j in range(i + 1, LONGEST + 1):
                    rows = np.flatnonzero(size >= j)
                    whole = (i == 0) & (size[rows] == j)
                    edge = (i == 0) | (size[rows] == j)
                    rows = rows[whole | (edge if j - i == 1 else True)]
                    part = [w[rows, k] for k in range(i, j)]
                    h = part[0]
                    for x in part[1:]:
                        h = joined(h, x)
                    for s in shards.value:
                        at, slot = s.find(h, part)
                        n = len(at)
                        yield pa.RecordBatch.from_arrays([_long(own[rows[at]]), pa.array(size[rows[at]], pa.int32()), pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, j, np.int32)), pa.array(np.full(n, s.number, np.int32)), pa.array(slot)], names=["key", "size", "i", "j", "shard", "slot"])

    return placed


def collocations(documents: DataFrame, least: int = LEAST, report: int = REPORT, shard: int = SHARD) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's first
    ``report`` phrases.

    Null and empty texts have no words, a null language is ``und``, repeated rows count as often
    as they stand there; ties end at the phrase, which is unique in its language.  Empty tables
    and tables without frequent phrases give no rows; other columns are not read.
    """
    for seed in range(16):
        out = _with_seed(documents, least, report, shard, seed)
        if out is not None:
            return out
    raise ValueError("no seed keeps the keys of all words and phrases apart")


def _with_seed(documents: DataFrame, least: int, report: int, shard: int, seed: int) -> DataFrame | None:
    """The result, or None if two words or phrases have one key under this seed."""
    spark = documents.sparkSession
    send = spark.sparkContext.broadcast
    words = staged(frequent_words(documents, least, seed))
    clash, total = words.agg(F.max("clash"), F.sum(F.when(F.col("word").isNull(), F.col("f")))).first()
    if clash:
        return None
    known = words.where("word is not null")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // SCREEN_ROWS)
    blocks = staged(documents.select("lang", "text").mapInArrow(_encode(send(_table(known, "key")), seed), "keys binary, at binary, narrow boolean"))
    pairs = send(_screen(blocks, least, groups))
    longer = send(_screen(blocks, least, groups, pairs))
    found = blocks.mapInArrow(_candidates(groups, pairs, longer), "part int, keys binary, words binary").groupBy("part").applyInArrow(_distinct, "key long, words binary, clash boolean")
    singles = known.select("key").mapInArrow(_one_word, "key long, words binary, clash boolean")
    candidates = staged(found.unionByName(singles))
    clash, size = candidates.agg(F.max("clash"), F.count(F.lit(1))).first()
    if clash or candidates.groupBy("key").count().where("count > 1").limit(1).count():
        return None
    shards = max(1, -(-size // shard))
    candidates = candidates.select("key", "words", F.expr(f"cast(pmod(key, {shards}) as int)").alias("shard"))
    counts, places = [], []
    for first in range(0, shards, SHARDS_AT_ONCE):
        rows = candidates.where(F.col("shard").between(first, first + SHARDS_AT_ONCE - 1)).toArrow()
        mine, keys, spelled = rows.column("shard").to_numpy(), rows.column("key").to_numpy().view(np.uint64), padded(rows.column("words").to_pylist())
        sent = send([Shard(s, shards, keys[mine == s], spelled[mine == s]) for s in range(first, min(first + SHARDS_AT_ONCE, shards))])
        counts.append(staged(_counted(blocks, sent, pairs, longer, least)))
        places.append(staged(candidates.select("key", "words").mapInArrow(_placed(sent), "key long, size int, i int, j int, shard int, slot long")))
    f, inside = counts[0], places[0]
    for more, further in zip(counts[1:], places[1:]):
        f, inside = f.unionByName(more), inside.unionByName(further)
    return _ranked(inside.join(f, ["shard", "slot"]), candidates, known, words.where("word is null"), report)


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) without rounding, for counts up to 10^17."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    names = dict(zip("anlr", (wide(a, 17), wide(n, 17), wide(left, 19), wide(right, 19))))
    return F.call_function("div", F.expr("1000BD") * (names["a"] * names["n"]), names["l"] * names["r"])


def _ranked(parts: DataFrame, candidates: DataFrame, known: DataFrame, totals: DataFrame, report: int) -> DataFrame:
    """Parts of phrases with their counts, to the report.  ``parts``: the phrase's key and size,
    the part's first and last place, its slot and count."""
    parts = staged(parts)
    whole = parts.where("i = 0 and j = size and size > 1").select("key", "size", "shard", "slot", F.col("f").alias("a"))
    longest = parts.join(whole.select("key", "a"), "key").where("j - i > 1 and j - i < size").groupBy("shard", "slot").agg(F.max("a").alias("longer"))
    kept = whole.join(longest, ["shard", "slot"], "left").where("longer is null or longer < a").select("key", "a")
    cut = F.expr("if(i = 0, j, i)").alias("k")
    cuts = parts.where("j - i < size and (i = 0 or j = size)").groupBy("key", cut).agg(F.max(F.expr("if(i = 0, f, null)")).alias("l"), F.max(F.expr("if(i > 0, f, null)")).alias("r"))
    text = candidates.join(kept.select("key"), "key", "left_semi").select("key", "words").mapInArrow(_spelled, "key long, p int, word_key long")
    text = text.join(known.select(F.col("key").alias("word_key"), "lang", "word"), "word_key").groupBy("key").agg(F.min("lang").alias("lang"), F.expr("concat_ws(' ', transform(array_sort(collect_list(struct(p, word))), x -> x.word))").alias("phrase"))
    rows = kept.join(cuts, "key").join(text, "key").join(totals.select("lang", F.col("f").alias("n")), "lang")
    score = exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    best = rows.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= report).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = LEAST, report: int = REPORT) -> str:
    """DuckDB SQL of the report."""
    lower = f"translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}')"
    return f"""
    with pieces as (select coalesce(lang, '{NO_LANG}') lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) piece from documents),
    spoken as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from pieces),
    starts as (select lang, w, unnest(range(1, len(w) + 1)) i from spoken),
    placed as (select lang, w[i:i + k - 1] p from starts, range(1, {LONGEST + 1}) t(k) where i + k - 1 <= len(w)),
    f as (select lang, p, count(*) f from placed group by all having count(*) >= {least}),
    totals as (select lang, sum(len(w))::bigint n from spoken group by lang),
    parts as (select lang, p, f, i, j from f, range(0, {LONGEST}) s(i), range(1, {LONGEST + 1}) e(j) where i < j and j <= len(p) and j - i < len(p)),
    longest as (select lang, p[i + 1:j] q, max(f) longer from parts where j - i > 1 group by all),
    kept as (select f.* from f left join longest on f.lang = longest.lang and f.p = longest.q where len(f.p) > 1 and (longer is null or 100 * longer < 100 * f.f)),
    cuts as (select kept.lang, kept.p, kept.f a, k, l.f l, r.f r, n, (1000::hugeint * kept.f * n) // (l.f::hugeint * r.f) score
        from kept join range(1, {LONGEST}) c(k) on k < len(kept.p) join totals on totals.lang = kept.lang
        join f l on l.lang = kept.lang and l.p = kept.p[1:k] join f r on r.lang = kept.lang and r.p = kept.p[k + 1:]),
    best as (select lang, array_to_string(p, ' ') phrase, a, l, r, n, score::bigint score from cuts qualify row_number() over (partition by lang, p order by score, k) = 1)
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best qualify rank <= {report}"""
