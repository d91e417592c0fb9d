"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(token | text before) = P(class | history) * P(token | class).  The most frequent words are
classes of their own, other words share a class by their last two code points, and all words
seen once make one class with the unknown word, which has half of it: a word's only
occurrence is, without itself, an unknown word.

P(class | history) is a softmax over sums of weights, one for each feature and class.  The
features are the class alone, the word before (bigram), the word before that one (skip), and
both (trigram), hashed into ROWS rows.  A history word is one of the frequent words or the
class of its ending, so there are at most BUCKETS^2 histories; the counts of (history, class)
over all training texts are summed once, and every gradient (observed less expected counts)
comes from that table: its tasks sum their part, the sums meet by chunks of weights, and the
driver, which holds nothing but the fixed-size weights, takes a step.

The corpus passes as blocks: the distinct words of some hundred thousand tokens, and the
tokens as numbers of them.  Words are dealt by hash to groups, where each word's count over
all blocks is found, and what the model needs of each word goes back to the blocks.  No
vocabulary is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, slices, spaced_words, staged, texts

# Fixed values of the query contract.
FOLDS, TEST_FOLD = 5, 1
#: Classes: the end, rare and unknown words, single words, frequent and other endings.
CLASSES = 128
END, RARE, SINGLE, OWN_ENDINGS = 0, 1, 62, 40
#: Histories of one word (0: none), rows of hashed weights, hashed endings.
BUCKETS = 1024
ROWS = 1 << 13
ENDINGS = 1 << 12
#: Gradient steps, their size, and counts added to the scale of a step.
ROUNDS, RATE, DAMP = 6, 0.5, 4.0
#: Tokens of a block, code points of a part of a text, distinct words of a group.
BLOCK = 1 << 19
PART = 1 << 22
GROUP = 500_000
CELLS = 2_000_000
CHUNK = 1 << 13


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _words(b: bytes) -> list[str]:
    """The words of a packed list; no word holds a line end."""
    text = zstandard.decompress(b).decode()
    return text.split("\n") if text else []


def _pack_words(words: list[str]) -> bytes:
    return zstandard.compress("\n".join(words).encode(), 1)


def _parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about ``size`` code points that end before white space."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end] not in " \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


class _Codes(dict):
    """Numbers of words from 1 in order of first sight; 0 is the end of a text."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        return n


class _Block:
    def __init__(self):
        self.codes = _Codes()
        self.at: list[np.ndarray] = []
        self.pieces: list[tuple] = []
        self.lead = [0, 0]
        self.size = 0

    def add(self, row: int, doc_id, test: bool, words: list[str], last: bool) -> None:
        at = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if last:
            at = np.append(at, 0)
        if len(at):
            self.at.append(at)
            before = self.pieces.pop()[3] if self.pieces and self.pieces[-1][0] == row else 0
            self.pieces.append((row, doc_id, test, before + len(at)))
            self.size += len(at)

    def record(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        """The block's row: its words in order of their hash, how often each stands in training
        texts, its tokens as numbers of them, and the pieces of texts it holds."""
        words = list(self.codes)
        key = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
        order = np.argsort(key, kind="stable")
        place = np.zeros(len(words) + 1, np.uint32)
        place[order + 1] = np.arange(1, len(words) + 1)
        at = place[np.concatenate(self.at)]
        row, doc_id, test, size = zip(*self.pieces)
        learn = np.repeat(~np.array(test), size)
        n = np.bincount(at[learn], minlength=len(words) + 1)
        one = lambda x, t: pa.array([x], pa.list_(t))
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), one(row, pa.int64()), one(doc_id, kind), one(test, pa.bool_()), one(size, pa.int32()), one([int(place[c]) for c in self.lead], pa.int32()), pa.array([_pack(at)]), pa.array([_pack_words([words[i] for i in order])]), pa.array([_pack(n[1:].astype(np.int64))]), pa.array([int(n[0])])],
            names=["block", "row", "doc_id", "test", "size", "lead", "at", "words", "n", "ends"],
        )


def _blocks(kind: pa.DataType, block: int, part: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        held, row, number = _Block(), task, task
        for b in slices(batches, 128):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b)):
                test = doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == TEST_FOLD
                parts, tail = list(_parts(text, part)), []
                for i, t in enumerate(parts):
                    words = spaced_words(ascii_lower(t))
                    held.add(row, doc_id, test, words, i == len(parts) - 1)
                    tail = (tail + words)[-2:]
                    if held.size >= block:
                        yield held.record(number, kind)
                        number, held = number + 1, _Block()
                        if i < len(parts) - 1:
                            held.lead = [0] * (2 - len(tail)) + [held.codes[w] for w in tail]
                row += 1
        if held.pieces:
            yield held.record(number, kind)

    return blocks


def _deal(groups: int):
    """The words of each block, dealt by their hash."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, packed, n in zip(*(b.column(c).to_pylist() for c in ("block", "words", "n"))):
                words, n = _words(packed), _unpack(n, np.int64)
                if not words:
                    continue
                group = np.fromiter((zlib.crc32(w.encode()) * groups >> 32 for w in words), np.int64, len(words))
                cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
                ends = [*cuts[1:], len(words)]
                yield pa.RecordBatch.from_arrays([pa.array(group[cuts], pa.int32()), pa.array([block] * len(cuts)), pa.array([_pack_words(words[i:j]) for i, j in zip(cuts, ends)]), pa.array([_pack(n[i:j]) for i, j in zip(cuts, ends)])], names=["part", "block", "words", "n"])

    return deal


def ending(word: str) -> int:
    """The hash of a word's last two code points."""
    return zlib.crc32(word[-2:].encode()) % ENDINGS


def _total(table: pa.Table) -> pa.Table:
    """Counts of a group's words over all blocks: a row for each block with its words' counts;
    a row of the most frequent words (block -1); one of tokens, types, types seen once and the
    tokens of each ending seen more than once (block -2)."""
    total: dict[str, int] = {}
    rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "words", "n"))))
    for _, packed, n in rows:
        for w, c in zip(_words(packed), _unpack(n, np.int64).tolist()):
            total[w] = total.get(w, 0) + c
    out = [(block, packed, _pack(np.array([total[w] for w in _words(packed)], np.int64))) for block, packed, _ in rows]
    top = sorted(((-c, w) for w, c in total.items() if c > 1))[:BUCKETS]
    out.append((-1, _pack_words([w for _, w in top]), _pack(np.array([-c for c, _ in top], np.int64))))
    sums = np.zeros(3 + ENDINGS, np.int64)
    for w, c in total.items():
        sums[:3] += (c, c > 0, c == 1)
        if c > 1:
            sums[3 + ending(w)] += c
    out.append((-2, b"", _pack(sums)))
    block, words, n = zip(*out)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(out), pa.int32()), "block": pa.array(block, pa.int64()), "words": pa.array(words, pa.binary()), "n": pa.array(n, pa.binary())})


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for words, n in zip(b.column("words").to_pylist(), b.column("n").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(_words(words), pa.string()), pa.array(_unpack(n, np.int64))], names=["word", "n"])


class Vocabulary:
    """Classes and histories of words: sizes are fixed, whatever the corpus."""

    def __init__(self, top: list[tuple[str, int]], sums: np.ndarray, ends: int):
        self.tokens, self.types, self.once = int(sums[0]) + ends, int(sums[1]) + (ends > 0), int(sums[2])
        self.ends = ends
        mass = sums[3:].copy()
        for w, n in top[:SINGLE]:
            mass[ending(w)] -= n
        first = 2 + SINGLE
        rest = CLASSES - first - OWN_ENDINGS
        self.ending_class = first + OWN_ENDINGS + np.arange(ENDINGS) % rest
        own = np.lexsort((np.arange(ENDINGS), -mass))[:OWN_ENDINGS]
        self.ending_class[own] = first + np.arange(OWN_ENDINGS)
        self.size = np.zeros(CLASSES, np.int64)
        np.add.at(self.size, self.ending_class, mass)
        self.size[RARE], self.size[END] = self.once, ends
        self.own: dict[str, tuple[int, int]] = {}
        for i, (w, n) in enumerate(top[: BUCKETS - CLASSES - 1]):
            self.own[w] = (2 + i if i < SINGLE else int(self.ending_class[ending(w)]), 1 + i)
            if i < SINGLE:
                self.size[2 + i] = n

    def describe(self, words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word and the number it has as history."""
        kind, history = np.zeros(len(words), np.uint8), np.zeros(len(words), np.uint16)
        for i, w in enumerate(words):
            own = self.own.get(w)
            if own is None:
                c = int(self.ending_class[ending(w)])
                own = (c, BUCKETS - CLASSES + c)
            kind[i], history[i] = own
        kind[n < 2] = RARE
        return kind, history

    def within(self, kind: np.ndarray, n: np.ndarray) -> np.ndarray:
        """ln P(token | class)."""
        rare = np.where(n == 1, 0.5 / max(self.once, 1), 0.5 if self.once else 1.0)
        return np.log(np.where(kind == RARE, rare, np.maximum(n, 1) / np.maximum(self.size[kind], 1)))

    def base(self, n: np.ndarray) -> np.ndarray:
        """log10 of the smoothed share of a token among all."""
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def _described(vocabulary):
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for words, n in zip(b.column("words").to_pylist(), b.column("n").to_pylist()):
                n = _unpack(n, np.int64)
                kind, history = vocabulary.value.describe(_words(words), n)
                out.append((_pack(kind), _pack(history), _pack(n)))
            kind, history, n = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("block"), *(pa.array(x, pa.binary()) for x in (kind, history, n))], names=["part", "block", "kind", "history", "n"])

    return described


class Tokens:
    """Tokens of a coded block: class, count in training, and the two history words."""

    def __init__(self, row: dict, ends: int):
        parts = sorted(row["parts"] or [], key=lambda p: p["part"])
        both = lambda name, kind, first: np.concatenate((np.array([first], kind), *(_unpack(p[name], kind) for p in parts)))
        at = _unpack(row["at"], np.uint32)
        history, lead = both("history", np.uint16, 0).astype(np.int64), row["lead"]
        self.kind, self.n = both("kind", np.uint8, END)[at].astype(np.int64), both("n", np.int64, ends)[at]
        self.size = np.array(row["size"], np.int64)
        self.start = np.cumsum(self.size) - self.size
        h = history[at]
        self.one, self.two = np.concatenate(([0], h[:-1])), np.concatenate(([0, 0], h[:-2]))[: len(h)]
        self.one[self.start] = self.two[self.start] = 0
        self.two[(self.start + 1)[self.size > 1]] = 0
        self.one[0], self.two[0] = history[lead[1]], history[lead[0]]
        if self.size[0] > 1:
            self.two[1] = history[lead[1]]
        self.test = np.array(row["test"], bool)

    @property
    def context(self) -> np.ndarray:
        return self.one * BUCKETS + self.two


def _cells(parts: int):
    """Counts of (history, class) of the training tokens, dealt by history."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            k, c = _summed(keys, counts)
            part = (k // CLASSES * 2654435761 >> 8) % parts
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            rows = [order[i:j] for i, j in zip(cuts, [*cuts[1:], len(order)])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(part[order][cuts], pa.int32()), pa.array([_pack(k[r].astype(np.uint32)) for r in rows]), pa.array([_pack(c[r]) for r in rows])], names=["part", "cell", "n"])

        for b in batches:
            for row in b.to_pylist():
                t = Tokens(row, 0)
                learn = np.repeat(~t.test, t.size)
                k, c = np.unique((t.context * CLASSES + t.kind)[learn], return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > CELLS:
                    k, c = _summed(keys, counts)
                    keys, counts, held = [k], [c], len(k)
                    if held > CELLS:
                        yield from flush()
                        keys, counts, held = [], [], 0
        yield from flush()

    return cells


def _summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, j = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    return k, np.bincount(j, np.concatenate([np.zeros(0), *counts]), len(k)).astype(np.int64)


def _merge(table: pa.Table) -> pa.Table:
    k, c = _summed([_unpack(x, np.uint32).astype(np.int64) for x in table.column("cell").to_pylist()], [_unpack(x, np.int64) for x in table.column("n").to_pylist()])
    return pa.table({"cell": pa.array([_pack(k.astype(np.uint32))]), "n": pa.array([_pack(c)])})


def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The rows of weights of histories: bigram, skip and trigram; the last row is the class alone."""
    pair = (one * 40503 + two * 30011 + 17) * 2654435761
    return np.stack([one * 2654435761 + 11, two * 2246822519 + 5, pair], 1) >> 7 & ROWS - 1


def logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return weights[ROWS] + weights[rows].sum(1)


def normaliser(z: np.ndarray) -> np.ndarray:
    """ln of the sum of exponentials of each row."""
    top = z.max(1)
    return top + np.log(np.exp(z - top[:, None]).sum(1))


def add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each row of ``values`` to a row of ``total``."""
    order = np.argsort(rows, kind="stable")
    starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
    if len(starts):
        total[rows[order][starts]] += np.add.reduceat(values[order], starts, axis=0)


def sums(cell: np.ndarray, n: np.ndarray, weights: np.ndarray | None, total: np.ndarray) -> float:
    """Add the counts of every feature and class to ``total``: observed ones without ``weights``,
    else those the model expects for the same histories.  Returns the model's log-likelihood."""
    context, kind, found = cell // CLASSES, cell % CLASSES, 0.0
    starts = np.flatnonzero(np.diff(context, prepend=-1))
    number = np.repeat(np.arange(len(starts)), np.diff([*starts, len(cell)]))
    rows = features(context[starts] // BUCKETS, context[starts] % BUCKETS)
    if weights is None:
        for f in range(rows.shape[1]):
            total[:ROWS] += np.bincount(rows[number, f] * CLASSES + kind, n, ROWS * CLASSES).reshape(ROWS, CLASSES)
        total[ROWS] += np.bincount(kind, n, CLASSES)
        return found
    for a in range(0, len(starts), 4096):
        r = rows[a : a + 4096]
        z = logits(weights, r)
        z -= normaliser(z)[:, None]
        mine = slice(starts[a], starts[a + 4096] if a + 4096 < len(starts) else len(cell))
        found += float((n[mine] * z[number[mine] - a, kind[mine]]).sum())
        expected = np.exp(z) * np.bincount(number[mine] - a, n[mine], len(r))[:, None]
        for f in range(rows.shape[1]):
            add_rows(total, r[:, f], expected)
        total[ROWS] += expected.sum(0)
    return found


def _gradient(weights):
    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = np.zeros((ROWS + 1, CLASSES)), 0.0
        for b in batches:
            for cell, n in zip(b.column("cell").to_pylist(), b.column("n").to_pylist()):
                found += sums(_unpack(cell, np.uint32).astype(np.int64), _unpack(n, np.int64), weights and weights.value, total)
        flat = np.append(total.ravel(), found).astype(np.float32)
        for i in range(0, len(flat), CHUNK):
            if flat[i : i + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([_pack(flat[i : i + CHUNK])])], names=["chunk", "v"])

    return gradient


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, chunk = None, None
    for b in batches:
        for c, v in zip(b.column("chunk").to_pylist(), b.column("v").to_pylist()):
            v = _unpack(v, np.float32).astype(np.float64)
            total, chunk = v if total is None else total + v, c
    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()])], names=["chunk", "v"])


def _collect(cells: DataFrame, weights) -> tuple[np.ndarray, float]:
    """Sums of all tasks: an array of the weights' size, and the log-likelihood."""
    flat = np.zeros((ROWS + 1) * CLASSES + 1)
    got = cells.mapInArrow(_gradient(weights), "chunk int, v binary").groupBy("chunk").applyInArrow(_add, "chunk int, v binary")
    for r in got.collect():
        flat[r.chunk * CHUNK : r.chunk * CHUNK + len(r.v) // 8] = np.frombuffer(r.v)
    return flat[:-1].reshape(ROWS + 1, CLASSES), float(flat[-1])


def fit(cells: DataFrame, size: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """Weights after ``rounds`` gradient steps, each scaled by the counts behind the weight, and
    the log-likelihood before each step."""
    spark = cells.sparkSession
    weights = np.zeros((ROWS + 1, CLASSES), np.float32)
    weights[ROWS] = np.log((size + 0.5) / (size.sum() + 0.5 * CLASSES))
    observed, _ = _collect(cells, None)
    course = []
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights)
        expected, found = _collect(cells, sent)
        sent.destroy()
        course.append(found)
        weights = (weights + RATE * (observed - expected) / (np.maximum(observed, expected) + DAMP)).astype(np.float32)
    return weights, course


def _normalisers(weights):
    def normalisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_pylist()
            two = np.arange(BUCKETS)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([normaliser(logits(weights.value, features(np.full(BUCKETS, i), two)).astype(np.float64)).tobytes() for i in ids], pa.binary())], names=["id", "v"])

    return normalisers


class Model:
    """Weights, and the normaliser of every history."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, normalisers: np.ndarray):
        self.vocabulary, self.weights, self.normalisers = vocabulary, weights, normalisers

    def log10(self, t: Tokens) -> np.ndarray:
        """log10 P of each token."""
        out = np.empty(len(t.kind))
        for a in range(0, len(out), 1 << 16):
            s = slice(a, a + (1 << 16))
            rows, kind = features(t.one[s], t.two[s]), t.kind[s]
            z = self.weights[ROWS, kind].astype(np.float64)
            for f in range(rows.shape[1]):
                z += self.weights[rows[:, f], kind]
            out[s] = z - self.normalisers[t.context[s]] + self.vocabulary.within(kind, t.n[s])
        return out / np.log(10)


def _scored(model, ends: int, kind: pa.DataType):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                t = Tokens(row, ends)
                each = lambda x: pa.array(np.add.reduceat(x, t.start))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["row"], pa.int64()), pa.array(row["doc_id"], kind), pa.array(t.test), pa.array(t.size), each((t.n > 0).astype(np.int64)), each(model.value.vocabulary.base(t.n)), each(model.value.log10(t))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return scored


def language_scores(documents: DataFrame, rounds: int = ROUNDS, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``
    of every row of ``documents``.

    Rows whose crc32(doc_id as text) mod 5 is 1 are held out; a row without an id is not.  Null
    and empty texts are the end alone; repeated rows are learnt from and scored as often as
    they stand there.  Without training rows every word is unknown and the classes are alike.
    An empty table gives no rows; other columns are not read.  Documents longer than ``part``
    code points are read in parts.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = documents.sparkSession
    field = documents.schema["doc_id"].dataType
    kind, name = to_arrow_type(field), field.simpleString()
    schema = f"block long, row array<long>, doc_id array<{name}>, test array<boolean>, size array<int>, lead array<int>, at binary, words binary, n binary, ends long"
    blocks = staged(documents.select("doc_id", "text").mapInArrow(_blocks(kind, block, part), schema))
    ends, tokens = blocks.agg(F.sum("ends"), F.sum(F.expr("aggregate(size, 0L, (a, x) -> a + x)"))).first()
    ends, tokens = ends or 0, tokens or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // 8 // GROUP)
    dealt = blocks.select("block", "words", "n").mapInArrow(_deal(groups), "part int, block long, words binary, n binary")
    words = staged(dealt.groupBy("part").applyInArrow(_total, "part int, block long, words binary, n binary"))
    top = words.where("block = -1").select("words", "n").mapInArrow(_top, "word string, n long").orderBy(F.desc("n"), "word").limit(BUCKETS)
    totals = np.zeros(3 + ENDINGS, np.int64)
    for r in words.where("block = -2").select("n").toLocalIterator():
        totals += _unpack(bytes(r.n), np.int64)
    vocabulary = Vocabulary([tuple(r) for r in top.collect()], totals, ends)
    known = words.where("block >= 0").mapInArrow(_described(spark.sparkContext.broadcast(vocabulary)), "part int, block long, kind binary, history binary, n binary")
    known = known.groupBy("block").agg(F.collect_list(F.struct("part", "kind", "history", "n")).alias("parts"))
    coded = staged(blocks.drop("words", "n", "ends").join(known, "block", "left"))
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // CELLS), 4096)
    cells = staged(coded.mapInArrow(_cells(parts), "part int, cell binary, n binary").groupBy("part").applyInArrow(_merge, "cell binary, n binary"))
    weights, _ = fit(cells, vocabulary.size, rounds)
    sent = spark.sparkContext.broadcast(weights)
    table = np.zeros((BUCKETS, BUCKETS))
    for r in spark.range(BUCKETS).mapInArrow(_normalisers(sent), "id long, v binary").collect():
        table[r.id] = np.frombuffer(r.v)
    model = spark.sparkContext.broadcast(Model(vocabulary, weights, table.ravel()))
    pieces = coded.mapInArrow(_scored(model, ends, kind), f"row long, doc_id {name}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    whole = [F.first(c).alias(c) for c in ("doc_id", "held_out")] + [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return pieces.groupBy("row").agg(*whole).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
