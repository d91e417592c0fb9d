"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's words.

A window is 13 consecutive words of an item (a shorter item is one window).  Whatever window
of an item stands in a document, it holds one of the item's seeds: five words that start at a
multiple of nine (pigeonhole: 9 + 5 - 1 = 13).  The seeds of all items form one automaton,
about half a node for each character of the benchmark instead of thirteen.  A document is
normalised once and scanned once; where a seed stands, its match with the item is followed
to both sides, and thirteen or more equal words are a hit.  Hits come back as word and
character positions of the original text.

One automaton holds AUTOMATON_CHARS of benchmark.  A larger benchmark first loses the items
that no document can hit: a broadcast array of seed hashes tells which seeds stand in the
corpus at all, and only items with such a seed go into automata.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, alnum_words, ascii_lower, slices, staged, texts

WINDOW = 13
SEED = 5
#: Places of a seed in the benchmark beyond which its windows are looked up instead.
CROWD = 16
#: Benchmark text, in characters, that one automaton may hold (about 40 bytes each in a worker);
#: more text of items that stand in the corpus makes more automata, and a pass for each.
AUTOMATON_CHARS = 8_000_000

_spans = re.compile(ALNUM_WORD).finditer


def seed_starts(n_words: int, n: int = WINDOW, seed: int = SEED) -> range:
    """Where the seeds of an item of ``n_words`` words start; any ``n`` words hold one of them."""
    return range(0, max(0, n_words - seed + 1), n - seed + 1)


class Automaton:
    """Seeds of some benchmark items; ``items`` are (id as text, text) pairs; items of null id
    are hit but never named.

    A seed of few owners is followed in each of them.  A seed of more than CROWD owners (a stock
    phrase, one word over and over) leads to a table of the windows around it in its owners: a
    document's window is looked up once, whatever the number of items that share the seed.
    """

    def __init__(self, items: list[tuple[str | None, str]], n: int = WINDOW):
        self.n, self.seed = n, min(SEED, n)
        self.ids = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.ids)}
        owners: dict[str, list[tuple[int, int]]] = {}
        whole: dict[str, set[int]] = {}
        self.words: list[list[str]] = []
        self.number: list[int] = []
        for item, text in items:
            words = alnum_words(ascii_lower(text))
            if not words:
                continue
            if len(words) < n:
                whole.setdefault(" ".join(words), set()).add(number.get(item, -1))
                continue
            self.words.append(words)
            self.number.append(number.get(item, -1))
            for at in seed_starts(len(words), n, self.seed):
                owners.setdefault(" ".join(words[at : at + self.seed]), []).append((len(self.words) - 1, at))
        #: Windows of crowded seeds by hash: where one stands in an item, and all items that hold it.
        self.windows: dict[int, list[tuple[int, int, set[int]]]] = {}
        self.trie = ahocorasick.Automaton()
        for w in owners.keys() | whole.keys():
            own = owners.get(w, [])
            if len(own) > CROWD:
                for k, at in own:
                    self._keep_windows(k, at)
            self.trie.add_word(f" {w} ", (w, whole.get(w), own if len(own) <= CROWD else None))
        self.empty = not owners and not whole
        if not self.empty:
            self.trie.make_automaton()

    def _keep_windows(self, k: int, at: int) -> None:
        item = self.words[k]
        for s in range(max(0, at - self.n + self.seed), min(at, len(item) - self.n) + 1):
            window = item[s : s + self.n]
            groups = self.windows.setdefault(_hash(window), [])
            known = next((g for g in groups if self.words[g[0]][g[1] : g[1] + self.n] == window), None)
            if known is None:
                groups.append((k, s, {self.number[k]}))
            else:
                known[2].add(self.number[k])

    def scan(self, words: list[str]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the numbers of the items found."""
        hit, found = np.zeros(len(words), bool), set()
        if self.empty or not words:
            return hit, found
        line = f" {' '.join(words)} "
        matches = list(self.trie.iter(line))
        if matches:
            starts = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
            done: dict[tuple[int, int], int] = {}  # how far each item was followed at each offset
            tried, named = np.zeros(len(words), bool), set()  # windows looked up, and owners named
            for end, (seed, whole, own) in matches:
                p = int(np.searchsorted(starts, end - len(seed) - 1))
                if whole:
                    hit[p : p + seed.count(" ") + 1] = True
                    if seed not in named:
                        named.add(seed)
                        found |= whole
                if own is None:
                    for a in range(max(0, p - self.n + self.seed), min(p, len(words) - self.n) + 1):
                        if not tried[a]:
                            tried[a] = True
                            self._look_up(words[a : a + self.n], a, hit, found, named)
                for k, at in own or ():
                    if p < done.get((k, p - at), 0):
                        continue
                    item = self.words[k]
                    a, z = self._follow(item, at, words, p)
                    done[k, p - at] = z
                    if z - a >= self.n:
                        hit[a:z] = True
                        found.add(self.number[k])
        found.discard(-1)
        return hit, found

    def _look_up(self, window: list[str], a: int, hit: np.ndarray, found: set[int], named: set) -> None:
        for k, s, owners in self.windows.get(_hash(window), ()):
            if self.words[k][s : s + self.n] == window:
                hit[a : a + self.n] = True
                if (k, s) not in named:
                    named.add((k, s))
                    found |= owners

    @staticmethod
    def _follow(item: list[str], at: int, words: list[str], p: int) -> tuple[int, int]:
        """The words around ``p`` that equal those of the item around ``at``: from, to."""
        back = 0
        while back < min(at, p) and item[at - back - 1] == words[p - back - 1]:
            back += 1
        on, most = 0, min(len(item) - at, len(words) - p)
        while on < most and item[at + on] == words[p + on]:
            on += 1
        return p - back, p + on


def character_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """The hit words as maximal character spans of the original text (ends not included)."""
    out: list[tuple[int, int]] = []
    last = -2
    for k, m in enumerate(_spans(ascii_lower(text))):
        if hit[k]:
            if last == k - 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
            last = k
    return out


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of bounded size, streamed through the driver one at a time."""
    block, size = [], 0
    for r in items.orderBy("item", "text").toLocalIterator():
        if block and size + len(r.text) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.item, r.text))
        size += len(r.text)
    yield block


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))


def _item_seeds(n: int):
    """Hashes of each item's seeds with their number of words; short items are one seed."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes, sizes = [], []
            for text in texts(b):
                words = alnum_words(ascii_lower(text))
                size = min(SEED, n) if len(words) >= n else len(words)
                starts = seed_starts(len(words), n, size) if len(words) >= n else ([0] if words else [])
                hashes.append(np.array([_hash(words[i : i + size]) for i in starts], np.uint64).view(np.int64))
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("text"), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], names=["item", "text", "seeds", "size"])

    return seeds


def _present(sent):
    """The known seeds that stand in a task's documents, each once."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value  # sorted hashes by number of words
        seen = {size: np.zeros(len(h), bool) for size, h in known.items()}
        for b in slices(batches):
            for text in texts(b):
                words = alnum_words(ascii_lower(text))
                for size, hashes in known.items():
                    mine = np.array([_hash(words[i : i + size]) for i in range(len(words) - size + 1)], np.uint64).view(np.int64)
                    at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
                    seen[size][at[hashes[at] == mine]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([known[size][s] for size, s in seen.items()] or [np.zeros(0, np.int64)]))], names=["seed"])

    return present


def candidates(documents: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """The items of which at least one seed stands in some document."""
    spark = documents.sparkSession
    seeded = staged(items.mapInArrow(_item_seeds(n), "item string, text string, seeds array<long>, size int"))
    known: dict[int, list[int]] = {}
    for r in seeded.select("size", F.explode("seeds").alias("seed")).distinct().toLocalIterator():  # 8 bytes for nine words of benchmark
        known.setdefault(r["size"], []).append(r.seed)
    sent = spark.sparkContext.broadcast({size: np.sort(np.array(h, np.int64)) for size, h in known.items()})
    present = documents.select("text").mapInArrow(_present(sent), "seed long").distinct()
    return seeded.select("item", "text", F.explode("seeds").alias("seed")).join(present, "seed", "left_semi").select("item", "text").distinct()


_built: dict[str, Automaton] = {}


def _automaton(name: str, items: list[tuple[str | None, str]], n: int) -> Automaton:
    """The automaton of a block, built once in each worker process, which holds one at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(items, n)
    return _built[name]


HITS = "n_words long, hits array<int>, items array<string>, spans array<struct<start: int, stop: int>>"


def _scan(items, n: int):
    name = uuid.uuid4().hex
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, items.value, n)
        for b in slices(batches):
            n_words, hits, found, spans = [], [], [], []
            for text, old_hits, old_items in zip(texts(b), b.column("hits").to_pylist(), b.column("items").to_pylist()):
                words = alnum_words(ascii_lower(text))
                hit, numbers = automaton.scan(words)
                hit[old_hits] = True
                names = sorted({*old_items, *(automaton.ids[k] for k in numbers)})
                n_words.append(len(words))
                hits.append(np.flatnonzero(hit).astype(np.int32))
                found.append(names)
                spans.append([{"start": a, "stop": z} for a, z in character_spans(text, hit)] if hit.any() else [])
            cols = [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), *cols], names=["row", "text", "n_words", "hits", "items", "spans"])

    return scan


def contamination(documents: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, n: int = WINDOW, block_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """One row per document: ``columns`` (default: doc_id), ``n_words``, ``hits`` (word numbers),
    ``items`` (ids as text, sorted), ``spans`` (character spans of the original text),
    ``n_hit``, ``contaminated``.

    Contaminated: at least one word and at least a twentieth of the words are hit.  Null and
    empty texts have no words and are clean; null items are ignored; an
    item of null id counts in hits but has no place in items; an empty
    benchmark hits nothing; repeated rows give repeated rows; other columns are ignored.  Of a
    benchmark above ``block_chars`` only the items with a seed in the corpus count; if these
    are still more, they are scanned in blocks, one pass over the documents and one automaton
    of bounded size for each, and a document's hits are united.
    """
    spark = documents.sparkSession
    items_of = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    if (items_of.agg(F.sum(F.length("text"))).first()[0] or 0) > block_chars:
        items_of = candidates(documents, items_of, n)
    now = documents.select(F.struct(*(columns or ["doc_id"])).alias("row"), "text", F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    out = f"row {now.schema['row'].dataType.simpleString()}, text string, {HITS}"
    for k, items in enumerate(_blocks(items_of, block_chars)):
        now = (staged(now) if k else now).select("row", "text", "hits", "items").mapInArrow(_scan(spark.sparkContext.broadcast(items), n), out)
    n_hit = F.size("hits").cast("long")
    return now.select("row.*", "n_words", "hits", "items", "spans").withColumn("n_hit", n_hit).withColumn("contaminated", (n_hit > 0) & (20 * n_hit >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    """The per-document digest columns of ``contamination``."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated")


def contamination_sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL for ``digest``: words numbered by unnesting, windows joined by their text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda t: f"coalesce(regexp_extract_all(translate({t}, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    return f"""
WITH d AS (SELECT doc_id, {words('text')} AS w FROM {documents}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words('text')} AS w FROM {benchmark}),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""
