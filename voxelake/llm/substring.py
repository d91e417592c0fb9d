"""Substring dedup with suffix automata over content-routed reference shards.

A window of 20 words is removed if its word sequence also starts earlier in the corpus.
Streaming every document past an automaton of every shard would cost the square of the
corpus, so passages are routed to the shards they can match instead:

1. Every window has an anchor: its word 5-gram of least hash, the leftmost of equals.
   Equal windows have equal anchors, so the anchor's hash names the shard.  Neighbouring
   windows that share an anchor form one passage, about one for eight words of text.
2. One shuffle of passages by anchor, sorted by content and place: a passage whose whole
   word sequence came before is a copy, and needs no text.
3. Anchors with several different passages are the reference shards.  Their distinct
   passages are cut from the texts and stream, in document order, past the shard's suffix
   automaton: matching statistics of 20 or more words are spans that start earlier; then
   the passage joins the automaton.
4. Shards beyond PASSAGES_PER_SHARD are dealt anew by the whole window, where the first
   start is an aggregate that combines before the shuffle.  Anchors with a share of all
   rows are recognised by a frequent-items sketch over all anchors and go there at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, slices, spaced_words, staged, texts

WINDOW = 20
GRAM = 5
PASSAGES_PER_SHARD = 256
#: Anchors with more rows than this, and than one in so many of all rows, skip step 2.
HOT_ROWS = 20_000
HOT_SHARE = 20_000
_PLACE_BITS = 26
_ODD = np.array([xxhash.xxh64_intdigest(f"gram {i}") | 1 for i in range(GRAM)], np.uint64)
_BASE = np.uint64(xxhash.xxh64_intdigest("base") | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


_words = re.compile(SPACED_WORD).finditer


class _WordHashes(dict):
    """Hash of each word, remembered for the words in use."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class _Sums:
    """Hashes of word ranges from prefix sums of a polynomial."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def of(self, h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(h):
            n = max(2 * len(h), 4096)
            self.power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE))))
            self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE_INVERSE))))
        prefix = np.concatenate(([np.uint64(0)], np.cumsum(h * self.power[: len(h)])))
        return _mix((prefix[stop] - prefix[start]) * self.inverse[start])


def passages_of(h: np.ndarray, sums: _Sums, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """The passages of a document from its word hashes: start, number of windows, anchor, content."""
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    n_grams, width = len(h) - GRAM + 1, window - GRAM + 1
    gram = np.zeros(n_grams, np.uint64)
    for i in range(GRAM):
        gram += h[i : i + n_grams] * _ODD[i]
    gram = _mix(gram)
    place = np.uint64((1 << _PLACE_BITS) - 1)
    low, reach = (gram & ~place) | np.arange(n_grams, dtype=np.uint64), 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    anchor = (low & place).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.append(start, len(anchor)))
    return start, count, gram[anchor[start]], sums.of(h, start, start + count + window - 1)


def _copies(key, seg, order, start) -> np.ndarray:
    """Rows whose (key, seg) also stands at a smaller (order, start) among these rows."""
    by = np.lexsort((start, order, seg, key))
    k, s, o, p = key[by], seg[by], order[by], start[by]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))[: len(by)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    out = np.zeros(len(by), bool)
    out[by] = (o != o[first]) | (p != p[first])
    return out


PASSAGE = "ord long, th long, s int, n int, key long, seg long, copy boolean"


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, sums = _WordHashes(), _Sums()
    for b in slices(batches):
        parts, size = [], []
        for text in texts(b):
            words = spaced_words(text)
            parts.append(passages_of(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), sums))
            size.append(len(parts[-1][0]))
        if not sum(size):
            continue
        start, count, key, seg = (np.concatenate(x) for x in zip(*parts))
        order, th = (np.repeat(b.column(c).to_numpy(), size) for c in ("ord", "th"))
        cols = [order, th, start.astype(np.int32), count.astype(np.int32), key.view(np.int64), seg.view(np.int64), _copies(key, seg, order, start)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["ord", "th", "s", "n", "key", "seg", "copy"])


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, seg, ord, s): copies of an earlier passage, and the distinct
    passages of anchors that have several.  Only the passages of one anchor are held."""
    last, held, held_key, crowded = None, [], None, False

    def out(rows: np.ndarray, kind: int) -> pa.RecordBatch:
        cols = [pa.array(rows[c]) for c in ("ord", "th", "s", "n", "key")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(rows), kind, np.int32))], names=["ord", "th", "s", "n", "key", "kind"])

    def settle() -> Iterator[pa.RecordBatch]:
        if held and (crowded or sum(map(len, held)) > 1):
            yield out(np.concatenate(held), 2 if crowded else 1)

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.rec.fromarrays([b.column(c).to_numpy() for c in ("ord", "th", "s", "n", "key", "seg")], names="ord,th,s,n,key,seg")
        new = np.concatenate(([last is None or rows.key[0] != last.key or rows.seg[0] != last.seg], (rows.key[1:] != rows.key[:-1]) | (rows.seg[1:] != rows.seg[:-1])))
        first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
        o = np.where(first >= 0, rows.ord[first], last.ord if last is not None else 0)
        s = np.where(first >= 0, rows.s[first], last.s if last is not None else 0)
        copy = (rows.ord != o) | (rows.s != s)
        if copy.any():
            yield out(rows[copy], 0)
        kept = rows[~copy]
        if len(kept):
            edges = np.append(np.flatnonzero(np.concatenate(([True], kept.key[1:] != kept.key[:-1]))), len(kept))
            size = np.diff(edges)
            inner = np.ones(len(size), bool)
            inner[[0, -1]] = False
            many = np.repeat(inner & (size > 1) & (size <= PASSAGES_PER_SHARD), size)
            if many.any():
                yield out(kept[many], 1)
            for g in np.flatnonzero(~inner | (size > PASSAGES_PER_SHARD)):
                group = kept[edges[g] : edges[g + 1]]
                if group.key[0] != held_key:
                    yield from settle()
                    held, held_key, crowded = [], group.key[0], False
                held.append(group)
                if crowded or sum(map(len, held)) > PASSAGES_PER_SHARD:
                    crowded = True
                    yield out(np.concatenate(held), 2)
                    held = []
        if first[-1] >= 0:
            last = rows[first[-1]]
    yield from settle()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of listed passages; those of crowded anchors one window at a time."""
    sums, hashes = _Sums(), _WordHashes()
    for b in slices(batches, 64):
        rows = []
        for order, th, text, wanted in zip(b.column("ord").to_pylist(), b.column("th").to_pylist(), texts(b), b.column("wanted").to_pylist()):
            words = spaced_words(text)
            h = None
            for w in wanted:
                s, n = w["s"], w["n"]
                if w["kind"] == 1:
                    rows.append((w["key"], 0, order, th, s, " ".join(words[s : s + n + WINDOW - 1])))
                    continue
                if h is None:
                    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                at = np.arange(s, s + n)
                one, two = sums.of(h, at, at + WINDOW), sums.of(_mix(h + _BASE), at, at + WINDOW)
                rows += [(int(a), int(z), order, th, int(i), None) for a, z, i in zip(one.view(np.int64), two.view(np.int64), at)]
        cols = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "key2", "ord", "th", "s", "words"])


class SuffixAutomaton:
    """Suffix automaton of the passages added so far, over words."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, after: dict[str, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        """State ``q`` parted at the length that ``p`` and ``word`` reach."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[str]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word, -1)
            if q >= 0:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            p, last = last, self._state(self.length[last] + 1, 0, {})
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)

    def matching_statistics(self, words: list[str]) -> list[int]:
        """For each word, the length of the longest match that ends with it."""
        state = length = 0
        out = []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            out.append(length)
        return out


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages sorted by (key, ord, s) past the automaton of their shard's earlier passages."""
    key, automaton, waiting, place = None, None, [], None
    for b in slices(batches, 4096):
        rows = []
        for k, order, th, s, text in zip(*(b.column(c).to_pylist() for c in ("key", "ord", "th", "s", "words"))):
            words = text.split(" ")
            if k != key:
                key, automaton, waiting, place = k, SuffixAutomaton(), [], None
            if (order, s) != place:
                for w in waiting:
                    automaton.add(w)
                waiting, place = [], (order, s)
            ends = [i for i, m in enumerate(automaton.matching_statistics(words)) if m >= WINDOW]
            for e in ends:
                if rows and rows[-1][:2] == (order, th) and rows[-1][2] <= s + e - WINDOW + 1 <= rows[-1][3]:
                    rows[-1] = (*rows[-1][:3], s + e + 1)
                else:
                    rows.append((order, th, s + e - WINDOW + 1, s + e + 1))
            waiting.append(words)
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["ord", "th", "s", "e"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite a document's spans and take their words out."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for b in slices(batches):
        n_words, n_removed, removed, kept, cut = [], [], [], [], []
        for text, found in zip(texts(b), b.column("found").to_pylist()):
            words = spaced_words(text)
            spans: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            rest, at = [], 0
            for s, e in spans:
                rest += words[at:s]
                at = e
            rest += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(rest))
            removed.append([{"start": s, "stop": e} for s, e in spans])
            kept.append(" ".join(rest))
            cut.append(_cut_out(text, spans) if spans else text)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.string()), pa.array(cut, pa.string())], names=["row", "n_words", "n_removed", "removed", "kept", "cut"])


def _cut_out(text: str, spans: list[list[int]]) -> str:
    """A text without the words of ``spans``, each with the white space behind it."""
    at = [m.start() for m in _words(text)] + [len(text)]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : at[s]])
        last = at[e]
    return "".join([*out, text[last:]])


def frequent(rows: DataFrame, column: str, more_than: int) -> list[int]:
    """Values of a long column on more than ``more_than`` rows, from a frequent-items sketch over
    all rows; at most HOT_SHARE values when more_than is above a HOT_SHARE-th of the rows."""
    got = rows.agg(F.expr(f"approx_top_k({column}, {HOT_SHARE}, {4 * HOT_SHARE})").alias("top")).first()
    return sorted(x["item"] for x in (got.top or ()) if x["item"] is not None and x["count"] > more_than)


def remove_repeats(documents: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id), ``n_words``, ``n_removed``, ``removed`` (maximal word spans), ``kept`` (the other
    words joined by one space), ``cut`` (the text without the removed words, line ends and all other
    white space as they were) for every row of ``documents``.

    A word goes if a window of 20 consecutive words covers it whose word sequence also starts
    earlier: in a smaller doc_id, or earlier in the same document.  A null doc_id counts as
    smaller than every number.  Null and empty texts, and texts of fewer than 20 words, lose
    nothing.  Repeated rows (equal doc_id) start at the same places, so neither is earlier
    than the other and both lose the same words to third documents.  Other columns are
    ignored; an empty table gives an empty result.
    """
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    repeated_ids = not documents.groupBy(ids.alias("i")).count().where("count > 1").isEmpty()
    th = F.xxhash64("text") if repeated_ids else F.lit(0).cast("long")
    docs = documents.select(F.struct(*(columns or ["doc_id"])).alias("row"), ids.alias("ord"), th.alias("th"), "text")

    # copies under one id start at the same places: one of them stands for all until the last join
    texts = staged(docs.select("ord", "th", "text").distinct()) if repeated_ids else docs.select("ord", "th", "text")
    passages = staged(texts.mapInArrow(_passages, PASSAGE))
    open_rows = passages.where(~F.col("copy")).drop("copy")
    total = open_rows.count()
    hot = frequent(open_rows, "key", max(HOT_ROWS, total // HOT_SHARE)) if total > HOT_ROWS else []
    if hot:
        spark = documents.sparkSession
        hot_keys = F.broadcast(spark.createDataFrame([(k,) for k in hot], "key long"))
        crowded = open_rows.join(hot_keys, "key", "left_semi").select("ord", "th", "s", "n", "key", F.lit(2).alias("kind"))
        open_rows = open_rows.join(hot_keys, "key", "left_anti").select("ord", "th", "s", "n", "key", "seg")
    n = documents.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sifted = open_rows.select("ord", "th", "s", "n", "key", "seg").repartition(int(n), "key").sortWithinPartitions("key", "seg", "ord", "s").mapInArrow(_sift, "ord long, th long, s int, n int, key long, kind int")
    sifted = staged(sifted)

    span = lambda rows: rows.select("ord", "th", "s", (F.col("s") + F.col("n") + WINDOW - 1).alias("e"))
    found = span(passages.where("copy")).union(span(sifted.where("kind = 0")))
    listed = sifted.where("kind > 0")
    if hot:
        listed = listed.unionByName(crowded)
    listed = listed.groupBy("ord", "th").agg(F.collect_list(F.struct("s", "n", "key", "kind")).alias("wanted"))
    cut = staged(texts.join(listed, ["ord", "th"]).mapInArrow(_cut, "key long, key2 long, ord long, th long, s int, words string"))
    matched = cut.where("words is not null").repartition(int(n), "key").sortWithinPartitions("key", "ord", "s").mapInArrow(_match, "ord long, th long, s int, e int")
    windows = cut.where("words is null").select("key", "key2", "ord", "th", "s")
    first = windows.groupBy("key", "key2").agg(F.min(F.struct("ord", "s")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    later = windows.join(first, ["key", "key2"]).where((F.col("ord") != F.col("first.ord")) | (F.col("s") != F.col("first.s"))).select("ord", "th", "s", (F.col("s") + WINDOW).alias("e"))
    spans = found.union(matched).union(later).groupBy("ord", "th").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    row = docs.schema["row"].dataType.simpleString()
    kept = docs.join(spans, ["ord", "th"], "left").select("row", "text", "found").mapInArrow(_apply, f"row {row}, n_words long, n_removed long, removed array<struct<start: int, stop: int>>, kept string, cut string")
    return kept.select("row.*", "n_words", "n_removed", "removed", "kept", "cut")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def repeats_sql(documents: str = "documents") -> str:
    """DuckDB SQL for ``digest``."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM {documents}),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS seq
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM ranked WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d WHERE len(w) > 0),
kept AS (SELECT words.doc_id, count(*) AS n, count(gone.k) AS n_removed,
    string_agg(word, ' ' ORDER BY words.k) FILTER (gone.k IS NULL) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
