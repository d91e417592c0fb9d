"""Token counts at every prefix of a text, by dynamic programming over byte-level BPE.

A token sequence is the BPE encoding of its bytes exactly if every neighbouring pair is,
so the encoding of a prefix ends with the one vocabulary token that fits the last token of
the remaining prefix.  Running over the prefixes of a pre-token this gives, in one pass,
the exact number of tokens of each.  Pre-tokens recur, so their prefix counts are stored
once, and a text is the running sum over its pre-tokens: how many tokens a truncated text
has, and where a budget is spent, are look-ups that encode nothing again.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

LIMIT = 1024
#: Bytes of prefix counts that a worker keeps, with what an entry costs beside its text and
#: counts; pre-tokens longer than LONG bytes are counted where they stand and not kept.
STORED_BYTES = 160 << 20
ENTRY_BYTES = 200
LONG = 1024

# Fixed value: the pre-tokenization pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_pieces_any = regex.compile(PATTERN).findall
# The same for texts of Latin letters, ASCII and plain white space, where the standard
# library's classes agree with it; it is the faster engine.
_latin = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]*").fullmatch
_pieces_latin = re.compile(r" ?[^\t\n\r !-@\[-`{-~]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+").findall

# The pattern's first alternatives: cut short, they are a sign and letters.
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
_white = regex.compile(r"\s+").fullmatch


def pieces(text: str) -> list[str]:
    """The pre-tokens of a text, in order; together they are the text."""
    return _pieces_latin(text) if _latin(text) else _pieces_any(text)


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, as character to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE from a ``tokenizer.json``: ranks of merges, tokens, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        of = _byte_characters()
        raw = lambda s: bytes(of[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.made = {b: (r, a_b) for a_b, r in reversed(self.rank.items()) for b in [a_b[0] + a_b[1]]}
        self.tokens = {t for t in self.tokens if len(t) == 1 or self.encode(t) == [t]}
        self.ending = ahocorasick.Automaton()
        for t in self.tokens:
            self.ending.add_word(t.decode("latin-1"), t)
        self.ending.make_automaton()
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))).split if self.added else lambda t: [t]
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.stored: dict[str, bytes | array] = {}
        self.stored_bytes = 0

    def encode(self, data: bytes) -> list[bytes]:
        """Merge by rank, the plain way (for short pieces)."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            r, i = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, left: bytes, right: bytes) -> bool:
        """Do two tokens side by side stay two tokens?

        The merges that build them are undone from the last to the first.  At each moment the
        part that ends the left one and the part that starts the right one touch; if a merge
        joins these two before both are used up otherwise, the tokens do not stay apart.  Of
        equal merges the one further left comes first.
        """
        a, b = left, right
        a_until = b_until = 1 << 60
        rank, made, byte = self.rank, self.made, (-1, None)
        while True:
            m = rank.get((a, b))
            if m is not None and m < a_until and m <= b_until:
                return False
            (ra, pa), (rb, pb) = made.get(a, byte), made.get(b, byte)
            if ra > rb:
                a, a_until = pa[1], ra
            elif rb >= 0:
                b, b_until = pb[0], rb
            else:
                return True

    def _fit(self, left: bytes, right: bytes) -> bool:
        if len(self.fits) > 500_000:
            self.fits.clear()
        self.fits[left, right] = ok = self.apart(left, right)
        return ok

    def prefix_counts(self, data: bytes) -> bytes | array:
        """Number of tokens of ``data[:i]`` for every i from 0 to its length.

        An automaton of all tokens names those that end at each place, the longest first.
        """
        last, count, done = [b""], [0], 0
        fits = self.fits
        for end, t in self.ending.iter(data.decode("latin-1")):
            if end < done:
                continue
            j = end + 1 - len(t)
            if not j or (ok := fits.get((last[j], t))) or (ok is None and self._fit(last[j], t)):
                last.append(t)
                count.append(count[j] + 1)
                done = end + 1
        return bytes(count) if len(data) < 256 else array("I", count)

    def counts(self, piece: str) -> bytes | array:
        """Prefix counts of a pre-token, by bytes; those of short ones are stored."""
        got = self.stored.get(piece)
        if got is None:
            got = self.prefix_counts(piece.encode("utf-8", "surrogatepass"))
            if len(got) <= LONG:
                cost = ENTRY_BYTES + 2 * len(got)
                if self.stored_bytes + cost > STORED_BYTES:
                    self.stored.clear()
                    self.stored_bytes = 0
                self.stored[piece] = got
                self.stored_bytes += cost
        return got

    def count(self, text: str) -> int:
        """Number of tokens of a text; strings of added tokens inside it count one each."""
        parts = self.split_added(text)
        get, total = self.stored.get, len(parts) - 1
        for part in parts:
            for piece in pieces(part):
                total += (get(piece) or self.counts(piece))[-1]
        return total


class PrefixCounts:
    """Exact token counts of every prefix of one text."""

    def __init__(self, vocabulary: Vocabulary, text: str):
        self.v, self.text = vocabulary, text
        self.start, self.before, self.piece, self.part = [], [], [], []
        at = total = 0
        added = re.findall("|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True))), text) if vocabulary.added else []
        for k, part in enumerate(vocabulary.split_added(text)):
            if k:
                self._add(at, total, None, len(self.start))
                at, total = at + len(added[k - 1]), total + 1
            first = len(self.start)
            for piece in pieces(part):
                self._add(at, total, piece, first)
                at, total = at + len(piece), total + vocabulary.counts(piece)[-1]
        self.total = total
        self.run_at: tuple[int, int, str] = (-1, 0, "")
        self.looked_at: tuple[str, bytes | array | list[int]] = ("", b"\0")

    def _add(self, at: int, total: int, piece: str | None, first: int) -> None:
        """A pre-token (None: an added token) and the first one of the stretch it belongs to."""
        self.start.append(at)
        self.before.append(total)
        self.piece.append(piece)
        self.part.append(first)

    def _by_character(self, piece: str) -> bytes | array | list[int]:
        """Prefix counts at every character of a pre-token; those looked at last are at hand."""
        if self.looked_at[0] is not piece:
            counts = self.v.counts(piece)
            if not piece.isascii():
                counts = [counts[0], *(counts[i] for i in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece))]
            self.looked_at = (piece, counts)
        return self.looked_at[1]

    def _run(self, j: int) -> tuple[int, str]:
        """The whole run of white space that reaches into pre-token ``j``: its first pre-token, its
        characters.  A run is at most two pre-tokens, as its last character may stand apart."""
        if self.run_at[0] == j:
            return self.run_at[1:]
        first = j - 1 if j > self.part[j] and _white(self.piece[j - 1]) else j
        run = "".join(self.piece[first:j]) + (self.piece[j] if _white(self.piece[j]) else self.piece[j][0])
        if first == j and j + 1 < len(self.start) and self.part[j + 1] == self.part[j] and _white(self.piece[j]) and _white(self.piece[j + 1][0]):
            run += self.piece[j + 1] if _white(self.piece[j + 1]) else self.piece[j + 1][0]
        self.run_at = (j, first, run)
        return first, run

    def at(self, k: int) -> int:
        """Tokens of ``text[:k]``."""
        if k <= 0:
            return 0
        if k >= len(self.text):
            return self.total
        j = bisect_right(self.start, k - 1) - 1
        piece, s = self.piece[j], self.start[j]
        if piece is None:  # inside an added token's string, which a cut makes ordinary text
            if k == (self.start[j + 1] if j + 1 < len(self.start) else len(self.text)):
                return self.before[j] + 1
            first = self.part[j - 1] if j and self.piece[j - 1] is not None else j
            return self.before[first] + self.v.count(self.text[self.start[first] : k])
        if _white(self.text[k - 1]):  # trailing white space is one pre-token
            first, run = self._run(j)
            return self.before[first] + self._by_character(run)[k - self.start[first]]
        if piece in CONTRACTIONS:
            return self.before[j] + self.v.count(self.text[s:k])
        return self.before[j] + self._by_character(piece)[k - s]

    def longest(self, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens.

        Only the pre-token in which the budget is spent is searched, and the white space
        and added token behind it, which may join it; every look-up there is into one array of counts.
        """
        if self.total <= budget:
            return len(self.text)
        j = max(0, bisect_left(self.before, budget) - 1)
        k = self.start[j + 1] if j + 1 < len(self.start) else len(self.text)
        while k < len(self.text) and _white(self.text[k]):
            k += 1
        i = bisect_left(self.start, k)
        if i < len(self.start) and self.piece[i] is None:  # cut short, it may take a blank before it
            k = self.start[i + 1] - 1 if i + 1 < len(self.start) else len(self.text) - 1
        while k and self.at(k) > budget:
            k -= 1
        return k


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _count(path: str, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in slices(batches):
            n_bytes, n_tokens, cut = [], [], []
            for t in texts(b):
                n = v.count(t)
                n_bytes.append(len(t.encode("utf-8", "surrogatepass")))
                n_tokens.append(n)
                cut.append(len(t) if n <= limit else PrefixCounts(v, t).longest(limit))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(cut, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "limit_chars"])

    return count


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``limit_chars`` (code points of the longest prefix of
    at most ``limit`` tokens), ``over_limit`` for every row of ``documents``.

    ``path`` is a tokenizer.json that every executor can open.  No begin, end or added
    tokens; the string of an added token inside a text counts one, as the tokenizers
    library does by default.  Null and empty texts have no tokens; repeated rows are kept;
    other columns are ignored; an empty table gives an empty result.
    """
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_count(path, limit), f"doc_id {kind}, n_bytes long, n_tokens long, limit_chars long").withColumn("over_limit", F.col("n_tokens") > limit)
