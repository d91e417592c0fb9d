"""License scan: base phrases, and short notices found with errors.

A notice that occurs with at most k errors contains at least one of k + 1 pieces of it
unchanged (pigeonhole), so the pieces of all notices form one Aho-Corasick automaton of
exact seeds.  Where a seed stands, the regex library matches the whole notice with at most
k errors in the stretch that can hold it, and reports the edits and the span.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, alnum_words, ascii_lower, slices, texts

# Fixed values of the query contract: phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices as normalised words, and the labels that they add.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-notice",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "terms of the gnu general public license as published by": "gpl-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "creative commons attribution": "creative-commons",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "all-rights-reserved",
}
#: Characters of a notice for each error allowed in it, and the most errors.
CHARS_PER_ERROR = 12
MOST_ERRORS = 3


class Scanner:
    """Seeds of all notices and base phrases in one automaton."""

    def __init__(self, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE):
        self.base, self.notices = base, list(notices.items())
        self.trie = ahocorasick.Automaton()
        seeds: dict[str, list] = {}
        for phrase in base:
            seeds.setdefault(f" {phrase} ", []).append((-1, phrase, 0))
        self.patterns, self.errors = [], []
        for k, (notice, _) in enumerate(self.notices):
            errors = min(MOST_ERRORS, len(notice) // CHARS_PER_ERROR)
            cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
            for a, z in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[a:z], []).append((k, errors, a))
            self.errors.append(errors)
            self.patterns.append(regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}"))
        for seed, owners in seeds.items():
            self.trie.add_word(seed, (len(seed), owners))
        self.trie.make_automaton()

    def scan(self, words: list[str]) -> tuple[list[tuple[int, str]], list[dict]]:
        """Base places as (word number, label), and notices found: label, edits, words from and to.
        Of notices that overlap, those with more edits than another give way."""
        line = f" {' '.join(words)} "
        starts = None
        base, wanted, found = [], {}, []
        for end, (length, owners) in self.trie.iter(line):
            at = end - length + 1
            for k, x, offset in owners:
                if k < 0:
                    if starts is None:
                        starts = _word_starts(line)
                    base.append((int(np.searchsorted(starts, at + 1)), self.base[x]))
                else:
                    size = len(self.notices[k][0])
                    wanted.setdefault(k, []).append((max(0, at - offset - x), at - offset + size + x))
        for k, windows in sorted(wanted.items()):
            notice, label = self.notices[k]
            for m in self._apart(k, line, windows):
                if starts is None:
                    starts = _word_starts(line)
                first, stop = (int(np.searchsorted(starts, i, side="right")) - 1 for i in (m.start() + (line[m.start()] == " "), max(m.start(), m.end() - 1)))
                found.append({"label": label, "edits": sum(m.fuzzy_counts), "length": len(notice), "first": first, "last": stop})
        by_first = sorted(found, key=lambda f: f["first"])
        firsts, widest = [f["first"] for f in by_first], max((f["last"] - f["first"] for f in found), default=0)
        near = lambda f: by_first[bisect_left(firsts, f["first"] - widest) : bisect_right(firsts, f["last"])]
        better = lambda f, g: g["edits"] < f["edits"] and g["first"] <= f["last"] and f["first"] <= g["last"]
        return sorted(base), [f for f in found if not any(better(f, g) for g in near(f))]

    def _apart(self, k: int, line: str, windows: list[tuple[int, int]]) -> list[regex.Match]:
        """Matches of notice ``k`` in the windows, in order, none overlapping: fewest edits go
        first, and a match that runs into one is sought again in what is left of its window."""
        shortest = len(self.notices[k][0]) - self.errors[k]
        wait, starts, found, nr = [], [], [], count()
        more = set(windows)
        while more or wait:
            for a, z in sorted(more):
                m = self.patterns[k].search(line, a, z) if min(z, len(line)) - a >= shortest else None
                if m:
                    heappush(wait, (sum(m.fuzzy_counts), m.start(), m.end(), next(nr), a, z, m))
            more = set()
            if wait:
                *_, a, z, m = heappop(wait)
                i = bisect_right(starts, m.start())
                if i and found[i - 1].end() > m.start():
                    more = {(a, found[i - 1].start()), (found[i - 1].end(), z)}
                elif i < len(starts) and starts[i] < m.end():
                    more = {(a, starts[i]), (found[i].end(), z)}
                else:
                    starts.insert(i, m.start())
                    found.insert(i, m)
        return found


def _word_starts(line: str) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32) + 1


_spans = re.compile(ALNUM_WORD).finditer
OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label: string, edits: int, start: int, stop: int>>"


def _scan(notices: dict[str, str]):
    kind = pa.list_(pa.struct([("label", pa.string()), ("edits", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for b in slices(batches):
            rows = []
            for text in texts(b):
                low = ascii_lower(text)
                words = alnum_words(low)
                base, found = scanner.scan(words)
                own = {label for _, label in base}
                spans = [m.span() for m in _spans(low)] if found else []
                score = 1.0 if base else max((1 - f["edits"] / f["length"] for f in found), default=0.0)
                at = [k for k, _ in base]
                notes = [{"label": f["label"], "edits": f["edits"], "start": spans[f["first"]][0], "stop": spans[f["last"]][1]} for f in found]
                rows.append((len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {f["label"] for f in found})), score, notes))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"])

    return scan


def scan_licenses(documents: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per document: its word count, base places, labels, a score and the ``notices``
    found (label, edits, character span of the original text).

    n_base counts all places of base phrases; first_word and last_word are the smallest and
    largest word number where one starts (null without any).  labels holds the base labels
    and those of notices found with bounded errors.  score is 1 with a base phrase, else the
    best notice's share of unedited characters, else 0.  Null and empty texts have no words
    and no labels (empty strings); repeated rows are kept; other columns are ignored; an
    empty table gives an empty result.
    """
    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(_scan(notices or NOTICES), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {OUT}")


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
