"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from voxelake.llm import spelling

SCHEMA = "doc_id long, text string, lang string, word string, n int, form string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= 10 * counts[w]:
                form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return out


def corpus(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÉé") for _ in range(rng.randint(5, 9))) + rng.choice(["", "ation", "ation", "ing"]) for _ in range(60)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = rng.choice(stems[: rng.randint(1, 60)])
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "z", w[k] * 2, w[k].upper()]) + w[k + 1 :]
            words.append(w)
        rows.append((None if i % 19 == 0 else i // 2, rng.choice([" ", "-", "1"]).join(words), "en", "x", 7, "y"))
    chain = [("chained" + "x" * k, 4 * 11 ** (2 - k)) for k in range(3)]
    rows.append((900, " ".join(" ".join([w] * n) for w, n in chain), "en", "x", 7, "y"))
    long = "q" * 70 + "w" * 70
    return rows + rows[:5] + [(901, None, "en", "x", 7, "y"), (902, "", None, None, None, None), (903, " ".join([long] * 30 + [long[:-1] + "v"] * 2 + ["e" + long] * 2), "en", "x", 7, "y")]


@pytest.mark.parametrize("crowd", [8, spelling.CROWD])
def test_forms_meet_brute_force(spark, crowd):
    for seed in (1, 2):
        rows = corpus(seed)
        got = spelling.digest(spelling.group_spellings(spark.createDataFrame(rows, SCHEMA).repartition(3), crowd))
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        want = brute_force(rows)
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(want) and set(found) == want
        assert any(r[1] and r[2] != r[1] for r in found)


def test_halved_again_inside_a_shard(monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS", 4)
    words = sorted({w for _, text, *_ in corpus(4) for w in re.findall("[a-zÀ-ÿ]{2,}", text or "")})
    shard = spelling.Shard(words)
    rows = [(i, 0, len(w), 0) for i, w in enumerate(words)]
    shard.search(rows, rows)
    shard.verify()
    found = [(words[i], words[j]) for a, b in shard.found for i, j in zip(a, b)]
    assert sorted(found) == sorted((v, w) for v in words for w in words if v != w and one_edit(v, w))


def test_no_words(spark):
    for rows in ([], [(1, None, None, None, None, None)], [(1, "short words only", "en", "x", 1, "y")]):
        assert spelling.group_spellings(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_crowded_ending_makes_no_square(spark):
    """20,000 words with one ending: candidates follow the words, not their square."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(8)) + "ationally" for _ in range(20_000)})
    shard = spelling.Shard(words)
    seen = []
    keep = shard.candidates
    shard.candidates = lambda a, b, hi: (seen.append(len(a) * len(b)), keep(a, b, hi))
    rows = [(i, 0, len(w), 0) for i, w in enumerate(words)]
    shard.search(rows, rows)
    assert sum(seen) < 60 * len(words)
