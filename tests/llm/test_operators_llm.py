"""Operators against brute force on small tables with nulls, ties, empty and repeated rows."""

import hashlib
import pickle
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from voxelake.llm import decontaminate, licenses, merkle, mixing, quality, simhash, substring, token_counts, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, h string, key long, size int"
rng = random.Random(5)
WORDS = [f"w{i}" for i in range(300)]
SPACED = re.compile(r"[^\x20\x09-\x0D]+").findall


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    shared, base = prose(60), prose(200)
    texts = [base, base, prose(150), None, "", "one", prose(19), prose(20), " ".join(["to"] * 90), prose(30) + " " + shared + " " + prose(25), shared, prose(40) + "\n" + shared]
    texts += [" ".join(w if rng.random() > 0.02 else "edit" for w in base.split()) for _ in range(6)]
    texts += [prose(rng.randint(1, 120)) for _ in range(25)] + [base + " " + base, "x" * 3000, "Ünïcode Ä " * 15 + " \x0b\x1c mixed"]
    return [(3 * i, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t or ""), 1, "h", 5, 6) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def from_sql(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return con.sql(sql).df()


def same(got, want):
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda df: sorted((tuple(None if pd.isna(x) else x for x in t) for t in df[cols].astype(object).values.tolist()), key=str)
    assert plain(got) == plain(want)


def frame(corpus):
    return pd.DataFrame(corpus, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def test_mix_meets_sql_and_targets(docs, corpus, empty):
    mixed = mixing.mix(docs, block_words=16)
    got = mixing.taken(mixed).toPandas()
    same(got, from_sql(mixing.taken_sql(block_words=16), documents=frame(corpus)))
    assert (got.taken <= 2 * got["size"]).all()
    per = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.target - per.taken).abs() < 1).all()
    slots = mixed.where("slot is not null").select("slot", "source").distinct().toPandas()
    assert slots.slot.is_unique
    assert mixing.taken(mixing.mix(empty)).count() == 0


def test_mix_is_what_the_schedule_says(docs, monkeypatch):
    """Without the slots of a source nothing of it is taken; with fewer slots, less."""
    whole = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda t, b: whole(t, b).where("nr <> 1 and (nr <> 2 or rank < 2)"))
    got = mixing.taken(mixing.mix(docs, block_words=16)).toPandas()
    per = got.groupby("source", dropna=False).taken.sum()
    assert sorted(per)[:2] == [0, 32] and (got[got.source == "s1"].n_slots == 0).all()


def test_mix_spreads_null_ids(docs, spark):
    """A third of the rows without an id does not fall into one leaf of the hash tree."""
    rows = [(None, f"text {i}", "s") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=4).select("start", "seat").distinct()
    assert got.where("seat > 1").count() < 10


def test_mix_keeps_repeated_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, "", "s"), (2, "", "s"), (2, None, "s"), (None, "c", None), (None, None, None)]
    got = mixing.taken(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).toPandas()
    same(got, from_sql(mixing.taken_sql(), documents=pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})))
    assert len(got) == len(rows)


def test_mix_repeats_more_than_twice(docs):
    got = mixing.taken(mixing.mix(docs, block_words=16, share=3.0, max_repeat=3.5)).toPandas()
    per = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.target - per.taken).abs() < 1).all()
    assert (got.taken <= 4 * got["size"]).all() and (got.taken > 3 * got["size"]).any()


@pytest.mark.parametrize("share", [0.3, 1.0, 1.9])
def test_targets_share_and_stop(docs, share):
    sizes = docs.select("source", mixing.word_count(F.col("text")).alias("size"))
    t = mixing.source_targets(sizes, share).toPandas()
    assert (t.target <= 2 * t.source_size + 1e-9).all()
    assert abs(t.target.sum() - share * t.source_size.sum()) < 1e-6
    open_ = t[t.target < 2 * t.source_size - 1e-9]
    assert (open_.target / open_.weight).round(9).nunique() <= 1


def test_schedule_is_complete_and_even(spark):
    targets = spark.createDataFrame([(0, 5000.0), (1, 3000.0), (2, 17.0), (3, 0.0)], "nr int, target double")
    s = mixing.schedule(targets, 10).orderBy("slot").toPandas()
    assert s.groupby("nr")["rank"].apply(lambda r: sorted(r) == list(range(len(r)))).all()
    assert s.groupby("nr").size().to_dict() == {0: 500, 1: 300, 2: 2}
    half = s[s.slot < s.slot.max() // 2]
    assert abs((half.nr == 0).sum() - 250) < 12
    assert (s[s.nr == 0]["rank"].diff().dropna() == 1).all()


TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts_match_library(docs, corpus, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    got = token_counts.token_counts(docs, TOKENIZER, 50).toPandas().set_index("doc_id")
    for doc_id, text, *_ in corpus:
        want = len(lib.encode(text or "", add_special_tokens=False).ids)
        assert got.n_tokens[doc_id] == want and got.n_bytes[doc_id] == len((text or "").encode())
        assert got.over_limit[doc_id] == (want > 50)
    assert token_counts.token_counts(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("text", ["it's  they'll <|endoftext|> a\n\n b", "  c ² Ⅷ \x1c\x1d x 漢字 🙂 don't", "abc" * 9 + "!!?"])
def test_every_prefix_has_its_count(text):
    from tokenizers import Tokenizer

    lib, v = Tokenizer.from_file(TOKENIZER), token_counts.vocabulary(TOKENIZER)
    counts = token_counts.PrefixCounts(v, text)
    want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert [counts.at(k) for k in range(len(text) + 1)] == want
    for budget in range(max(want) + 1):
        assert counts.longest(budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_prefixes_of_random_texts_have_their_counts():
    from tokenizers import Tokenizer

    lib, v = Tokenizer.from_file(TOKENIZER), token_counts.vocabulary(TOKENIZER)
    parts = ["a", "b", "the", "  ", " ", "\n", "\t", "'s", "'re", "'", "é", "漢", "🙂", "<|endoftext|>", "1", "23", "!", "??", "\x1c", "\x85", "Z", "don't"]
    own = random.Random(1)
    for _ in range(60):
        text = "".join(own.choice(parts) for _ in range(own.randint(1, 25)))
        counts = token_counts.PrefixCounts(v, text)
        want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert [counts.at(k) for k in range(len(text) + 1)] == want
        for budget in range(max(want) + 1):
            assert counts.longest(budget) == max(k for k, n in enumerate(want) if n <= budget), (text, budget)


@pytest.mark.parametrize("unit", [" ", "x", "é", "'", " \n", " x", "漢"])
def test_token_counts_of_long_runs_are_linear(unit):
    from tokenizers import Tokenizer

    lib, v = Tokenizer.from_file(TOKENIZER), token_counts.vocabulary(TOKENIZER)
    text, began = unit * (300_000 // len(unit)) + "a", time.perf_counter()
    k = token_counts.PrefixCounts(v, text).longest(1024)
    assert time.perf_counter() - began < 20 and v.stored_bytes <= token_counts.STORED_BYTES
    tokens = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    assert tokens(text[:k]) <= 1024 < tokens(text[: k + 1])


def test_token_counts_of_repeated_and_null_rows(spark):
    got = token_counts.token_counts(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "")], "doc_id long, text string"), TOKENIZER)
    assert sorted((r.doc_id is None, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == [(False, 0, 0, False)] * 2 + [(True, 3, 2, False)] * 2


def test_substring_dedup_meets_sql(docs, corpus, empty):
    got = substring.digest(substring.remove_repeats(docs)).toPandas()
    same(got, from_sql(substring.repeats_sql(), documents=frame(corpus)))
    assert got.n_removed.sum() > 500
    spans = substring.remove_repeats(docs).toPandas().set_index("doc_id")
    for doc_id, text, *_ in corpus:
        row = spans.loc[doc_id]
        assert SPACED(row.cut) == row.kept.split(" " if row.kept else None) and (row.n_removed or row.cut == (text or ""))
        assert row.cut.count("\n") >= (text or "").count("\n") - row.n_removed
    assert substring.remove_repeats(empty).count() == 0


def test_substring_crowded_shards_and_hot_anchors(docs, corpus, monkeypatch):
    monkeypatch.setattr(substring, "PASSAGES_PER_SHARD", 1)
    monkeypatch.setattr(substring, "HOT_ROWS", 3)
    monkeypatch.setattr(substring, "HOT_SHARE", 1_000)
    same(substring.digest(substring.remove_repeats(docs)).toPandas(), from_sql(substring.repeats_sql(), documents=frame(corpus)))


def test_substring_repeated_and_null_ids(spark):
    a, b = prose(40), prose(40)
    rows = [(1, a), (1, a), (None, b), (2, b), (2, a + " " + b)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(got.n_removed) == [0, 0, 0, 40, 80]


def test_substring_many_copies_under_one_id(spark):
    """5,000 copies of a text under one id, behind a document that has it: work follows the copies."""
    a, other = prose(400), prose(30)
    docs = spark.createDataFrame([(1, a + " " + other), (2, other)], "doc_id long, text string").union(spark.range(5000).selectExpr("7L as doc_id", f"'{a}' as text"))
    began = time.time()
    got = substring.remove_repeats(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 430, 0, 1), (2, 30, 30, 1), (7, 400, 400, 5000)]
    assert time.time() - began < 60


def test_substring_of_very_long_and_null_rows(spark):
    a, long = prose(40), "same " * 60_000 + "x" * 300_000
    rows = [(1, "first line\n" + a + "\n last  line\n"), (2, "head\n" + a + "\n tail  line\n"), (3, long), (4, None), (None, "")]
    got = substring.remove_repeats(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, ord int, key int, s int")).toPandas().set_index("doc_id")
    assert got.cut[1] == rows[0][1] and got.cut[2] == "head\ntail  line\n" and got.n_removed[2] == 40
    assert got.n_removed[3] == 60_000 - 1 and got.cut[3] == "same " + "x" * 300_000 and got.n_words[4] == 0


def test_automaton_statistics_are_longest_matches():
    refs = [[rng.choice("abc") for _ in range(30)] for _ in range(4)]
    auto = substring.SuffixAutomaton()
    for r in refs:
        auto.add(r)
    query = [rng.choice("abcd") for _ in range(60)]
    inside = lambda s: any(s == r[i : i + len(s)] for r in refs for i in range(len(r)))
    want = [max(m for m in range(i + 2) if m == 0 or inside(query[i + 1 - m : i + 1])) for i in range(len(query))]
    assert auto.matching_statistics(query) == want


def labelled(n=240):
    rows, marks = [], []
    for i in range(n):
        bad, rude = i % 4 == 0, i % 5 == 0
        text = " ".join(["Junk!!!"] * 40) if bad else ". ".join(prose(9).capitalize() for _ in range(6)) + "."
        rows.append((i, text + (" you rotter and scoundrel" if rude else " friend"), "en", "s", len(text), 1, "h", 5, 6))
        marks.append((i, int(not bad), int(rude)))
    rows.append((10_000, None, None, None, None, None, None, None, None))
    rows.append((10_001, "", None, None, None, None, None, None, None))
    return rows, marks


@pytest.mark.parametrize("module, column, cut", [(quality, "quality", 0.5), (toxicity, "toxic", 0.7)])
def test_classifiers_on_held_out_rows(spark, empty, module, column, cut):
    rows, marks = labelled()
    d, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = module.digest(module.scores(d, module.train(d, labels))).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= cut) == got.predicted.astype(bool)).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert len(held) > 40 and (held.predicted == held[column]).mean() > 0.95
    none = module.train(empty, labels)
    assert module.scores(empty, none).count() == 0 and module.scores(d, none).count() == len(rows)


def test_toxicity_learns_what_only_a_pair_tells(monkeypatch):
    """Toxic if one of two terms stands in the text, but not both: no weight of one term tells."""
    own, letters = random.Random(3), "abcdefghijklmnopqrstuvwxyz"
    terms, texts, y = ["".join(own.choices(letters, k=6)) for _ in range(300)], [], []
    for _ in range(4000):
        a, b = own.random() < 0.5, own.random() < 0.5
        texts.append(" ".join(own.sample(terms, 10) + ["insult"] * a + ["folk"] * b))
        y.append(int(a != b))
    owner, bucket, x = toxicity.features(texts[:3000])
    cuts = np.searchsorted(owner, np.arange(3001))
    right = lambda m: ((m.scores(texts[3000:]) > 0.5) == np.array(y[3000:])).mean()
    model = toxicity.fit(cuts, bucket, x, np.array(y[:3000]))
    assert right(model) > 0.9
    monkeypatch.setattr(toxicity, "LINEAR_PASSES", toxicity.PASSES)
    assert right(toxicity.fit(cuts, bucket, x, np.array(y[:3000]))) < 0.6
    # The value of the machine is the sum over pairs, written out.
    k, b, v = toxicity.features(texts[:4])
    for i, score in enumerate(model.scores(texts[:4])):
        xs = v[k == i].astype(float)
        at = [int(np.flatnonzero(model.buckets == c)[0]) for c in b[k == i]]
        scale = min(1.0, toxicity.PAIR_NORM / (xs**2).sum())
        raw = model.bias + sum(model.w[p] * c for p, c in zip(at, xs))
        raw += sum(model.v[at[p]] @ model.v[at[q]] * xs[p] * xs[q] * scale for p in range(len(at)) for q in range(p))
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))


def test_toxicity_sends_the_driver_few_bytes_a_term(spark, monkeypatch):
    """The training rows reach the driver packed, the model leaves it without its look-up table, and
    it is the model of the plain terms."""
    own = random.Random(9)
    words = ["".join(own.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(3000)]
    rows = [(i, " ".join(own.choices(words, k=400) + ["insult"] * (i % 2)), "en", "s", 1, 1, "h", 5, 6) for i in range(90)]
    rows += [(90, None, *rows[0][2:]), (91, "", *rows[0][2:]), (92, "very " * 70_000, *rows[0][2:])]
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = spark.createDataFrame([(r[0], r[0] % 2, r[0] % 2) for r in rows], "doc_id long, quality int, toxic int")
    owner, bucket, x = toxicity.features([r[1] or "" for r in kept])
    got, to_arrow = [], type(d).toArrow
    monkeypatch.setattr(type(d), "toArrow", lambda self: got.append(to_arrow(self)) or got[-1])
    model = toxicity.train(d, marks)
    assert [t.num_rows for t in got] == [len(kept)] and got[0].nbytes < 4 * len(bucket)
    sent = pickle.dumps(model)
    assert len(sent) < 60 * len(model.buckets) + 1000
    want = toxicity.fit(np.searchsorted(owner, np.arange(len(kept) + 1)), bucket, x, np.array([r[0] % 2 for r in kept]))
    texts = [r[1] or "" for r in rows]
    for m in (model, pickle.loads(sent)):
        assert m.bias == want.bias and all(np.array_equal(getattr(m, k), getattr(want, k)) for k in ("buckets", "w", "v"))
        assert np.array_equal(m.scores(texts), want.scores(texts))


def test_packed_terms_come_back():
    for bucket, count in (([], []), ([0], [1]), ([5, 6, toxicity.BUCKETS - 1], [1, 70_000, 3_000_000])):
        got = toxicity.unpacked(toxicity.packed(np.array(bucket, np.int64), np.array(count, np.int64)))
        assert [a.tolist() for a in got] == [bucket, count]


def test_quality_density_by_the_formula(spark):
    """The score is the difference of two normal log-densities, computed by plain inverse and determinant."""
    rows, marks = labelled()
    model = quality.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    kept = [(r[1], m[1]) for r, m in zip(rows, marks) if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    x, y = quality.statistics([t for t, _ in kept]), np.array([q for _, q in kept])
    centre, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6))
    z = (x - centre) / scale
    pooled = sum(np.cov(z[y == c].T, bias=True) * (y == c).mean() for c in (0, 1))
    query = (quality.statistics([r[1] or "" for r in rows]) - centre) / scale
    logs = []
    for c in (0, 1):
        s = 0.9 * np.cov(z[y == c].T, bias=True) + 0.1 * pooled
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 0.01 * np.eye(len(s))
        d = query - z[y == c].mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.log(np.linalg.det(s))))
    want = 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / np.sqrt(quality.FEATURES), -30, 30)))
    assert model.scores(quality.statistics([r[1] or "" for r in rows])) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_take_repeated_null_and_very_long_rows(spark, module):
    rows, marks = labelled(60)
    rows += [rows[5], rows[5], (None, "x", *rows[5][2:]), (None, None, *rows[5][2:]), (7, "clash", *rows[5][2:]), (20_000, "word " * 200_000, *rows[5][2:]), (20_001, "x" * 1_000_000, *rows[5][2:])]
    d, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*marks, (None, 1, 1), (3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.digest(module.scores(d, module.train(d, labels))).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and not got.held_out[got.doc_id.isna()].any()
    assert got.score[got.doc_id == rows[5][0]].nunique() == 1


def test_urls_meet_sql(spark):
    urls_ = ["https://www.example.com/en/a?x#y", "http://a.EXAMPLE.com/en/1", "http://com/x", "ftp://q.net/fr/", "https://spam-farm.example.org/a", "https://x.org/cheap-pills", "https://x.org/cheapest", None, "", "no scheme", "a://b://c/d", "http://notcom/", "http://x.net?/es/", "http://h\n/é?", "https://x.org/%70OR%6E", "https://x.org/c%61sino%73", "https://x.org/hot-deals", "https://x.org/hot-deals-bonus-money", "https://x.org/%zz%6", "https://x.org/weight-loss/pills"]
    rows = [(i, u, "<p>", 1) for i, u in enumerate(urls_)] + [(3, urls_[3], None, 2)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, low int")
    got = urls.digest(urls.judge(d)).toPandas()
    same(got, from_sql(urls.judge_sql(), pages=pd.DataFrame(rows, columns=["page_id", "url", "html", "x"])))
    assert urls.judge(d.limit(0)).count() == 0
    says = {urls_[r.page_id]: r.verdict for r in got.itertuples() if pd.notna(r.page_id)}
    assert [says[f"https://x.org/{p}"] for p in ("%70OR%6E", "c%61sino%73", "hot-deals", "hot-deals-bonus-money", "%zz%6", "weight-loss/pills")] == ["block", "block", "allow", "block", "allow", "block"]


def test_merkle_edits_and_order(docs, corpus, empty, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 5)
    got = merkle.fingerprints(docs).toPandas().set_index("doc_id")
    text = {i: t or "" for i, t, *_ in corpus}
    order = sorted(text, reverse=True)
    for k, i in enumerate(order):
        nxt = text[order[(k + 1) % len(order)]]
        m = len(text[i]) // 3
        new = text[i][: len(text[i]) - m] + nxt[:m]
        row = got.loc[i]
        assert row.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and row.n_chars == len(text[i])
        assert row.fingerprint == merkle.fingerprint(text[i]) and row.edited_fingerprint == merkle.fingerprint(new)
        assert row.near_edited == pytest.approx(brute_likeness(text[i], new), abs=0.01) and row.near_next == pytest.approx(brute_likeness(text[i], nxt), abs=0.01)
        assert (row.near_next == 1) == (nxt == text[i])
    assert merkle.fingerprints(empty).count() == 0
    assert merkle.fingerprints(docs.where('doc_id = 0')).first().near_next == 1.0
    twice = merkle.fingerprints(docs.union(docs).union(docs.selectExpr("cast(null as long)", *docs.columns[1:])))
    assert twice.count() == 3 * len(corpus)


def test_merkle_branches_locate_edits():
    lines = [prose(12) + ".\n" for _ in range(40)]
    changed = [*lines[:20], "changed " + lines[20], *lines[21:]]
    a, b = merkle.fingerprint("".join(lines)), merkle.fingerprint("".join(changed))
    assert len(merkle.differences(a, b)) == 1 and 0.9 < merkle.likeness(a, b) < 1 and merkle.differences(a, a) == []


def brute_tree(text):
    """Leaves of each paragraph, paragraphs of each section, by splitting."""
    sections, section = [], []
    leaves = re.findall(r"[^.!?;|\n]{1,48}[.!?;|\n]*|[.!?;|\n]+", text)
    hashes = [f"{xxhash.xxh32_intdigest(x.encode()):08x}" for x in leaves]
    paragraph = []
    for k, x in enumerate(leaves):
        paragraph.append(hashes[k])
        if x[-1] == "\n" or k == len(leaves) - 1:
            section.append(tuple(paragraph))
            ends = x[-1] == "\n" and xxhash.xxh32_intdigest("".join(paragraph)) % 4 == 0
            paragraph = []
            if ends or k == len(leaves) - 1:
                sections.append(tuple(section))
                section = []
    return sections


def brute_likeness(a, b):
    if a == b:
        return 1.0
    x, y = brute_tree(a), brute_tree(b)
    count = lambda t: sum(len(p) for s in t for p in s)
    total, common = count(x) + count(y), 0
    for level in range(3):
        weigh = (lambda s: sum(map(len, s)), len, lambda leaf: 1)[level]
        x_left = list(x)
        y_left = []
        for node in y:
            if node in x_left:
                x_left.remove(node)
                common += weigh(node)
            else:
                y_left.append(node)
        x, y = x_left, y_left
        if level < 2:
            x, y = ([inner for node in t for inner in node] for t in (x, y))
    return 2 * common / total if total else 0.0


def test_merkle_likeness_by_the_tree():
    lines = [prose(own) + e for own, e in zip(rng.choices(range(1, 25), k=60), rng.choices([".\n", "\n", "; ", "!\n"], k=60))]
    texts = ["".join(lines[:k] + lines[j:]) for k, j in ((60, 60), (10, 30), (30, 10), (0, 5), (5, 40))] + ["", "a", "\n\n", "".join(lines[::-1])]
    for a in texts:
        for b in texts:
            assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) == pytest.approx(brute_likeness(a, b), abs=0.01)


def test_merkle_unrelated_long_texts_are_unlike():
    words = [f"{chr(97 + i % 26)}{i}" for i in range(5000)]
    a, b = ("".join(" ".join(r.choices(words, k=5)) + ". " for _ in range(100_000)) for r in (random.Random(1), random.Random(2)))
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) < 0.001


def test_merkle_equal_nodes_are_not_descended_into():
    """A node's hash decides: what stands below equal nodes is never looked at."""
    a = merkle.fingerprint("".join(prose(12) + ".\n" for _ in range(40)))
    root, _, tree = a.partition(":")
    sections = tree.split("/")
    sections[0] = sections[0][: merkle.NODE + 1] + re.sub("[^,]", "0", sections[0][merkle.NODE + 1 :])
    b = "0" * 32 + ":" + "/".join(sections)
    assert len(sections) > 2 and merkle.likeness(a, b) == 1.0 and merkle.differences(a, b) == []
    sections[0] = "0" * merkle.NODE + sections[0][merkle.NODE :]
    assert merkle.likeness(a, "0" * 32 + ":" + "/".join(sections)) < 1.0


def test_merkle_splits_hot_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 5)
    rows = [(7, f"seven {i}") for i in range(40)] + [(None, f"none {i}") for i in range(40)] + [(i, f"row {i}") for i in range(20)] + [(None, None), (3, "x" * 300_000), (3, "x" * 300_000)]
    got = merkle.fingerprints(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bucket int, h int")).toPandas()
    assert len(got) == len(rows) and sorted(got.n_chars) == sorted(len(t or "") for _, t in rows)
    nexts = {hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest() for _, t in rows if t for _, u in rows for u in [u or ""]}
    assert got[got.n_chars > 0].edited_sha256.isin(nexts).all()
    whole = [(r.doc_id, r.fingerprint) for r in got.itertuples()]
    assert len(set(whole)) == len({(i, t or "") for i, t in rows})


def brute_fingerprint(text):
    w = SPACED(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    low = dict(enumerate(range(len(fps))))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= 4 and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


def test_simhash_groups(docs, corpus, empty):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fp"), "component_id").toPandas().set_index("doc_id")
    fps = [brute_fingerprint(t) for _, t, *_ in corpus]
    low = brute_components(fps)
    for i, (doc_id, *_) in enumerate(corpus):
        assert int(got.fp[doc_id], 16) == fps[i] and got.component_id[doc_id] == 3 * low[i]
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("text", ["a\x00b c d e f g", "\x00 one two three four five", "x " * 9 + "\x00\x00 y\x00 the end of it", "é\x00 " * 7 + "Z"])
def test_simhash_words_may_hold_nul(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("bits, at_a_time", [(8, 1 << 22), (2, 1 << 22), (13, 1 << 22), (8, 64)])
def test_simhash_ball_hashing_finds_every_link(spark, monkeypatch, bits, at_a_time):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "VARIANTS_AT_A_TIME", at_a_time)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), k)) for s in seeds for k in (0, 1, 2, 3, 4, 4, 5)} | {0, 1, 31, 2**63}
    fps = sorted(fps)
    batch = pa.RecordBatch.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64))], names=["fp"])
    dealt = pa.Table.from_batches(simhash._deal(bits)([batch])).sort_by("bucket")
    assert sum(len(x) for x in dealt.column("fps")) == len(fps) * (1 + bits + bits * (bits - 1) // 2)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for links in simhash._bucket_links(bits)(dealt.to_batches(7)):
        for x, y in zip(*(links.column(c).to_numpy().view(np.uint64).tolist() for c in "uv")):
            parent[find(x)] = find(y)
    low = brute_components(fps)
    assert {frozenset(i for i in low if low[i] == r) for r in low.values()} == {frozenset(i for i, f in enumerate(fps) if find(f) == g) for g in map(find, fps)}


def test_simhash_buckets_grow_evenly():
    assert [simhash.bucket_bits(n) for n in (0, 1, 10**6, 10**7, 10**9, 10**11)] == [8, 8, 8, 12, 18, 25]
    assert [len(simhash._steps(k)) for k in (8, 12, 18, 25)] == [37, 79, 172, 326]


def test_simhash_repeated_null_and_very_long_rows(spark):
    long = "alpha beta gamma delta " * 100_000
    rows = [(9, long), (9, long), (None, long.upper()), (4, None), (None, ""), (None, "only null ids here"), (None, "only null ids here"), (3, "x" * 1_000_000)]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, root int")).toPandas()
    assert len(got) == len(rows) and set(got.fp[got.doc_id == 9]) == {np.uint64(brute_fingerprint(long[:92000])).view(np.int64)}
    assert sorted(got.component_id.fillna(-1)) == [-1, -1, 3, 4, 4, 9, 9, 9]


def test_licenses_base_and_fuzzy(spark, docs, empty):
    rows = [(1, "Released under the MIT-License. (MIT license)"), (2, "Licensd under the Apache Licence, Version 2.0"), (3, "gnu general public license gnu general public license"), (4, None), (5, "plain"), (6, "permission is hereby granted, free of charg, to any person obtainin a copy"), (7, "CC BY by cc BY")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.n_base.to_dict() == {1: 2, 2: 0, 3: 2, 4: 0, 5: 0, 6: 0, 7: 2}
    assert got.first_word[1] == 3 and got.last_word[1] == 5 and got.last_word[3] == 4 and pd.isna(got.first_word[5])
    assert got.base_labels.to_dict() == {1: "mit", 2: "", 3: "gpl", 4: "", 5: "", 6: "", 7: "cc-by"}
    assert "apache-2.0" in got.labels[2] and "mit-notice" in got.labels[6] and got.labels[5] == "" and got.score[5] == 0 and got.score[1] == 1
    note = got.notices[2][0]
    assert rows[1][1][note["start"] : note["stop"]].startswith("Licensd") and note["edits"] == 2
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(empty).count() == 0


def test_licenses_adjacent_and_repeated_notices():
    gpl, bsd = "licensed under the gnu general public license version", "redistribution and use in source and binary forms"
    scan = lambda text: [(f["label"], f["edits"], f["first"], f["last"]) for f in licenses.Scanner().scan(text.split())[1]]
    assert sorted(scan(f"{gpl} 3 {gpl} 2")) == [("gpl-2.0", 0, 9, 17), ("gpl-3.0", 0, 0, 8)]
    assert sorted(scan(f"{gpl} 2 {gpl} 3 {gpl} 2")) == [("gpl-2.0", 0, 0, 8), ("gpl-2.0", 0, 18, 26), ("gpl-3.0", 0, 9, 17)]
    assert scan(" ".join([bsd] * 7)) == [("bsd", 0, 8 * i, 8 * i + 7) for i in range(7)]
    assert scan(f"{bsd[:-3]} {bsd} x{bsd[2:]} {bsd}") == [("bsd", e, 8 * i, 8 * i + 7) for i, e in enumerate((3, 0, 2, 0))]
    assert len(scan(" ".join([bsd, bsd.replace("source", "sourse")] * 400))) == 800


def test_decontamination_meets_sql(spark, docs, corpus, empty):
    long = corpus[0][1].split()
    items = [(1, " ".join(long[30:60])), (2, "One"), (3, corpus[2][1].upper()), (10, None), (4, ""), (None, "x"), (11, " ".join(long[5:17]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.contamination(docs, bench)).toPandas()
    want = from_sql(decontaminate.contamination_sql(), documents=frame(corpus), benchmark=pd.DataFrame([i for i in items if i[0] is not None], columns=["item_id", "text"]).astype({"item_id": "int64"}))
    same(got, want)
    assert got.contaminated.sum() >= 3
    blocks = decontaminate.digest(decontaminate.contamination(docs, bench, block_chars=100)).toPandas()
    same(blocks, want)
    assert not decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() and decontaminate.contamination(empty, bench).count() == 0
    row = decontaminate.contamination(docs, bench).where("doc_id = 0").first()
    assert corpus[0][1][row.spans[0].start : row.spans[0].stop].split()[0] == long[row.hits[0]]


@pytest.mark.parametrize("block_chars", [decontaminate.AUTOMATON_CHARS, 100])
def test_decontamination_by_items_without_id(spark, docs, corpus, block_chars):
    long = corpus[0][1].split()
    items = [(None, " ".join(long[30:60])), (None, "One"), (1, " ".join(long[50:70])), (None, None)]
    got = decontaminate.digest(decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars)).toPandas()
    same(got, from_sql(decontaminate.contamination_sql(), documents=frame(corpus), benchmark=pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"})))
    assert (got.contaminated & (got.n_items == 0)).any()


def test_decontamination_scan_against_all_windows():
    """Texts of few words repeat in every way; windows are compared one by one."""
    own = random.Random(9)
    for _ in range(60):
        items = [(str(k), " ".join(own.choices("abc", weights=(8, 1, 1), k=own.choice([1, 5, 12, 13, 14, 21, 22, 40])))) for k in range(6)]
        words = own.choices("abc", weights=(8, 1, 1), k=60) + items[0][1].split() + ["z"] + items[1][1].split()
        hit, found = decontaminate.Automaton(items).scan(words)
        want, names = np.zeros(len(words), bool), set()
        for name, text in items:
            w = text.split()
            n = min(13, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    want[i : i + n] = True
                    names.add(int(name))
        assert (hit == want).all() and found == names


def test_decontamination_of_repeated_null_and_very_long_rows(spark):
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(1, item), (1, item), (None, item), (None, None), (2, ""), (3, "same " * 100_000), (4, "x" * 1_000_000)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n_words int, hits string")
    bench = spark.createDataFrame([("a", item), ("a", item), ("b", "same " * 300), (None, None)], "item_id string, text string")
    began = time.perf_counter()
    got = decontaminate.digest(decontaminate.contamination(docs, bench)).collect()
    assert time.perf_counter() - began < 60
    assert sorted((r.doc_id or 0, r.n_hit, r.n_items, r.contaminated) for r in got) == sorted([(1, 30, 1, True)] * 2 + [(0, 30, 1, True), (0, 0, 0, False), (2, 0, 0, False), (3, 100_000, 1, True), (4, 0, 0, False)])


def brute_base(text):
    """Places of base phrases by comparing words one by one."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_licenses_base_columns_by_brute_force(spark):
    own = random.Random(8)
    parts = ["GNU", "General", "public", "license", "Apache", "CC", "by", "mit", "the", "gnu general public license", "MIT License", "cc-BY", "é", "\x00", "x\x0by", ".", "\n", "Licence"]
    rows = [(i if i % 5 else None, own.choice([" ", "-", ", "]).join(own.choices(parts, k=own.randint(0, 40)))) for i in range(80)]
    rows += [(1, None), (1, ""), (2, rows[3][1]), (2, rows[3][1]), (None, "mit license " * 20_000), (3, "x" * 1_000_000)]
    d = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n_words int, labels string")
    began = time.perf_counter()
    got = licenses.digest(licenses.scan_licenses(d)).collect()
    assert time.perf_counter() - began < 90
    some = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(some((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(some((i, *brute_base(t))) for i, t in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_urls_of_repeated_null_and_very_long_rows(spark):
    rows = [(None, "https://a.net/fr/x"), (None, "https://a.net/fr/x"), (1, None), (1, None), (2, "https://h.org/" + "a" * 500_000 + "/casino"), (3, "casino"), (4, "https://h.org/free\x00win")]
    got = urls.judge(spark.createDataFrame([(*r, "r") for r in rows], "page_id long, url string, rule string")).collect()
    assert sorted((r.page_id or 0, r.rule or "", r.verdict) for r in got) == [(0, "net/fr/", "block")] * 2 + [(1, "", "allow")] * 2 + [(2, "", "block"), (3, "", "block"), (4, "", "block")]


def test_stock_phrases_and_repeated_words_take_no_longer():
    """20,000 items with one opening against 200 places of it; one word over and over; copies of short items."""
    opening = "which of the following statements is true about"
    items = [(str(i), f"{opening} thing{i} " + " ".join(f"w{(i * k) % 97}" for k in range(12))) for i in range(20_000)] + [(f"s{i}", "just a short item") for i in range(5000)]
    auto = decontaminate.Automaton(items)
    words = []
    for k in range(200):
        words += items[k * 100][1].split()[: 13 if k % 2 else 12] + [f"x{k}"] + ["just", "a", "short", "item"] * (k % 3)
    began = time.time()
    hit, found = auto.scan(words)
    assert time.time() - began < 2
    names = {auto.ids[k] for k in found}
    assert names == {str(k * 100) for k in range(1, 200, 2)} | {f"s{i}" for i in range(5000)} and hit.sum() == 100 * 13 + 4 * sum(k % 3 for k in range(200))
    auto = decontaminate.Automaton([("a", "same " * 1000), ("b", "same " * 12 + "end")])
    began = time.time()
    hit, found = auto.scan(["same"] * 20_000 + ["end"])
    assert time.time() - began < 2 and hit.all() and {auto.ids[k] for k in found} == {"a", "b"}
    assert not auto.scan(["same"] * 12)[0].any()
