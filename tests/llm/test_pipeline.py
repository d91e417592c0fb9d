"""The pipeline against the same stages by SQL and brute force, and its contract."""

import re

import duckdb
import pandas as pd
import pytest
from conftest import SF
from test_operators_llm import brute_components, brute_fingerprint

import __spark_entry__
import corpus_pipeline
from voxelake.llm import decontaminate, mixing, toxicity


def sql(query, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return con.sql(query).df()


def brute_cut(texts):
    """Texts in order of their ids without words of windows that start earlier; how many went."""
    first, out, gone = {}, [], []
    for k, text in enumerate(texts):
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        words, cover = [m[0] for m in found], set()
        for i in range(len(words) - 19):
            if first.setdefault(tuple(words[i : i + 20]), (k, i)) != (k, i):
                cover |= set(range(i, i + 20))
        ends = [m.start() for m in found[1:]] + [len(text or "")]
        lead = text[: found[0].start()] if found else text
        out.append(lead + "".join(text[m.start() : e] for j, (m, e) in enumerate(zip(found, ends)) if j not in cover) if cover else text)
        gone.append(len(cover))
    return out, gone


def test_pipeline_meets_brute_force(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = raw.toPandas()
    score = toxicity.scores(raw, toxicity.train(raw, labels)).toPandas().set_index("doc_id").score
    docs = docs[docs.doc_id.map(score) < toxicity.REJECT].sort_values("doc_id").reset_index(drop=True)
    low = brute_components([brute_fingerprint(t) for t in docs.text])
    docs = docs[[low[i] == i for i in range(len(docs))]]
    texts, gone = brute_cut(docs.text)
    docs["text"] = texts
    bad = sql(decontaminate.contamination_sql(), documents=docs, benchmark=pd.read_parquet(f"{SF}/benchmark.parquet"))
    docs = docs[docs.doc_id.map(bad.set_index("doc_id").contaminated) == False]  # noqa: E712
    want = sql(mixing.taken_sql(), documents=docs).sort_values("doc_id").reset_index(drop=True)
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert len(got) < 200 and any(gone)
    pd.testing.assert_frame_equal(got[sorted(want)], want[sorted(want)], check_dtype=False)


def test_contract():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and "pipeline" in __spark_entry__.queries()
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_take_empty_tables(spark, stage):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, raw.where("false"), SF)
    assert out.columns == raw.columns and out.count() == 0


def test_odd_rows_pass_every_stage(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", None, 0, 1), (1, "", "en", None, 0, 1), (2, None, None, "a", None, 1), (3, "word " * 400, "en", "a", 2000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.columns == corpus_pipeline.COLUMNS
    assert 1 <= corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() <= 4


def test_near_duplicates_keep_one_row_of_each_group(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    apart = [(None, text["a"]), (None, text["b"]), (1, text["c"]), (1, text["d"]), (2, text["e"])]
    gone = [(None, text["e"]), (3, text["d"]), (None, text["b"].upper())]
    again = [(1, text["c"]), (None, text["a"]), (None, text["a"])]
    rows = [(i, t, "en", None, 0) for i, t in [*gone, *apart, *again, (None, None), (5, ""), (4, None)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.repartition(5)):
        out = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, part.select("*"), SF).collect()]
        b = [r for r in out if r in ((None, text["b"]), (None, text["b"].upper()))]
        assert len(b) == 1
        assert sorted(map(str, set(out) - set(b))) == sorted(map(str, [*(r for r in apart if r[1] != text["b"]), (4, None)])) and len(out) == 6
    one = docs.where("doc_id is null and text is not null")
    assert corpus_pipeline.drop_near_duplicates(spark, one, SF).count() == 3
