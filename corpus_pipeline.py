"""From raw documents to a training mix, as stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next stage's ``docs``; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.llm import decontaminate, mixing, simhash, substring, toxicity
from voxelake.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go.  It learns from the labelled rows.

    Null and empty texts have no terms and get the model's bias; without labels of both
    classes all rows are judged alike.  Repeated rows are judged alike, null ids like any."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scores(docs, model, COLUMNS).where(F.col("score") < toxicity.REJECT).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each SimHash component: of smallest id (null last), then of least digest
    of its columns.  Rows equal in all columns are one row.  Null and empty texts are one
    component, as they have the same fingerprint."""
    digest = F.unhex(F.sha2(F.concat_ws(",", *[F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in COLUMNS]), 256))
    groups = staged(simhash.near_duplicates(docs, {"digest": digest}).select("doc_id", "digest", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest"))
    kept = groups.groupBy("root").agg(first.alias("first")).select("first.digest")
    rows = docs.select(*COLUMNS, digest.alias("digest"))
    if not groups.groupBy("digest").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["digest"])
    return rows.join(kept, "digest", "left_semi").select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that also start earlier go, each with the white space behind it; lines and
    all else of the text stay as they are.  No row goes: null texts stay null, empty and short
    texts stay, and rows of equal id do not count as earlier than each other."""
    kept = substring.remove_repeats(docs, COLUMNS)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("cut"))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("cut").cast("long"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go.  Null and empty texts
    have no words and stay, as do all rows where the benchmark is empty."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COLUMNS)
    return found.where(~F.col("contaminated")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the training mix takes of each document, one row for each of ``docs``.  Null and empty
    texts have no words, so nothing is taken of them; a null source is a source."""
    return mixing.taken(mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
]

#: The toxicity model and XXH64 are beyond SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
