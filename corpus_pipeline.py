"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns the columns of
documents (the last one returns pieces of packed sequences). ``run`` writes what a stage returns to the shared folder and
reads it again, so that a lost executor never costs more than one stage.

Defined results: an empty table stays empty through all stages; documents with null text are kept (as non-toxic, linked
with nothing, uncontaminated) and packed as their end id; rows with a null id are kept by the first, third and fourth
stage, and by the second, too, as they link with nothing; columns other than doc_id and text pass through unchanged, and
``n_chars`` follows the text where secrets were replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huegrid.llm import decontamination, near_join, packing, secrets, toxicity
from huegrid.llm.common import clear_columns, table, written


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel classifier rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = clear_columns(docs, ())
    return toxicity.with_score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id (and hash of its text) stays, once if its row is repeated."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text"))
    named = docs.where("doc_id IS NOT NULL").select(key.alias("key"), F.struct("*").alias("row"))
    groups = near_join.jaccard_groups(named.select(F.col("key").alias("doc_id"), "row.text"), n=3, percent=90)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    rows = named.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
    return rows.union(docs.where("doc_id IS NULL"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    name = clear_columns(docs, ())
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(name), "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark."""
    out = secrets.redacted(docs, *secrets.model_of(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return packing.packed(docs, added_tokens=True)


STAGES = [
    ("toxicity", non_toxic),
    ("ngram_jaccard_join", distinct),
    ("benchmark_decontamination", uncontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Learned and sampled stages can't be stated in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
