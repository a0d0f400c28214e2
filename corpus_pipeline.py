"""A cleaning pipeline over ``documents``: five stages, each one operator of ``storyline.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns of ``docs``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from storyline.llm.decontamination import without_leaks
from storyline.llm.jaccard import keep_one_of_each
from storyline.llm.packing import pack_documents
from storyline.llm.suffixes import remove_repeated_bytes
from storyline.llm.toxicity import learn_toxicity, with_toxicity
from storyline.session import cut_lineage

# A passage of over 50 words has at least this many bytes.
PASSAGE_BYTES = 200


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score under one half."""
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_toxicity(docs, model, out="__toxicity").filter("__toxicity < 0.5").drop("__toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur more than once; rows of which nothing is left go."""
    cut = remove_repeated_bytes(docs, length=PASSAGE_BYTES, as_text=True)
    kept = cut.filter((F.col("__n_removed") == 0) | F.col("__kept").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col("__n_removed") > 0
    new = {"text": F.when(changed, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col("n_chars"))
    return kept.withColumns(new).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages of benchmark items."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in training sequences."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit),
]

# The stages are no SQL: tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
