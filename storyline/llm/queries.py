"""The checked query of each operator, applied to its whole table.

A query only names its table and parameters and derives the columns it returns.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import sql
from .collocations import mine_phrases
from .decontamination import find_leaks
from .fingerprints import edited_fingerprints
from .jaccard import jaccard_classes
from .language_model import score_texts, train
from .packing import pack_documents
from .prefix_trie import identified_turns, prefix_trie, swapped_heads
from .quality import classified, learn_quality
from .site_trees import with_main_text
from .suffixes import remove_repeated_bytes
from .superkmers import remove_repeated_words
from .token_ids import check_sums, token_folder, write_token_files
from .toxicity import learn_toxicity, with_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    ORACLES.update({fn.__name__: sql.SQL[fn.__name__]} if fn.__name__ in sql.SQL else {})
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_fingerprints(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"), eligible=fold != 0)
    return with_toxicity(docs, model, out="score").select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_jaccard_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


@query
def op2_suffix_array(spark, sf_dir):
    return remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"),
        F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


@query
def op3_super_kmers(spark, sf_dir):
    return remove_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"),
        F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op1_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_best_fit(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op4_token_ids(spark, sf_dir):
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                              token_folder(spark))
    return check_sums(files)


@query
def op6_language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    model = train(docs.filter(F.coalesce(~held_out, F.lit(True))))
    return score_texts(docs, model).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op5_quality(spark, sf_dir):
    """The documents kept, with their perplexity."""
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return classified(docs, learn_quality(docs, trusted)).filter("__keep").select(
        "doc_id", "lang", F.col("__perplexity").alias("perplexity"), F.col("__keep").alias("keep"))


@query
def op12_collocations(spark, sf_dir):
    return mine_phrases(table(spark, sf_dir, "documents"), 2000)


@query
def op13_prefix_trie(spark, sf_dir):
    turns, turnless = swapped_heads(identified_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie(turns, turnless)


@query
def op11_site_trees(spark, sf_dir):
    return with_main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
