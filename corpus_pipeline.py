"""The corpus pipeline: toxic documents go, near-duplicate groups keep one document,
repeated passages are cut, documents that hold benchmark items go, and the rest is packed.

Each stage takes what its predecessor kept and, but for the last, returns the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvarank.llm.cdc import drop_repeats
from sylvarank.llm.common import new_folder, remainder, table, without_ids
from sylvarank.llm.decontam import drop_contaminated
from sylvarank.llm.jaccard import jaccard_components
from sylvarank.llm.packing import pack
from sylvarank.llm.queries import vocabulary
from sylvarank.llm.toxicity import drop_toxic, learn_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5; the network learns from the labelled rows of the fit folds.

    Each row is judged by its own text, so of rows that share an id only the toxic ones go.
    """
    return drop_toxic(docs, learn_toxicity(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows without an id stay; rows that share an id are one document and stay or go together.
    """
    return without_ids(docs, jaccard_components(docs, percent=75).where("component_id < doc_id").select("doc_id"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut, row by row; ``n_chars`` follows the text."""
    cut = drop_repeats(docs)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, edited copies included; rows without an id stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their places in sequences of 4096 tokens."""
    return pack(docs, vocabulary(), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: A trained network and alignments are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
