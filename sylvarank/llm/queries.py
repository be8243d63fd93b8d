"""The registered queries of this subpackage: thin wrappers around its operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cdc import repeated_passages
from .common import remainder, stage, table
from .decontam import contaminated
from .jaccard import jaccard_components
from .langid import learn_languages, predict_languages
from .media import media_features, store_texts
from .packing import pack
from .sharding import kd_shards
from .tokens import token_histogram
from .toxicity import learn_toxicity, score_toxicity
from .warc import page_records, read_warc, write_warc


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies; ``SYLVARANK_TOKENIZERS`` overrides the folder."""
    folder = os.environ.get("SYLVARANK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_histogram(table(spark, sf_dir, "documents"), vocabulary())


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=4096, end_id=1)


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(read_warc(write_warc(table(spark, sf_dir, "pages"))))


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(stage(store_texts(table(spark, sf_dir, "documents")), "media"))


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs, remainder("doc_id", 4) != 2)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return predict_languages(docs, model).select("doc_id", held_out, "lang_pred", "score", "languages", "mixture")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = learn_toxicity(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score_toxicity(docs, net).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "windows")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), percent=75)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_warc_archives": op3_warc_archives,
    "op4_jpeg_media": op4_jpeg_media,
    "op5_kd_sharding": op5_kd_sharding,
    "op6_language_mixture": op6_language_mixture,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE: dict[str, str] = {
    "op3_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS top FROM k WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, k.payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM k LEFT JOIN g ON k.payload_digest = g.payload_digest""",
}
