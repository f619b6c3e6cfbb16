"""Registered queries of the corpus operators: production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept",
                                                                    "text_sha256")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"), shingle=4, max_bits=4).drop("row_key")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, identify, train

    docs = load(spark, sf_dir, "documents")
    found = identify(docs, train(docs), spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    from .packing import default_added, default_vocabulary, pack

    return pack(load(spark, sf_dir, "documents"), default_vocabulary(), PATTERN, with_ids=False, added=default_added())


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    from .bpe_codec import default_vocabulary, encode_decode

    return encode_decode(load(spark, sf_dir, "documents"), default_vocabulary(), PATTERN, keep=False)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(load(spark, sf_dir, "documents"), words=13, with_text=False)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(load(spark, sf_dir, "documents"), length=400, with_text=False)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    from .token_counts import default_vocabulary, token_counts

    return token_counts(load(spark, sf_dir, "documents"), default_vocabulary(), PATTERN)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(load(spark, sf_dir, "embeddings"), k=20, query_step=20)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import grade, graded_labels, train

    docs = load(spark, sf_dir, "documents")
    rated = docs.select("doc_id", "text").join(graded_labels(load(spark, sf_dir, "labels")), "doc_id")
    return grade(docs, train(rated))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_overlap

    found = find_overlap(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import integer_vectors, mine

    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = integer_vectors(load(spark, sf_dir, "embeddings"), label=noisy)
    return mine(rows, F.col("id") % 100 == 0, positives=5, negatives=5, low_share=80, high_share=100)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants, word_counts

    return spelling_variants(word_counts(load(spark, sf_dir, "documents"), slip=97, min_length=5, min_count=3), factor=2)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_nearest, op4_quality, op5_simhash_dedup,
                                   op6_language_id, op7_packing, op8_substring_dedup, op9_suffix_dedup,
                                   op10_bpe_codec, op11_decontaminate, op12_hard_negatives,
                                   op13_spelling)}
