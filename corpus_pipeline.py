"""Corpus pipeline: language, exact copies, near copies, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the
next one's input.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdrift.llm import exact_dedup, language_id, packing, simhash_dedup, suffix_dedup
from graphdrift.llm.common import load, staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the corpus itself teaches; those without one go."""
    return language_id.in_known_language(docs, language_id.train(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the one with the largest id."""
    return exact_dedup.kept_documents(spark, docs)


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of 4-word shingles at most 4 bits apart."""
    return simhash_dedup.one_of_each(docs, shingle=4, max_bits=4)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 400 or more that occur more than once."""
    out = suffix_dedup.stripped(docs, length=400)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 2048 tokens: one row per piece of a document, with its ids."""
    from public_tokenizers import PATTERN

    return packing.pack(docs, packing.default_vocabulary(), PATTERN, added=packing.default_added())


STAGES = [
    ("language ID", known_language),
    ("exact dedup", distinct_texts),
    ("SimHash near-dedup", distinct_fingerprints),
    ("suffix-array dedup", without_repeats),
    ("packing", packed),
]

#: Language scores, fingerprint links and packing plans are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
