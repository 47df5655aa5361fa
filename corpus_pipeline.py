"""A cleaning pipeline over ``documents``: STAGES applied one after the other, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and, but
for the last, returns the columns of its input, whatever their names.  Each row is judged by its
own text: ids only say which of several copies stays (the smallest; null last), so a row that
shares its id with another text is not touched by that one's fate, and neither is a null id.  Of
rows that repeat id and text one stays, chosen by a hash of all columns.  Null and empty texts
are copies of each other, else they stay.  Very long texts are read whole.  Empty tables stay
empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, exact_dedup, jaccard_regions, latent_leaks, weak_toxicity
from factloom.llm.common import stage, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    model = weak_toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return weak_toxicity.without_toxic(docs, model)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, with the smallest doc_id."""
    return exact_dedup.without_copies(docs, keep="smallest")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the one with the smallest doc_id stays."""
    return jaccard_regions.without_near_copies(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return latent_leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of what is left."""
    return bpe.encode_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("bpe", encode)]

#: Toxicity, near duplicates and latent retrieval cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
