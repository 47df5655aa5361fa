"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroid_language, exact_dedup, jaccard_regions, latent_leaks, oracles, pairwise_quality, rans_tokens, token_counts, url_rules, weak_toxicity
from .common import fresh_path, held_out, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache begins empty here, so every distinct text is encoded; later calls of the operator would reuse it."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-cache")).drop("digest")


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    model = pairwise_quality.fit(docs, table(spark, sf_dir, "labels"), ~out)
    return pairwise_quality.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op5_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_regions.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


#: The rules of the query.
URL_RULES = [url_rules.Rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = centroid_language.fit(docs.select("doc_id", "text", "lang"), ~out)
    return centroid_language.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with a benchmark passage and each such item."""
    return latent_leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    model = weak_toxicity.fit(docs, table(spark, sf_dir, "labels"), ~out)
    return weak_toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_rans_tokens, op3_exact_dedup, op4_pairwise_quality, op5_jaccard_regions, op6_url_rules, op7_centroid_language, op8_latent_leaks, op9_weak_toxicity, op10_bpe)}

ORACLES = {
    "op3_exact_dedup": oracles.EXACT_DEDUP,
    "op5_jaccard_regions": oracles.JACCARD_COMPONENTS,
    "op6_url_rules": oracles.url_rules([tuple(r) for r in URL_RULES]),
}
