"""The registered query of each corpus operator, and its SQL where SQL can express it.

Each query applies its operator to its whole table and derives the columns asked for from what
the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import ann, bpe, licenses, mixing, quality, secrets, sharding, simhash, sql, tokens, toxicity
from terrafold.llm.common import documents, table

#: op2: every row whose id is divisible by this is a query.
QUERY_EVERY, K = 100, 10


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = licenses.scan(documents(spark, sf_dir))
    return df.select("doc_id", "license", F.round("dice", 9).alias("dice"), "n_lines", "licenses")


def op2_ann_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, K)


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(documents(spark, sf_dir))


def op6_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return df.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.verdicts(documents(spark, sf_dir))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op9_bpe_speculative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_license_scan, op2_ann_prefix_forest, op3_secret_ownership, op4_simhash_near_dedup, op5_token_output,
        op6_toxicity_crf, op7_quality_rules, op8_label_propagation_shards, op9_bpe_speculative, op10_pfair_mix,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": sql.licenses(), "op7_quality_rules": sql.quality()}
