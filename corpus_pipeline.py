"""The corpus pipeline: rules, near-duplicates, secrets, mixture, encoding.

Every stage takes all rows that the stage before it kept, read back from Parquet in the shared
folder, so a lost executor or a restart of a stage never reaches behind that stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import bpe, mixing, quality, secrets, simhash
from terrafold.llm.common import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.survivors(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked in the text; widely copied examples stay."""
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources start over until all shares meet their target; rows in stream order."""
    return mixing.mixed_table(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed stream's documents as token ids, by their digests."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", bpe_encode),
]
#: XXH64 fingerprints and BPE have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of ``sf_dir``: a row for each document of the mixed stream.

    Null and empty texts go in the first stage. Of repeated rows one stays. Null ids and sources are kept as such; of near-duplicates
    the smallest id stays, a null one only where there is no other. An empty table gives an empty result. Columns besides those of
    documents pass through all stages but the last.
    """
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i}")
    return docs
