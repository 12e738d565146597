"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again.

quality classifier -> SimHash near-dedup -> benchmark decontamination -> mixing to target weights -> token shards. All but the
last return the columns of documents; a stage's decisions are rows kept, dropped or (mixing) repeated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabshift.llm import decontaminate, mixing, quality, simhash, tokens
from tabshift.llm.common import staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker, fitted on the labels, accepts."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Shingles have five words, and texts whose shingle sets are alike to 0.8 or more belong together.
    """
    return simhash.deduplicated(docs, similarity=0.8, distance=4, width=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sorted-string-table shards, read back: (doc_id, start, n_tokens, ids_crc32)."""
    return tokens.read_shards(tokens.write_shards(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token shards", token_stage),
]

#: Learned weights, XXH64 and a tokenizer can't be said in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
