"""A training-corpus pipeline over ``documents``.

quality rules -> line dedup -> n-gram Jaccard join -> mixing -> packing. Every
stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages docs is
written as Parquet and read again. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadgrain.llm import line_dedup, mixing, ngram_join, packing, quality
from roadgrain.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.filter_quality(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that match across the corpus the first stays; emptied documents go."""
    return line_dedup.dedup_lines(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return ngram_join.keep_one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, shuffled. Sources without a
    weight keep each document once."""
    return mixing.mix_sources(docs, mixing.WEIGHTS, keep_unweighted=True).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents in windows of 4096 tokens, with a checksum of each piece's ids."""
    return packing.packed_digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_ngrams),
    ("mixing", mix),
    ("packing", pack),
]
#: The tokenizer and the quality rules' verdict are outside SQL; tests/llm compares
#: the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
