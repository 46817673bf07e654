"""Corpus pipeline over ``documents``: quality, near duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but
the last return the columns of ``documents``. ``run`` writes each stage's rows to the shared
folder and reads them again.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from strandframe.llm import mixing, packing, quality, shingle_join, suffix  # noqa: E402
from strandframe.llm.common import modest_batches  # noqa: E402
from strandframe.llm.queries import QUERIES as OPERATORS  # noqa: E402
from strandframe.llm.queries import SQL  # noqa: E402, F401
from strandframe.session import materialize  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the robust outlier test rejects go."""
    modest_batches(spark)
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles, the one of the smallest id stays."""
    modest_batches(spark)
    return shingle_join.one_of_each(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes stay where they stand first."""
    modest_batches(spark)
    return suffix.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; documents repeat as often as the mix takes them."""
    modest_batches(spark)
    return mixing.mixed_copies(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    modest_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

#: No SQL: robust estimates, hash sketches and tokens are beyond it; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


QUERIES = OPERATORS | {"pipeline": pipeline}
