"""From raw documents to token ids, in five stages over written tables.

Each stage takes the documents its predecessor kept and returns those it keeps, with the columns
of ``documents``; the last one returns the tokens of each. A table that lacks rows passes through
as an empty one; rows with a null text go at the first stage, which finds no words to rate.
"""

from __future__ import annotations

import sys
from pathlib import Path

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

import loomset  # noqa: E402
from loomset.llm import bpe, decontaminate, near_duplicates, quality, toxicity  # noqa: E402
from loomset.session import shared_path  # noqa: E402

# Python workers need not have the package installed.
cloudpickle.register_pickle_by_value(loomset)

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that likely reach a grade above the lowest."""
    model = quality.fit_quality(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return quality.select_quality(docs, model)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return toxicity.select_civil(docs, model)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_duplicates.drop_near_duplicates(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, intact`` of every document left."""
    return bpe.round_trip(docs, VOCABULARY)


STAGES = [
    ("quality", rate),
    ("toxicity", civil),
    ("near_duplicates", unique),
    ("decontamination", untested),
    ("byte_bpe", tokens),
]

# The first two stages fit models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next one."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
