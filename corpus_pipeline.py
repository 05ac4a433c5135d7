"""Corpus cleaning, from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import stages
from quillon.llm.spark_util import Scratch, documents

#: (name, function(spark, docs, sf_dir) -> DataFrame); all but the last return the columns of documents
STAGES = stages.STAGES

#: SQL can't run a tokenizer or a compressor.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each read from the Parquet files of the one before."""
    scratch, docs = Scratch(spark), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
