"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

Stages but the last return the columns of documents. A document is a row: rows are matched by
doc_id and, where an id repeats, judged alike. Null and empty texts fail the quality rules; in the
other stages they stay. An empty table stays empty, a very long text is one text, and further
columns of any name are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import order_minhash, packing, quality, substring, toxicity
from quillon.llm.spark_util import fresh


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the ids of gone; null ids stay."""
    return docs.join(gone.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id", "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that are frequent in their host. Untouched texts stay as they are."""
    (name,) = fresh(docs.columns, "kept_text")
    kept = quality.kept_texts(docs, name, copies_as_one=True)  # copies are the near-duplicate stage's: here they would all go
    new = {"text": F.col(name)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(name) != F.col("text"), F.length(name)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumns(new).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, toxicity.toxicity(docs, labels).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest id."""
    return _without(docs, order_minhash.near_duplicates(docs).where("not kept"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a smaller id has; what has no words left goes. Untouched texts stay as they are."""
    cut = substring.substring_dedup(docs).where("n_removed > 0")
    cut = cut.groupBy("doc_id", "text_key").agg(F.min("kept_text").alias("kept_text"), F.min(F.col("n_removed") == F.col("n_words")).alias("empty"))
    names = dict(zip(cut.columns, fresh(docs.columns, *(f"cut_{c}" for c in cut.columns))))
    cut = cut.select(*(F.col(c).alias(n) for c, n in names.items()))
    new_text, empty = F.col(names["kept_text"]), F.coalesce(F.col(names["empty"]), F.lit(False))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(names["doc_id"])) & (F.xxhash64(docs["text"].cast("string")) == F.col(names["text_key"]))
    joined = docs.join(cut, same, "left").where(~empty)
    new = {"text": F.coalesce(new_text, F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(new_text.isNotNull(), F.length(new_text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(new).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_rules), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packed)]
