"""Shared Spark helpers: scratch tables (from the engine), partition counts, connected components."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.folders import Scratch


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts_for(total: int, each: int) -> int:
    return max(1, -(-int(total) // each))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that are among the columns in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def freed_shuffles(spark: SparkSession):
    """Within, an action's shuffle files go when it ends, where what follows reads tables alone."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def arrow_batches(spark: SparkSession, most_bytes: int):
    """Within, what goes to a Python worker at once is about most_bytes, or one longer row, however many rows that is."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def components(scratch: Scratch, links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id that it reaches.

    Alternating large-star and small-star steps: each row's neighbours are aggregated to a
    minimum and joined back, so that no task needs a whole component and the number of rows
    never exceeds the number of links. Ends when a round changes nothing."""
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    last, step = None, 0
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: the smaller neighbours and the node itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        edges = scratch.keep(small, f"{name}-{step}")
        state = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{step - 1}")
        if state == last:
            break
        last = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
