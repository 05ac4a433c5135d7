"""Similarity search: exact top-k within a session, hit merging and node sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import hit_score

TOP_K = 12
PLACES = 12  # hits are ranked by; sums of products in another order differ beyond these places


def valid(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows an index accepts: an id, a vector, the right length (V4)."""
    ok = (F.coalesce("node_id", F.lit("")) != "") & (F.size("embedding") > 0)
    return vectors.where(ok & (F.size("embedding") == dim) if dim else ok)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best nodes of each session's query by hit score, ties by node_id.

    An equi-join on the session: a query meets its own session's vectors only. Spark keeps the k
    best of each task before it shuffles (a limit on row_number)."""
    k = k if k > 0 else 10
    pairs = queries.select("session_id", F.col("embedding").alias("query")).join(vectors, "session_id").where(F.size("query") == F.size("embedding"))
    pairs = pairs.withColumn("hit", F.round(hit_score(F.col("query"), F.col("embedding")), PLACES))
    best = Window.partitionBy("session_id").orderBy(F.col("hit").desc(), "node_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("session_id", "node_id", F.round("hit", 9).alias("hit"), "rank")


def merge_hits(*hits: DataFrame) -> DataFrame:
    """All hits, the best score of each node."""
    both = hits[0].select("session_id", "node_id", "hit")
    for h in hits[1:]:
        both = both.unionByName(h.select("session_id", "node_id", "hit"))
    return both.groupBy("session_id", "node_id").agg(F.max("hit").alias("hit"))


def nodes_for_compile(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """Active nodes and archived ones that were hit."""
    found = nodes.where("status = 'archived'").join(hits.select("session_id", "node_id").distinct(), ["session_id", "node_id"], "left_semi")
    return nodes.where("status = 'active'").unionByName(found)
