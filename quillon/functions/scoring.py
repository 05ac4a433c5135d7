"""Retention scoring as set-based expressions over a node table, and the collector's trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import cosine
from quillon.schemas import BUCKET_RANK, OTHER_BUCKET, OTHER_PRIORITY, TYPE_PRIORITY, WEIGHTS, Policy


def choose(column: Column, values: dict, otherwise) -> Column:
    out = F.lit(None)
    for k, (key, value) in enumerate(values.items()):
        out = F.when(column == key, F.lit(value)) if not k else out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def type_priority(node_type: Column) -> Column:
    return choose(node_type, TYPE_PRIORITY, OTHER_PRIORITY)


def bucket_rank(node_type: Column) -> Column:
    return choose(node_type, BUCKET_RANK, OTHER_BUCKET)


def recency(distance: Column) -> Column:
    return F.exp(F.lit(-0.1) * distance)


def capped_share(count: Column) -> Column:
    return F.least(F.lit(0.3) * count, F.lit(1.0))


def stale_penalty(distance: Column, after: int) -> Column:
    return F.when(distance > after, F.least((distance - after) / F.lit(float(after)), F.lit(1.0))).otherwise(0.0)


def size_penalty(tokens: Column, most: int) -> Column:
    return F.when((F.lit(most) > 0) & (tokens > most), F.least(tokens / F.lit(float(most)) - 1, F.lit(1.0))).otherwise(0.0) if most > 0 else F.lit(0.0)


def retention(parts: dict[str, Column]) -> Column:
    """Weighted sum of the signals, between 0 and 1."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * parts[name]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def dependency_weight(nodes: DataFrame) -> DataFrame:
    """(session_id, node_id, dependents): how many other active nodes list the node, each once (J2); a hash join, not a loop."""
    listed = nodes.where("status = 'active'").select("session_id", F.col("node_id").alias("other"), F.explode(F.array_distinct("dependencies")).alias("node_id"))
    return listed.where("other <> node_id").groupBy("session_id", "node_id").agg(F.count("*").alias("dependents"))


def score_nodes(nodes: DataFrame, policy: Policy = Policy(), query: Column | None = None) -> DataFrame:
    """Active nodes with all signals and retention_score, at each session's last turn.

    Needs session_id, node_id, node_type, status, title, dependencies, open_issues,
    token_count, turn_number; with query (a vector column) also embedding."""
    last = Window.partitionBy("session_id")
    nodes = nodes.withColumn("distance", F.max("turn_number").over(last) - F.col("turn_number"))
    listed = dependency_weight(nodes)
    active = nodes.where(F.col("status").isin("active", "resolved"))
    same_title = F.count("*").over(Window.partitionBy("session_id", F.lower("title")))
    active = active.join(listed, ["session_id", "node_id"], "left").withColumn("same_title", same_title)
    parts = {
        "recency": recency(F.col("distance")),
        "type_priority": type_priority(F.col("node_type")),
        "dependency_weight": capped_share(F.coalesce("dependents", F.lit(0))),
        "unresolved_boost": F.when((F.size("open_issues") > 0) & (F.col("status") == "active"), 1.0).otherwise(0.0),
        "semantic": cosine(query, F.col("embedding")) if query is not None else F.lit(0.0),
        "redundancy": F.when(F.col("same_title") > 1, capped_share(F.col("same_title") - 1)).otherwise(0.0),
        "resolved_penalty": F.when(F.col("status") == "resolved", 1.0).otherwise(0.0),
        "stale_penalty": stale_penalty(F.col("distance"), policy.stale_after),
        "size_penalty": size_penalty(F.col("token_count"), policy.max_node_tokens),
    }
    scored = active.withColumns(parts)
    return scored.withColumn("retention_score", retention({k: F.col(k) for k in parts})).drop("same_title", "dependents")


def trigger(tokens: Column, active: Column, depth: Column, width: Column, mean: Column, resolved: Column, policy: Policy = Policy(), budget: Column | None = None) -> Column:
    """Why the collector should run, or null (G7). The first condition that holds."""
    limit = F.when(budget > 0, budget).otherwise(policy.budget) if budget is not None else F.lit(policy.budget)
    out = F.when((limit > 0) & (tokens > limit), "token_pressure")
    if 0 < policy.headroom < 1:
        out = out.when((limit > 0) & (tokens > F.floor(limit * F.lit(policy.headroom))), "soft_headroom")
    if policy.max_active > 0:
        out = out.when(active > policy.max_active, "active_count")
    return out.when(depth > policy.max_depth, "tree_depth").when(width > policy.max_children, "tree_width").when((active > 0) & (mean < policy.threshold), "low_relevance").when((active > 0) & resolved, "resolved_branch")


def effective_score(retention_score: Column, semantic: Column, hit: Column, weight: float) -> Column:
    """Score that a hit gives a node (F22); not held between 0 and 1."""
    return F.when(hit.isNotNull() & F.lit(weight > 0), retention_score + F.lit(weight) * (hit - semantic)).otherwise(retention_score)
