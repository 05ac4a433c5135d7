"""Event store operators on DataFrames: reads, upserts, aggregates and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Adds rows; nothing is written for an empty table."""
    if not df.isEmpty():
        writer = df.write.mode("append")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def events_from(events: DataFrame, session, from_sequence: int = 0, limit: int = 0) -> DataFrame:
    out = events.where((F.col("session_id") == session) & (F.col("sequence") >= from_sequence)).orderBy("sequence")
    return out.limit(limit) if limit > 0 else out


def events_by_type(events: DataFrame, session, event_type: str) -> DataFrame:
    return events.where((F.col("session_id") == session) & (F.col("event_type") == event_type)).orderBy("sequence")


def events_by_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events whose id is in ids (one column event_id); Spark picks the join by size."""
    return events.join(ids.select("event_id").distinct(), "event_id", "left_semi").orderBy("sequence")


def recent(rows: DataFrame, n: int, order: Column, key: str | None = None) -> DataFrame:
    """The newest n rows, newest first; with key, of each key."""
    if key is None:
        return rows.orderBy(order).limit(n)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_k") <= n).drop("_k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old and new rows, the greatest version of each key; new wins ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k", "_new")


def nodes_by_session(nodes: DataFrame, session, *statuses: str) -> DataFrame:
    out = nodes.where(F.col("session_id") == session)
    return out.where(F.col("status").isin(*statuses)) if statuses else out


def nodes_by_parent(nodes: DataFrame, session, parent: str) -> DataFrame:
    return nodes.where((F.col("session_id") == session) & (F.col("parent_id") == parent))


def set_status(nodes: DataFrame, session, node_id: str, status: str, at: Column | None = None) -> DataFrame:
    """All nodes, one with another status and time of change."""
    here = F.coalesce((F.col("session_id") == session) & (F.col("node_id") == node_id), F.lit(False))
    now = F.current_timestamp() if at is None else at
    return nodes.withColumns({"status": F.when(here, F.lit(status)).otherwise(F.col("status")), "updated_at": F.when(here, now).otherwise(F.col("updated_at"))})


def archive(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes with status archived where (session_id, node_id) is in ids."""
    marked = ids.select("session_id", "node_id").distinct().withColumn("_gone", F.lit(True))
    return nodes.join(marked, ["session_id", "node_id"], "left").withColumn("status", F.when(F.col("_gone"), "archived").otherwise(F.col("status"))).drop("_gone")


def node_embeddings(nodes: DataFrame, archived: bool) -> DataFrame:
    """(node_id, embedding) of live or of archived nodes that have one."""
    status = F.col("status") == "archived" if archived else F.col("status") != "archived"
    return nodes.where(status & (F.size("embedding") > 0)).select("session_id", "node_id", "embedding")


def snapshot(nodes: DataFrame, at: Column) -> DataFrame:
    """One row a session with its whole nodes (S16); sessions without nodes have none."""
    first = ["node_id", "status", "turn_number"]
    node = F.struct(*first, *(c for c in nodes.columns if c not in (*first, "session_id")))
    return nodes.groupBy("session_id").agg(F.sort_array(F.collect_list(node)).alias("nodes")).withColumn("snapshot_at", at)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("session_id").agg(F.max_by("nodes", "snapshot_at").alias("nodes"), F.max("snapshot_at").alias("snapshot_at"))


def snapshot_times(snapshots: DataFrame, n: int) -> DataFrame:
    """The newest n times of each session, newest first, without the nodes."""
    return recent(snapshots.select("session_id", "snapshot_at"), n, F.col("snapshot_at").desc(), "session_id")


def restore(snapshots: DataFrame) -> DataFrame:
    """The nodes of each session's latest snapshot."""
    return latest_snapshot(snapshots).select("session_id", F.explode("nodes").alias("_n")).select("session_id", "_n.*")


def tree_state(nodes: DataFrame) -> DataFrame:
    """(session_id, root_id, turn_count): the earliest node without a parent, null where none is, and the last turn."""
    root = F.when(F.coalesce("parent_id", F.lit("")) == "", F.struct("turn_number", "node_id"))
    return nodes.groupBy("session_id").agg(F.min(root)["node_id"].alias("root_id"), F.max("turn_number").alias("turn_count"))


def branches_by_session(branches: DataFrame, session) -> DataFrame:
    """A session's branches, newest first."""
    return branches.where(F.col("session_id") == session).orderBy(F.col("created_at").desc(), "branch_id")


def branch_by_id(branches: DataFrame, branch_id: str) -> DataFrame:
    return branches.where(F.col("branch_id") == branch_id).limit(1)


def count_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id", "event_type").agg(F.count("*").alias("n"))


def token_usage(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"))


def compression_stats(branches: DataFrame) -> DataFrame:
    return branches.groupBy("session_id").agg(F.sum("original_token_count").cast("long").alias("original_tokens"), F.sum("compressed_token_count").cast("long").alias("compressed_tokens"))


def gc_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(F.count("*").alias("runs"), F.sum("nodes_swept").cast("long").alias("swept"), F.sum("tokens_freed").cast("long").alias("freed"))


def retain(rows: DataFrame, at: str, days: int, now: Column) -> DataFrame:
    """Rows not older than so many days."""
    return rows.where(F.col(at) > now - F.expr(f"INTERVAL {days} DAYS"))


def rehydrate(branches: DataFrame, events: DataFrame) -> DataFrame:
    """Raw events of each branch, in order; a branch whose events are gone has none."""
    refs = branches.select("branch_id", "session_id", F.explode("raw_event_refs").alias("event_id"))
    return refs.join(events, ["session_id", "event_id"])


def replace_children(child_ids: Column, replaced: Column, new: Column) -> Column:
    """A parent's list without the replaced children, then the new one."""
    return F.concat(F.array_except(child_ids, replaced), F.array(new))
