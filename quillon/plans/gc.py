"""One collection over node tables: trigger, mark, sweep and compact, all set-based."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.providers import Completer, completion
from quillon.functions.scoring import score_nodes, trigger
from quillon.functions.text import dedupe, entities_line, facts_prefix, token_count, trimmed
from quillon.schemas import Policy
from quillon.sources.folders import Scratch


def tree_depth(nodes: DataFrame) -> DataFrame:
    """(session_id, max_depth) of the tree by parent_id, status ignored; roots are 0 deep.

    Each node points to an ancestor twice as far up in every round, until all that hang on a
    root have reached it; what hangs on no root has no depth. A round writes only the nodes that
    have not reached a root before it, as a table in the shared folder, so that a lost executor
    costs a round at most."""
    scratch, step = Scratch(nodes.sparkSession), 0
    root = F.coalesce("parent_id", F.lit("")) == ""
    rows = scratch.keep(nodes.select("session_id", "node_id", F.when(~root, F.col("parent_id")).alias("up"), F.when(root, 0).otherwise(1).cast("long").alias("depth")).distinct(), "0")
    reached, way = rows.where("up is null"), rows.where("up is not null")
    while True:
        above = reached.unionByName(way).select("session_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        moved = way.join(above, ["session_id", "up"]).select("session_id", "node_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        step += 1
        rows = scratch.keep(moved.groupBy("session_id", "node_id", "up").agg(F.max("depth").alias("depth")), str(step))
        found, way = rows.where("up is null"), rows.where("up is not null")
        if not found.take(1):  # as long as a node hangs on a root, one next to a reached one is found
            return reached.groupBy("session_id").agg(F.max("depth").alias("max_depth"))
        reached = reached.unionByName(found)


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Counts by status and widest parent of each session (A6, without the depth)."""
    width = nodes.where("parent_id <> ''").groupBy("session_id", "parent_id").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.max("n").alias("max_width"))
    counts = nodes.groupBy("session_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("active", "compressed", "archived")))
    return counts.join(width, "session_id", "left").fillna({"max_width": 0})


def should_run(nodes: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(session_id, reason); reason is null where nothing calls for a collection."""
    scored = score_nodes(nodes, policy)
    active = scored.groupBy("session_id").agg(F.sum("token_count").alias("tokens"), F.count("*").alias("active"), F.avg("retention_score").alias("mean"), F.max((F.col("status") == "resolved").cast("int")).alias("resolved"))
    tree = tree_stats(nodes).select("session_id", "max_width").join(tree_depth(nodes), "session_id")
    joined = tree.join(active, "session_id", "left").fillna({"tokens": 0, "active": 0, "resolved": 0})
    return joined.select("session_id", trigger(F.col("tokens"), F.col("active"), F.col("max_depth"), F.col("max_width"), F.col("mean"), F.col("resolved") == 1, policy).alias("reason"))


def mark(nodes: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Scored nodes without facts and decisions, with sweep."""
    bare = score_nodes(nodes, policy).where((F.size("facts") <= 0) & (F.size("decisions") <= 0))
    floor = F.when((F.col("node_type") == "decision") & F.lit(policy.decision_floor > 0), F.greatest("retention_score", F.lit(policy.decision_floor))).otherwise(F.col("retention_score"))
    return bare.withColumn("sweep", floor < policy.threshold)


def sweep(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """nodes with swept ones archived."""
    gone = marked.where("sweep").select("session_id", "node_id").withColumn("_gone", F.lit(True))
    return nodes.join(gone, ["session_id", "node_id"], "left").withColumn("status", F.when(F.col("_gone"), "archived").otherwise(F.col("status"))).drop("_gone")


def _in_order(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.transform(F.sort_array(F.collect_list(F.struct("turn_number", "node_id", value.alias("v")))), lambda x: x["v"])


def simple_compressor(groups: DataFrame) -> DataFrame:
    """Summary text, merged arrays and costs of each group of children."""
    parts = F.filter(F.col("summaries"), lambda x: x != "")
    n = F.size(parts)
    body = F.when(n > 3, F.concat(F.element_at(parts, 1), F.lit(" ... "), F.element_at(parts, -1))).otherwise(F.array_join(parts, " | "))
    out = groups.withColumns({"facts": dedupe(F.flatten("facts")), "decisions": dedupe(F.flatten("decisions"))})
    out = out.withColumn("summary", F.concat(facts_prefix(F.col("facts")), F.lit("Compressed branch: "), body))
    return out.withColumn("compressed_tokens", token_count(F.col("summary")))


def _block() -> Column:
    """What an external compressor is told of a node."""
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise("")
    listed = lambda c: F.array_join(c, "; ")
    return F.concat(F.lit("["), "node_type", F.lit(", "), "status", F.lit("]\n"), line("title", F.col("title")), line("text", F.col("summary")), line("facts", listed("facts")), line("decisions", listed("decisions")), line("open issues", listed("open_issues")))


def external_compressor(make: Callable[[], Completer], task: str = "Summarise these conversation nodes; the last line lists names after ENTITIES:") -> Callable[[DataFrame], DataFrame]:
    """A compressor that asks a completer (G12): summary is the answer after the verified facts, names of its last line are facts.

    A branch costs what the call took, prompt and answer, or its summary's tokens if these are
    more. An answer of nothing but names is kept as it is."""

    def run(groups: DataFrame) -> DataFrame:
        parts = F.transform("blocks", lambda b, k: F.concat(F.lit("Node "), (k + 1).cast("string"), F.lit(" "), b))
        out = groups.withColumn("reply", completion(F.concat(F.lit(f"{task}\n\n"), F.array_join(parts, "\n")), make))
        body, names = entities_line(F.col("reply.text"))
        out = out.withColumns({"facts": dedupe(F.concat(dedupe(F.flatten("facts")), names)), "decisions": dedupe(F.flatten("decisions")), "body": body})
        whole = trimmed(F.concat(facts_prefix(F.col("facts")), F.col("body")))
        out = out.withColumn("summary", F.when(whole == "", trimmed(F.col("reply.text"))).otherwise(whole))
        return out.withColumn("compressed_tokens", F.greatest(F.col("reply.prompt_tokens") + F.col("reply.completion_tokens"), token_count(F.col("summary")))).drop("reply", "body")

    return run


def compact(marked: DataFrame, policy: Policy = Policy(), compressor: Callable[[DataFrame], DataFrame] = simple_compressor) -> DataFrame:
    """Branches that a collection compresses: session_id, parent_id, child_ids, summary, tokens.

    A parent's marked children compress if they are max_children or more, or none of them is
    active after the sweep; goals and constraints stay out, and three must be left."""
    groups = marked.where("parent_id <> ''").groupBy("session_id", "parent_id").agg(
        F.count("*").alias("children"),
        F.count_if(~F.col("sweep") & (F.col("status") == "active")).alias("alive"),
        F.count_if(~F.col("node_type").isin("goal", "constraint")).alias("compressible"),
    )
    chosen = groups.where(((F.col("children") >= policy.max_children) | (F.col("alive") == 0)) & (F.col("compressible") >= 3)).select("session_id", "parent_id")
    rows = marked.where(~F.col("node_type").isin("goal", "constraint")).join(chosen, ["session_id", "parent_id"])
    text = F.coalesce(F.nullif("summary", F.lit("")), F.col("title"), F.lit(""))
    out = rows.groupBy("session_id", "parent_id").agg(_in_order("node_id").alias("child_ids"), _in_order(text).alias("summaries"), _in_order("facts").alias("facts"), _in_order("decisions").alias("decisions"), _in_order(_block()).alias("blocks"), F.sum("token_count").cast("long").alias("original_tokens"))
    return compressor(out).drop("summaries", "blocks")


def collect_garbage(nodes: DataFrame, policy: Policy = Policy(), compressor: Callable[[DataFrame], DataFrame] = simple_compressor) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes after, branches, summary by session: swept, freed, branches). Swept nodes that compact too are freed twice, as specified."""
    marked = mark(nodes, policy)
    branches = compact(marked, policy, compressor)
    children = branches.select("session_id", F.explode("child_ids").alias("node_id")).withColumn("sweep", F.lit(True))
    after = sweep(sweep(nodes, marked), children)
    made = branches.select("session_id", F.concat(F.lit("compressed_"), "parent_id").alias("node_id"), "parent_id", F.lit("compressed_branch").alias("node_type"), F.lit("compressed").alias("status"), F.lit("Compressed branch").alias("title"), "summary", "facts", "decisions", F.col("compressed_tokens").alias("token_count"))
    swept = marked.where("sweep").groupBy("session_id").agg(F.count("*").alias("swept"), F.sum("token_count").alias("freed"))
    saved = branches.groupBy("session_id").agg(F.count("*").alias("branches"), F.sum(F.col("original_tokens") - F.col("compressed_tokens")).alias("saved"))
    total = nodes.select("session_id").distinct().join(swept, "session_id", "left").join(saved, "session_id", "left").fillna(0, ["swept", "freed", "branches", "saved"])
    total = total.select("session_id", "swept", (F.col("freed") + F.col("saved")).cast("long").alias("freed"), "branches")
    return after.unionByName(made, allowMissingColumns=True), branches, total


def orphans(nodes: DataFrame) -> DataFrame:
    """(session_id, node_id, dep): dependencies of active nodes that were nowhere when they were read.

    A dependency resolves if its node, alive or archived by now, was made by the turn of the node
    that reads it; sweeps between the two change nothing. Each pair once."""
    read = nodes.where("status = 'active'").select("session_id", "node_id", "turn_number", F.explode(F.array_distinct("dependencies")).alias("dep"))
    made = nodes.groupBy("session_id", F.col("node_id").alias("dep")).agg(F.min("turn_number").alias("made"))
    there = read.join(made, ["session_id", "dep"], "left")
    return there.where(F.col("made").isNull() | (F.col("made") > F.col("turn_number"))).select("session_id", "node_id", "dep")


def title_counts(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("n", F.count("*").over(Window.partitionBy("session_id", F.lower("title"))))
