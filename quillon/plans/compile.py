"""Prompt compilation: bucket, sort, choose under the budget and render, one row a session.

The whole choice is one greedy walk over (bucket, score): what a bucket leaves of the budget
goes to the next. A bucket met with nothing left is skipped, zero-cost nodes included. The walk
streams over a session's sorted nodes; only those that the budget lets in are gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scoring import bucket_rank, effective_score
from quillon.functions.text import token_count
from quillon.operators.selection import greedy_walk
from quillon.schemas import SECTION_LABELS


def node_cost(nodes: DataFrame) -> Column:
    """Tokens, or those of the summary where unset; compressed nodes add their fact and decision lines."""
    base = F.when(F.coalesce("token_count", F.lit(0)) == 0, token_count(F.col("summary"))).otherwise(F.col("token_count"))
    lines = F.when(F.col("node_type").isin("compressed_branch", "summary"), token_count(F.array_join("facts", "; ")) + token_count(F.array_join("decisions", "; "))).otherwise(0)
    return (base + lines).cast("long")


def node_text(n: Column) -> Column:
    """A node's lines in its section."""
    own = F.concat(F.lit("- "), F.when(n["summary"] != "", n["summary"]).otherwise(n["title"]), F.lit("\n"))
    facts = F.when(F.size(n["facts"]) > 0, F.concat(F.lit("  facts: "), F.array_join(n["facts"], "; "), F.lit("\n"))).otherwise("")
    decisions = F.when(F.size(n["decisions"]) > 0, F.concat(F.lit("  decisions: "), F.array_join(n["decisions"], "; "), F.lit("\n"))).otherwise("")
    return F.when(n["rank"].isin(3), F.concat(own, facts, decisions)).otherwise(own)


def compile_prompts(nodes: DataFrame, budget: int, score: str = "retention_score", reserved: Column | None = None, stable: bool = False) -> DataFrame:
    """session_id, prompt, included, used, excluded, original_tokens, compiled_tokens.

    nodes: what is to be compiled (active ones, or with hits), with a score. reserved:
    tokens of system text and question, a column that is the same in all rows of a session.
    stable: sections list nodes by turn and id rather than by score (K3)."""
    reserved = F.lit(0).cast("long") if reserved is None else reserved.cast("long")
    rows = nodes.withColumns({"rank": bucket_rank(F.col("node_type")), "cost": node_cost(nodes), "reserved": reserved})
    none = F.array().cast("array<string>")
    rows = rows.select("session_id", "rank", F.col(score).cast("double").alias("by"), "turn_number", "node_id", "cost", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("facts", none).alias("facts"), F.coalesce("decisions", none).alias("decisions"), "token_count", "reserved", (F.lit(budget) - F.col("reserved")).alias("room"))
    walked = greedy_walk(rows, "session_id", [F.col("rank"), F.col("by").desc(), F.col("turn_number"), F.col("node_id")], "cost", "room", "rank")
    item = F.struct("rank", (-F.col("by")).alias("by"), "turn_number", "node_id", "title", "summary", "facts", "decisions")
    # dropped nodes of a bucket are recorded only if it kept one
    buckets = walked.groupBy("session_id", "rank").agg(F.collect_list(F.when(F.col("kept"), item)).alias("kept"), F.collect_list(F.when(F.col("met") & ~F.col("kept"), F.col("node_id"))).alias("dropped"), F.sum(F.when(F.col("kept"), F.col("cost"))).alias("used"), F.sum("token_count").alias("tokens"), F.max("reserved").alias("reserved"))
    dropped = F.flatten(F.collect_list(F.when(F.size("kept") > 0, F.col("dropped"))))
    out = buckets.groupBy("session_id").agg(F.sort_array(F.flatten(F.collect_list("kept"))).alias("kept"), dropped.alias("dropped"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"), F.sum("tokens").cast("long").alias("original_tokens"), F.max("reserved").alias("reserved"))
    kept, excluded = F.col("kept"), F.col("dropped")

    def section(k: int) -> Column:
        own = F.filter(kept, lambda n: n["rank"] == k)
        if stable:
            own = F.array_sort(own, lambda a, b: F.when(a["turn_number"] != b["turn_number"], F.when(a["turn_number"] < b["turn_number"], -1).otherwise(1)).when(a["node_id"] < b["node_id"], -1).when(a["node_id"] > b["node_id"], 1).otherwise(0))
        return F.when(F.size(own) > 0, F.concat(F.lit(f"## {SECTION_LABELS[k]}\n"), F.array_join(F.transform(own, node_text), "")))

    prompt = F.concat_ws("\n\n---\n\n", *(section(k) for k in range(len(SECTION_LABELS))))
    out = out.select("session_id", prompt.alias("prompt"), F.size(kept).cast("long").alias("included"), "used", F.array_join(F.array_sort(excluded), ",").alias("excluded"), "original_tokens", "reserved")
    return out.withColumn("compiled_tokens", F.col("reserved") + token_count(F.col("prompt"))).drop("reserved")


def compile_with_hits(scored: DataFrame, hits: DataFrame, budget: int, weight: float = 0.2, reserved: Column | None = None, stable: bool = False) -> DataFrame:
    """Prompts of scored nodes whose order similarity hits (session_id, node_id, hit) change.

    Without a hit, or with weight 0, a node keeps its retention score."""
    both = scored.join(hits.select("session_id", "node_id", "hit"), ["session_id", "node_id"], "left")
    score = effective_score(F.col("retention_score"), F.col("semantic"), F.col("hit"), weight)
    return compile_prompts(both.withColumn("effective", F.round(score, 9)), budget, "effective", reserved, stable)


def history_section(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """The context section of kept turns (session_id, sequence, role, content) in order."""
    lines = turns.join(kept.select("session_id", "sequence"), ["session_id", "sequence"], "left_semi")
    line = F.concat(F.lit("- ["), F.col("role"), F.lit("] "), F.col("content"), F.lit("\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sequence", line.alias("line")))), lambda x: x["line"]), "")
    return lines.groupBy("session_id").agg(F.concat(F.lit("## Conversation Context\n"), body).alias("section"))


def wire_messages(system: Column, context: Column, question: Column) -> Column:
    """[system?, user(context)?, user(question)?] without empty ones."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    return F.filter(F.array(message("system", system), message("user", context), message("user", question)), lambda m: m["content"] != "")
