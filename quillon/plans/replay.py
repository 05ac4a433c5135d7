"""Replay of whole sessions in batch: one group a session, small columns only into Python.

With vectors, nodes are scored against the last user's vector and every user's turn searches the
session's nodes. What it may find depends on when nodes were made and swept, but not the other
way round: a first pass of the reducer gives the nodes' lifetimes, an as-of similarity join the
hits of all turns, and a second pass compiles with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text, vectors
from quillon.operators import asof
from quillon.plans import fold
from quillon.schemas import Policy

TURN_STATS = "session_id string, turn_number long, raw_tokens long, compiled_tokens long, tokens_saved long, reduction_pct double, active_nodes long, total_nodes long, archived_nodes long, gc_reason string, gc_nodes_swept long, gc_tokens_freed long"


def prepared(events: DataFrame, with_vectors: bool = False) -> DataFrame:
    """What the reducer needs of each event, its vector too if asked for; all columns are native expressions."""
    kind = text.classify(F.col("event_type"), F.col("payload"))
    facts, decisions = text.extract(F.col("event_type"), F.col("payload"))
    more = ["vector", (F.col("event_type") == "user_prompt").alias("is_user")] if with_vectors else []
    return events.select("session_id", "sequence", kind.alias("kind"), text.title(F.col("event_type"), F.col("payload")).alias("title"), text.summary(F.col("payload")).alias("summary"), "payload", "token_count", ((F.size(facts) <= 0) & (F.size(decisions) <= 0)).alias("bare"), *more)


def embedded(events: DataFrame, dim: int = 32) -> DataFrame:
    """events with the vector of their payload by the offline embedder; any column of vectors may take its place."""
    return events.withColumn("vector", vectors.mock_embedding(F.coalesce("payload", F.lit("")), dim))


def _ordered(pdf: pd.DataFrame) -> list[dict]:
    return pdf.sort_values("sequence").to_dict("records")


_TYPES = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _by_session(rows: DataFrame, run: Callable[[str, list[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """What run(session_id, events in order) yields for each session, by way of Arrow alone: most sessions are short."""
    fields = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def whole(table: pa.Table) -> pa.Table:
        events = sorted(table.to_pylist(), key=lambda e: (e["sequence"] is None, e["sequence"]))
        return pa.Table.from_pylist(list(run(events[0]["session_id"], events)), fields)

    return rows.groupBy("session_id").applyInArrow(whole, schema)


def replay(events: DataFrame, policy: Policy = Policy(), compile_each: bool = True) -> DataFrame:
    """A row for each event: sizes, saving and collections after it (G17). A session is one group; its time grows with its events."""

    def run(session_id: str, rows: list[dict]) -> Iterator[dict]:
        s = fold.Session(session_id, policy)
        return ({"session_id": session_id} | fold.step(s, e, compile_each) for e in rows)

    return _by_session(prepared(events), run, TURN_STATS)


def lifetimes(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(session_id, node_turn, made, swept) of each node of events with a vector, scored with it: alive at turns made <= t < swept, archived from swept on."""

    def run(session_id: str, rows: list[dict]) -> Iterator[dict]:
        s = fold.Session(session_id, policy, semantic=True)
        for e in rows:
            fold.ingest(s, e)
        return ({"session_id": session_id, "node_turn": n.turn, "made": n.turn, "swept": n.swept} for n in s.nodes.values() if n.vector is not None)

    small = prepared(events, True).drop("payload").withColumn("summary", F.lit(""))
    return _by_session(small, run, "session_id string, node_turn long, made long, swept long")


def turn_hits(events: DataFrame, policy: Policy = Policy(), k: int = asof.TOP_K) -> DataFrame:
    """(session_id, turn_number, node_turn, archived, hit, rank): the k nearest live and the k nearest archived nodes of each user's turn that has a text, the turn's own node among the live ones."""
    order = Window.partitionBy("session_id").orderBy("sequence")
    turns = events.select("session_id", F.row_number().over(order).cast("long").alias("node_turn"), "event_type", "payload", "vector")
    nodes = lifetimes(events, policy).join(turns.select("session_id", "node_turn", "vector"), ["session_id", "node_turn"])
    asked = turns.where("event_type = 'user_prompt' and payload <> ''").select("session_id", F.col("node_turn").alias("turn_number"), "vector")
    return asof.asof_top_k(asked, nodes, k)


def semantic_replay(events: DataFrame, policy: Policy = Policy(), k: int = asof.TOP_K) -> DataFrame:
    """The replay of events with a vector: scored against the last user's vector, each user's prompt compiled with its hits (G17 with its semantic arm)."""
    of_turn = turn_hits(events, policy, k).groupBy("session_id", "turn_number").agg(F.collect_list(F.struct("node_turn", "hit")).alias("hits"))
    order = Window.partitionBy("session_id").orderBy("sequence")
    rows = prepared(events, True).withColumn("turn_number", F.row_number().over(order).cast("long")).join(of_turn, ["session_id", "turn_number"], "left")

    def run(session_id: str, rows: list[dict]) -> Iterator[dict]:
        s = fold.Session(session_id, policy, semantic=True)
        for e in rows:
            e["hits"] = [(h["node_turn"], h["hit"]) for h in e["hits"] or ()]
            yield {"session_id": session_id} | fold.step(s, e)

    return _by_session(rows, run, TURN_STATS)


def prompts(events: DataFrame, policy: Policy = Policy(), stable: bool | None = False) -> DataFrame:
    """(session_id, turn_number, prompt, compiled_tokens): the prompt after each event, rendered by score or, if stable, by turn (K3). With None, both, and a column `stable`."""
    kinds = (False, True) if stable is None else (stable,)

    def run(session_id: str, rows: list[dict]) -> Iterator[dict]:
        s = fold.Session(session_id, policy)
        for e in rows:
            fold.ingest(s, e)
            size, chosen = s.compiled(policy.budget, e["payload"])
            for kind in kinds:
                yield {"session_id": session_id, "turn_number": s.turn, "prompt": s.prompt(chosen, kind), "compiled_tokens": size, "stable": kind}

    both = _by_session(prepared(events), run, "session_id string, turn_number long, prompt string, compiled_tokens long, stable boolean")
    return both if stable is None else both.drop("stable")


MANAGED = "session_id string, original_tokens long, compiled_tokens long, included long, excluded long"


def managed(events: DataFrame, questions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The managed strategy (C3): the history is replayed without prompts, then one prompt is compiled for a question that is no part of it.

    questions (session_id, question, system_text), one a session; both texts take their tokens
    from the budget. A session without history has its root only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        s = fold.Session(first["session_id"], policy)
        for e in _ordered(pdf[pdf["sequence"].notna()]):
            fold.ingest(s, e)
        asked = fold.tokens(first["question"]) + fold.tokens(first["system_text"])
        size, chosen = s.compiled(policy.budget, first["question"], first["system_text"])
        return pd.DataFrame([(s.session_id, asked + s.tokens, size, len(chosen), s.n_active - len(chosen))], columns=[c.split()[0] for c in MANAGED.split(", ")])

    texts = questions.select("session_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("question", "system_text")))
    rows = texts.join(prepared(events).drop("payload"), "session_id", "left").withColumns({"bare": F.coalesce("bare", F.lit(True)), "token_count": F.coalesce("token_count", F.lit(0))})
    return rows.groupBy("session_id").applyInPandas(run, MANAGED)


def coherency(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(session_id, coherency) after the last event."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _ordered(pdf)
        s = fold.Session(pdf["session_id"].iloc[0], policy)
        for e in rows:
            fold.ingest(s, e)
        return pd.DataFrame([{"session_id": s.session_id, "coherency": fold.coherency(s, [e["payload"] for e in rows])}])

    return prepared(events).groupBy("session_id").applyInPandas(run, "session_id string, coherency double")


def session_summary(turns: DataFrame) -> DataFrame:
    """Last sizes, peaks and collections of each session."""
    return turns.groupBy("session_id").agg(
        F.count("*").alias("turns"),
        F.max_by("raw_tokens", "turn_number").alias("raw_tokens"),
        F.max_by("compiled_tokens", "turn_number").alias("compiled_tokens"),
        F.max_by("tokens_saved", "turn_number").alias("tokens_saved"),
        F.max("raw_tokens").alias("peak_raw"),
        F.max("compiled_tokens").alias("peak_compiled"),
        F.sum("gc_tokens_freed").cast("long").alias("gc_freed"),
        F.count("gc_reason").alias("gc_runs"),
    )


def suite_summary(sessions: DataFrame) -> DataFrame:
    """Totals over sessions; the reduction is a ratio of sums."""
    total = sessions.agg(F.count("*").alias("sessions"), F.sum("turns").cast("long").alias("turns"), F.sum("raw_tokens").cast("long").alias("raw_tokens"), F.sum("compiled_tokens").cast("long").alias("compiled_tokens"), F.sum("tokens_saved").cast("long").alias("tokens_saved"), F.sum("gc_runs").cast("long").alias("gc_runs"))
    return total.withColumn("reduction_pct", F.coalesce(F.try_divide(F.col("tokens_saved") * 100.0, F.col("raw_tokens")), F.lit(0.0)))


def raw_growth(events: DataFrame) -> DataFrame:
    """Running raw tokens and distance to the last turn."""
    order = Window.partitionBy("session_id").orderBy("sequence")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return events.select("session_id", "sequence", F.row_number().over(order).alias("turn_number"), F.sum("token_count").over(upto).cast("long").alias("raw_tokens"), (F.count("*").over(Window.partitionBy("session_id")) - F.row_number().over(order)).alias("distance"))


