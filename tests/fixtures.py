"""Small inline tables, with their SQL twins, for what the test tables don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: event_type, payload
TEXTS = [
    ("user_prompt", "We must keep it"),
    ("user_prompt", "ALWAYS on"),
    ("user_prompt", "never mind"),
    ("user_prompt", "A requirement"),
    ("user_prompt", "no constraints"),
    ("user_prompt", "mustard sauce"),
    ("user_prompt", "Decision 1: use Kafka here\nand ADR-12, adr_7\nsee hetzner."),
    ("user_prompt", "  decision 22 - two words \n\nnats, NATS"),
    ("user_prompt", "plain text\nwith COCKROACHDB and mongodb"),
    ("user_prompt", "xNATS NATSx _Hetzner Hetzner_ 1nats (nats)"),
    ("user_prompt", "\n".join(f"Decision {k}: fact number {k}" for k in range(1, 18))),
    ("user_prompt", "Decision 1: Same\nDecision 2: SAME\nDecision 3: same "),
    ("llm_response", "Noted: the first\nnoted - the second\nnoted"),
    ("llm_response", "noted\nNoted the whole line"),
    ("llm_response", "Short. But this sentence is longer than thirty bytes. The rest follows."),
    ("llm_response", "One line only without any stop at all"),
    ("llm_response", "First line here\nsecond line"),
    ("llm_response", "é" * 300),
    ("llm_response", "   "),
    ("tool_call", "rabbitmq on Kubernetes"),
    ("tool_result", "z" * 501),
    ("error", "broken influxdb"),
    ("retry", "again"),
    ("gc_trigger", "manual"),
    ("agent_prompt", ""),
]

#: node_id, parent, type, status, summary, tokens, turn, open issues, dependencies
NODES = [
    ("root", "", "goal", "active", "", 0, 0, [], []),
    ("p1", "root", "goal", "active", "plan one", 10, 1, ["open"], ["p2", "p1", "p2", "gone"]),
    ("p2", "root", "decision", "resolved", "plan two", 20, 2, [], []),
    ("a1", "p1", "tool_result", "active", "old result one", 30, 3, [], ["p2"]),
    ("a2", "p1", "tool_result", "active", "old result two", 40, 4, [], []),
    ("a3", "p1", "tool_result", "active", "old result three", 50, 5, [], []),
    ("b1", "p2", "attempt", "active", "try one", 60, 6, [], []),
    ("b2", "p2", "attempt", "active", "try two", 70, 7, [], []),
    ("c1", "a1", "background", "active", "note one", 80, 8, [], []),
    ("c2", "a1", "background", "active", "note two", 150, 9, [], []),
    ("c3", "a1", "background", "active", "note three", 260, 10, [], []),
    ("c4", "a1", "attempt", "active", "note four", 20, 11, [], []),
    ("d1", "c4", "goal", "active", "goal below", 20, 12, [], []),
    ("d2", "c4", "issue", "active", "fresh issue", 20, 39, ["one"], ["d1"]),
    ("d3", "c4", "tool_result", "active", "Fresh result", 20, 40, [], []),
    ("d4", "c4", "tool_result", "active", "fresh result", 20, 40, [], []),
]

#: match_type, response, expected, value, tolerance, error, score
PROBES = [
    ("contains_any", "We use Kafka", ["kafka", ""], None, None, None, 5.0),
    ("contains_any", "nothing", ["kafka"], None, None, None, 0.0),
    ("contains_any", "I don’t recall, maybe Kafka", ["kafka"], None, None, None, 0.0),
    ("contains_all", "alpha beta", ["Alpha", "beta", "gamma"], None, None, None, 5.0 * 2 / 3),
    ("contains_all", "x", [], None, None, None, 5.0),
    ("exact", "  It is Forty  ", [" forty "], None, None, None, 5.0),
    ("regex", "port 5432", [r"port\s+\d+"], None, None, None, 5.0),
    ("regex", "PORT x", [r"port\s+\d+"], None, None, None, 0.0),
    ("numeric", "about 104 ms", [], 100.0, 0.05, None, 5.0),
    ("numeric", "about 106 ms", [], 100.0, 0.05, None, 0.0),
    ("numeric", "none", [], 100.0, 0.05, None, 0.0),
    ("judge", "free text", [], None, None, None, -1.0),
    ("judge", "free text", [], None, None, "failed", 0.0),
    ("contains_any", "   ", ["a"], None, None, None, 0.0),
    ("other", "a", ["a"], None, None, None, 0.0),
]


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _list(x: list[str]) -> str:
    return "[" + ", ".join(map(_text, x)) + "]::VARCHAR[]"


TEXTS_SQL = "WITH t(id, event_type, payload) AS (VALUES " + ", ".join(f"({k}, {_text(a)}, {_text(b)})" for k, (a, b) in enumerate(TEXTS)) + ")"
NODES_SQL = "WITH i(session_id, node_id, parent_id, node_type, status, title, summary, token_count, turn_number, open_issues, dependencies, facts, decisions) AS (VALUES " + ", ".join(f"('s1', {_text(n)}, {_text(p)}, {_text(k)}, {_text(st)}, {_text(su)}, {_text(su)}, {t}::BIGINT, {u}::BIGINT, {_list(o)}, {_list(de)}, []::VARCHAR[], []::VARCHAR[])" for n, p, k, st, su, t, u, o, de in NODES) + ")"
PROBES_SQL = "WITH p(id, expected_score) AS (VALUES " + ", ".join(f"({k}, {x[-1]!r}::DOUBLE)" for k, x in enumerate(PROBES)) + ")"


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *x) for k, x in enumerate(TEXTS)], "id int, event_type string, payload string")


def injected(spark: SparkSession) -> DataFrame:
    """Nodes that reach compaction, dependency weight, open issues and resolved penalties."""
    rows = [("s1", n, p, k, st, su, su, t, u, o, de, [], []) for n, p, k, st, su, t, u, o, de in NODES]
    return spark.createDataFrame(rows, "session_id string, node_id string, parent_id string, node_type string, status string, title string, summary string, token_count long, turn_number long, open_issues array<string>, dependencies array<string>, facts array<string>, decisions array<string>")


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *x[:-1]) for k, x in enumerate(PROBES)], "id int, match_type string, response string, expected array<string>, value double, tolerance double, error string")
