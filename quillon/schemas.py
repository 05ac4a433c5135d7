"""Explicit schemas (DDL), enumerations and policy defaults. Nothing is inferred; no Spark import."""

from __future__ import annotations

from dataclasses import dataclass

# Names of fields and of enumerations.
EVENT = "event_id string, session_id string, task_id string, event_type string, sequence bigint, payload string, token_count bigint, metadata map<string,string>, created_at timestamp"
SCORES = "recency double, dependency_weight double, redundancy double, type_priority double, unresolved_boost double, resolved_penalty double, stale_penalty double, size_penalty double, semantic double, retention_score double"
NODE = (
    "node_id string, parent_id string, session_id string, task_id string, node_type string, status string, title string, summary string, facts array<string>, decisions array<string>, open_issues array<string>, dependencies array<string>, raw_event_refs array<string>, child_ids array<string>, token_count bigint, turn_number bigint, "
    f"scores struct<{SCORES.replace(' double', ': double')}>, embedding array<float>, embed_model string, created_at timestamp, updated_at timestamp"
)
BRANCH = "branch_id string, session_id string, task_id string, parent_node_id string, original_node_ids array<string>, summary string, key_decisions array<string>, exact_facts array<string>, open_issues array<string>, important_constraints array<string>, raw_event_refs array<string>, original_token_count bigint, compressed_token_count bigint, created_at timestamp"
GC_LOG = "session_id string, trigger_reason string, nodes_swept bigint, branches_compressed bigint, tokens_freed bigint, duration_ms double, created_at timestamp"
SESSION_METRICS = "session_id string, total_events bigint, total_turns bigint, gc_runs bigint, total_tokens_saved bigint, avg_reduction_pct double, branches_compressed bigint, rehydration_events bigint, avg_latency_ms double, session_started_at timestamp"
SCENARIO = "id string, name string, category string, description string, turns array<struct<role:string,content:string>>, probes array<struct<id:string,probe_at:int,question:string,match_type:string,expected_any:array<string>,numeric_value:double,numeric_tol_pct:double,judge_rubric:string,notes:string>>"
PROBE_RESULT = "scenario_id string, probe_id string, pipeline string, cache_key_suffix string, question string, response string, prompt_tokens int, output_tokens int, cached_prompt_tokens int, latency_ms bigint, cached boolean, error string, original_token_count int, compiled_token_count int, included_nodes int, excluded_nodes int"
TURN = "role string, content string"
LATENCY_FIXTURE = "system string, warm_pairs array<struct<user:string,assistant:string>>, probe string"
LATENCY_SAMPLE = "iter int, baseline_llm_ms bigint, managed_round_trip_ms bigint, error string"

EVENT_TYPES = ("user_prompt", "agent_prompt", "llm_response", "tool_call", "tool_result", "error", "retry", "gc_trigger", "branch_compression", "state_snapshot", "system")
NODE_TYPES = ("goal", "constraint", "decision", "attempt", "tool_result", "issue", "summary", "compressed_branch", "background")
NODE_STATUSES = ("active", "resolved", "stale", "compressed", "archived")
MATCH_TYPES = ("regex", "exact", "contains_all", "contains_any", "numeric", "judge")
VERDICTS = ("win", "win-star", "tie", "loss", "baseline-win")
GC_REASONS = ("token_pressure", "soft_headroom", "active_count", "tree_depth", "tree_width", "low_relevance", "resolved_branch", "manual")
STRATEGIES = ("naive_full_history", "sliding_window", "managed")
STRATEGY_ALIASES = {"naive": "naive_full_history", "baseline": "naive_full_history", "full": "naive_full_history", "full_history": "naive_full_history", "sliding": "sliding_window", "window": "sliding_window"}

# Fixed values that results depend on: patterns, keywords, names, weights and priorities.
DECISION_LINE = r"(?im)^\s*decision\s*\d+\s*[:-]\s*(.+)$"
DECISION_RECORD = r"(?i)\b(ADR[-_]?\d+)\b"
CONSTRAINT_WORDS = ("must", "always", "never", "require", "constraint")
LEXICON = ("TimescaleDB", "JetStream", "InfluxDB", "PostgreSQL", "MongoDB", "Kafka", "Kubernetes", "CockroachDB", "Cockroach", "RabbitMQ", "DataMatrix")
STANDALONE = ("NATS", "Hetzner")
TRANSIENT_ERRORS = ("status 429", "status 500", "status 502", "status 503", "status 504", "timeout", "deadline exceeded", "connection reset", "EOF")
LASTING_ERRORS = ("insufficient_quota",)
TYPE_PRIORITY = {"goal": 1.0, "constraint": 0.95, "decision": 0.80, "issue": 0.70, "summary": 0.60, "compressed_branch": 0.60, "tool_result": 0.50, "attempt": 0.40, "background": 0.20}
OTHER_PRIORITY = 0.30
WEIGHTS = {"recency": 0.25, "type_priority": 0.20, "dependency_weight": 0.15, "unresolved_boost": 0.15, "semantic": 0.20, "redundancy": -0.10, "resolved_penalty": -0.20, "stale_penalty": -0.15, "size_penalty": -0.05}
BUCKET_RANK = {"goal": 0, "constraint": 1, "decision": 2, "compressed_branch": 3, "summary": 3, "tool_result": 4, "issue": 5}
OTHER_BUCKET = 6
SECTION_LABELS = ("Active Goals", "Constraints", "Key Decisions", "Prior Context", "Tool Outputs", "Open Issues", "Additional Context")


@dataclass(frozen=True)
class Policy:
    """When and what the collector sweeps."""

    budget: int = 6000
    max_depth: int = 10
    max_children: int = 50
    threshold: float = 0.30
    decision_floor: float = 0.20
    max_active: int = 25
    headroom: float = 0.60
    stale_after: int = 15
    max_node_tokens: int = 2000
