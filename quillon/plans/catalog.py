"""All registered queries of the engine's own operators, with their SQL twins.

Names start with the operator's number. Sessions come from the conversations, events and
embeddings tables (`quillon.sources.tables`)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import budget, evaluation, lexicon, providers, scoring, text, vectors
from quillon.operators import ann, asof, index, store
from quillon.operators.stored import StoredTable
from quillon.plans import compile as prompts
from quillon.plans import evaluate, gc, replay
from quillon.schemas import Policy
from quillon.sources.folders import Scratch
from quillon.sources.tables import CONV_SQL, LOG_SQL, NODE_SQL, RICH_SQL, conversation_events, log_events, log_nodes, rich_nodes, table, vector_nodes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SESSION = "7"


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


CONV, LOG, NODE = f"WITH {CONV_SQL}", f"WITH {LOG_SQL}", f"WITH {NODE_SQL}"
RNODE = f"WITH RECURSIVE {NODE_SQL}"
RICH = f"WITH {RICH_SQL}"

CONV_TEXTS = f"{CONV}, t AS (SELECT session_id || '/' || sequence AS id, event_type, payload FROM c)"
LOG_TEXTS = f"{LOG}, t AS (SELECT event_id AS id, event_type, payload FROM e)"
#: name -> (function of texts, its SQL over a table t), for tests with texts that no table has
TEXT_QUERIES: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {}


def texts_query(name: str, sql: str):
    """Registers f(texts: id, event_type, payload) over the log and over all conversations."""

    def keep(f: Callable[[DataFrame], DataFrame]):
        TEXT_QUERIES[name] = f, sql
        query(name, LOG_TEXTS + sql)(lambda s, d: f(log_events(s, d).select(F.col("event_id").alias("id"), "event_type", "payload")))
        whole = lambda s, d: f(conversation_events(s, d).select(F.concat_ws("/", "session_id", "sequence").alias("id"), "event_type", "payload"))
        query(f"{name}_conversations", CONV_TEXTS + sql)(whole)
        return f

    return keep


# --- event store ---------------------------------------------------------------------


@query("s3_events_from", f"{LOG} SELECT event_id, sequence, event_type, token_count FROM e WHERE session_id = '7' AND sequence >= 5 ORDER BY sequence LIMIT 20")
def _(s, d):
    return store.events_from(log_events(s, d), SESSION, 5, 20).select("event_id", "sequence", "event_type", "token_count")


@query("s4_events_by_type", f"{LOG} SELECT event_id, sequence FROM e WHERE session_id = '7' AND event_type = 'tool_call'")
def _(s, d):
    return store.events_by_type(log_events(s, d), SESSION, "tool_call").select("event_id", "sequence")


@query("s5_events_by_ids", f"{LOG} SELECT event_id, session_id, sequence FROM e WHERE event_id IN (SELECT item_id::VARCHAR FROM benchmark)")
def _(s, d):
    ids = table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("event_id"))
    return store.events_by_ids(log_events(s, d), ids).select("event_id", "session_id", "sequence")


@query("s6_recent_events", f"{LOG} SELECT session_id, event_id, sequence FROM e QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sequence DESC) <= 3")
def _(s, d):
    return store.recent(log_events(s, d), 3, F.col("sequence").desc(), "session_id").select("session_id", "event_id", "sequence")


@query("s8_upsert_nodes", f"{NODE}, u AS (SELECT node_id, CASE WHEN turn_number % 3 = 0 THEN 'resolved' ELSE status END AS status, turn_number FROM n) SELECT node_id, status, turn_number FROM u")
def _(s, d):
    nodes = log_nodes(s, d).select("session_id", "node_id", "status", "turn_number", F.lit(1).alias("version"))
    new = nodes.where("turn_number % 3 = 0").withColumns({"status": F.lit("resolved"), "version": F.lit(2)})
    return store.upsert(nodes, new, ["session_id", "node_id"], "version").select("node_id", "status", "turn_number")


@query("s9_nodes_by_session", f"{NODE} SELECT node_id, status FROM n WHERE session_id = '7' AND status IN ('archived')")
def _(s, d):
    return store.nodes_by_session(log_nodes(s, d), SESSION, "archived").select("node_id", "status")


@query("s10_nodes_by_parent", f"{NODE} SELECT node_id FROM n WHERE session_id = '7' AND parent_id = 'node_7_0003'")
def _(s, d):
    return store.nodes_by_parent(log_nodes(s, d), SESSION, "node_7_0003").select("node_id")


@query("s11_update_status", f"{NODE} SELECT node_id, CASE WHEN node_id = 'node_7_0002' THEN 'resolved' ELSE status END AS status, node_id = 'node_7_0002' AS changed FROM n")
def _(s, d):
    at = F.lit("2100-01-01").cast("timestamp")
    return store.set_status(log_nodes(s, d), SESSION, "node_7_0002", "resolved", at).select("node_id", "status", (F.col("updated_at") == at).alias("changed"))


@query("s12_archive_nodes", f"{NODE} SELECT node_id, CASE WHEN turn_number <= 10 THEN 'archived' ELSE status END AS status FROM n")
def _(s, d):
    nodes = log_nodes(s, d)
    return store.archive(nodes, nodes.where("turn_number <= 10")).select("node_id", "status")


VECTORS = "v AS (SELECT label::VARCHAR AS session_id, lpad(vec_id::VARCHAR, 9, '0') AS node_id, CASE WHEN vec_id % 2 = 0 THEN 'active' ELSE 'archived' END AS status, embedding FROM embeddings)"


@query("s13_live_embeddings", f"WITH {VECTORS} SELECT session_id, node_id, len(embedding) AS dim FROM v WHERE status <> 'archived' AND len(embedding) > 0")
def _(s, d):
    return store.node_embeddings(vector_nodes(s, d), False).select("session_id", "node_id", F.size("embedding").cast("long").alias("dim"))


@query("s14_archived_embeddings", f"WITH {VECTORS} SELECT session_id, node_id, len(embedding) AS dim FROM v WHERE status = 'archived' AND len(embedding) > 0")
def _(s, d):
    return store.node_embeddings(vector_nodes(s, d), True).select("session_id", "node_id", F.size("embedding").cast("long").alias("dim"))


@query("s15_branches_and_j7_rehydrate", f"{LOG}, b AS (SELECT session_id, 'branch_' || session_id AS branch_id, event_id FROM e WHERE sequence % 4 = 0) SELECT branch_id, event_id, sequence FROM b JOIN e USING (session_id, event_id)")
def _(s, d):
    e = log_events(s, d)
    branches = e.where("sequence % 4 = 0").groupBy("session_id").agg(F.collect_list("event_id").alias("raw_event_refs")).withColumn("branch_id", F.concat(F.lit("branch_"), "session_id"))
    return store.rehydrate(branches, e).select("branch_id", "event_id", "sequence")


@query("s16_latest_snapshot", f"{NODE} SELECT session_id, count(*) AS n_nodes, 'node_' || session_id || '_0001' AS first_node FROM n GROUP BY session_id")
def _(s, d):
    nodes = log_nodes(s, d)
    both = store.snapshot(nodes.where("turn_number <= 5"), F.lit(1)).unionByName(store.snapshot(nodes, F.lit(2)))
    return store.latest_snapshot(both).select("session_id", F.size("nodes").cast("long").alias("n_nodes"), F.col("nodes")[0]["node_id"].alias("first_node"))


@query("s15_branch_reads", f"{LOG}, b AS (SELECT session_id, 'branch_' || session_id AS branch_id, max(created_at) AS created_at FROM e GROUP BY 1) SELECT branch_id, session_id FROM b WHERE session_id = '7' UNION ALL SELECT branch_id, session_id FROM b WHERE branch_id = 'branch_8'")
def _(s, d):
    b = log_events(s, d).groupBy("session_id").agg(F.max("created_at").alias("created_at")).withColumn("branch_id", F.concat(F.lit("branch_"), "session_id"))
    return store.branches_by_session(b, SESSION).unionByName(store.branch_by_id(b, "branch_8")).select("branch_id", "session_id")


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    """Three snapshots of each session: its first five nodes, its first ten, all."""
    nodes = log_nodes(s, d)
    return store.snapshot(nodes.where("turn_number <= 5"), F.lit(1)).unionByName(store.snapshot(nodes.where("turn_number <= 10"), F.lit(2))).unionByName(store.snapshot(nodes, F.lit(3)))


@query("s16_snapshot_times", f"{NODE} SELECT DISTINCT session_id, unnest([3, 2])::INT AS snapshot_at FROM n")
def _(s, d):
    return store.snapshot_times(_snapshots(s, d), 2)


@query("g2_restore", f"{NODE} SELECT session_id, 'node_' || session_id || '_0001' AS root_id, max(turn_number) AS turn_count, count(*) FILTER (WHERE status = 'active') AS active, sum(token_count)::BIGINT AS tokens FROM n GROUP BY 1")
def _(s, d):
    nodes = store.restore(_snapshots(s, d))
    sums = nodes.groupBy("session_id").agg(F.count_if(F.col("status") == "active").alias("active"), F.sum("token_count").cast("long").alias("tokens"))
    return store.tree_state(nodes).join(sums, "session_id")


@query("s17_gc_history", f"{LOG} SELECT session_id, event_id FROM e WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, event_id DESC) <= 2")
def _(s, d):
    rows = log_events(s, d).where("event_type = 'error'").withColumn("at", F.struct("created_at", "event_id"))
    return store.recent(rows, 2, F.col("at").desc(), "session_id").select("session_id", "event_id")


@query("s18_session_metrics", f"{LOG} SELECT session_id, count(*) AS total_events, count(*) FILTER (WHERE event_type = 'user_prompt') AS total_turns, max(sequence) AS last_sequence FROM e GROUP BY 1")
def _(s, d):
    return log_events(s, d).groupBy("session_id").agg(F.count("*").alias("total_events"), F.count_if(F.col("event_type") == "user_prompt").alias("total_turns"), F.max("sequence").alias("last_sequence"))


@query("s19_list_sessions", f"{LOG} SELECT session_id FROM (SELECT session_id, min(created_at) AS t FROM e GROUP BY 1) ORDER BY t DESC, session_id LIMIT 10")
def _(s, d):
    return log_events(s, d).groupBy("session_id").agg(F.min("created_at").alias("t")).orderBy(F.desc("t"), "session_id").limit(10).select("session_id")


@query("s25_retention", f"{LOG} SELECT event_id FROM e WHERE created_at > (SELECT max(created_at) FROM e) - INTERVAL 7 DAYS")
def _(s, d):
    e = log_events(s, d)
    now = F.lit(e.agg(F.max("created_at")).first()[0])
    return store.retain(e, "created_at", 7, now).select("event_id")


# --- projections and text ------------------------------------------------------------


@texts_query("p1_classify", f" SELECT id, CASE WHEN event_type = 'user_prompt' THEN CASE WHEN regexp_matches(lower(payload), 'must|always|never|require|constraint') THEN 'constraint' ELSE 'goal' END WHEN event_type = 'tool_call' THEN 'attempt' WHEN event_type = 'tool_result' THEN 'tool_result' WHEN event_type = 'llm_response' THEN 'decision' WHEN event_type IN ('error', 'retry') THEN 'issue' ELSE 'background' END AS node_type FROM t")
def _(t):
    return t.select("id", text.classify(F.col("event_type"), F.col("payload")).alias("node_type"))


@query("p1_classify_log", f"{NODE} SELECT node_type, count(*) AS n FROM n GROUP BY 1")
def _(s, d):
    return log_nodes(s, d).groupBy("node_type").agg(F.count("*").alias("n"))


CUT = lambda c, n: f"CASE WHEN strlen({c}) > {n} THEN left({c}, {n}) || '...' ELSE {c} END"
TITLE, SUMMARY = f"'[' || event_type || '] ' || {CUT('payload', 80)}", CUT("payload", 500)


@query("p3_titles_and_p4_summaries", f"{CONV} SELECT session_id, sequence, {TITLE} AS title, {SUMMARY} AS summary FROM c")
def _(s, d):
    return conversation_events(s, d).select("session_id", "sequence", text.title(F.col("event_type"), F.col("payload")).alias("title"), text.summary(F.col("payload")).alias("summary"))


@query("p5_embedding_payload", f"{CONV} SELECT session_id, sequence, {TITLE} || ': ' || {SUMMARY} AS payload FROM c WHERE payload <> ''")
def _(s, d):
    e = conversation_events(s, d).where("payload <> ''")
    return e.select("session_id", "sequence", text.embedding_payload(text.title(F.col("event_type"), F.col("payload")), text.summary(F.col("payload")), F.col("payload")).alias("payload"))


@query("p6_role_types", f"{CONV} SELECT role, event_type, count(*) AS n FROM c GROUP BY ALL")
def _(s, d):
    return conversation_events(s, d).groupBy("role", "event_type").agg(F.count("*").alias("n"))


@query("p7_history_nodes", f"{CONV} SELECT session_id, 'turn_' || (sequence - 1) AS node_id, CASE WHEN role = 'assistant' THEN 'decision' ELSE 'goal' END AS node_type, sequence - 1 AS turn_number FROM c")
def _(s, d):
    return conversation_events(s, d).select("session_id", F.concat(F.lit("turn_"), (F.col("sequence") - 1).cast("string")).alias("node_id"), F.when(F.col("role") == "assistant", "decision").otherwise("goal").alias("node_type"), (F.col("sequence") - 1).alias("turn_number"))


@query("p8_active_p9_defer_p10_compressible", f"{NODE} SELECT session_id, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE len(decisions) > 0) AS deferred, count(*) FILTER (WHERE node_type NOT IN ('goal', 'constraint')) AS compressible FROM n GROUP BY 1")
def _(s, d):
    return log_nodes(s, d).groupBy("session_id").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if((F.size("facts") > 0) | (F.size("decisions") > 0)).alias("deferred"), F.count_if(~F.col("node_type").isin("goal", "constraint")).alias("compressible"))


@query("p11_history_slice", f"{CONV}, k AS (SELECT session_id, count(*) AS n FROM c GROUP BY 1) SELECT session_id, sequence FROM c JOIN k USING (session_id) WHERE NOT (3 < n) OR sequence <= 3")
def _(s, d):
    e = conversation_events(s, d)
    n = F.count("*").over(Window.partitionBy("session_id"))
    return e.withColumn("n", n).where(~(F.lit(3) < F.col("n")) | (F.col("sequence") <= 3)).select("session_id", "sequence")


@query("p12_wire_messages", f"{CONV} SELECT session_id, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) + 1 AS messages FROM c GROUP BY 1")
def _(s, d):
    rows = conversation_events(s, d).groupBy("session_id").agg(F.max(F.when(F.col("role") == "system", F.col("payload"))).alias("system"), F.max_by("payload", "sequence").alias("question"))
    return rows.select("session_id", F.size(prompts.wire_messages(F.col("system"), F.lit(""), F.col("question"))).alias("messages"))


ALIASES = "['naive', 'window', 'baseline', 'sliding', 'full', 'managed', 'sliding_window', '', 'full_history']"


@query("p13_reference_first", f"""WITH a AS (SELECT doc_id % 7 AS scenario_id, doc_id AS place, ({ALIASES})[1 + (doc_id * 13) % 9] AS name FROM labels),
  k AS (SELECT scenario_id, place, CASE WHEN name IN ('naive', 'baseline', 'full', 'full_history') THEN 'naive_full_history' WHEN name IN ('sliding', 'window', 'sliding_window') THEN 'sliding_window' ELSE name END AS strategy FROM a WHERE name <> ''),
  f AS (SELECT scenario_id, strategy, min(place) AS place FROM k GROUP BY ALL)
  SELECT scenario_id, strategy, (row_number() OVER (PARTITION BY scenario_id ORDER BY place))::INTEGER AS place, row_number() OVER (PARTITION BY scenario_id ORDER BY place) = 1 AS is_reference FROM f""")
def _(s, d):
    names = F.array(*(F.lit(x) for x in ("naive", "window", "baseline", "sliding", "full", "managed", "sliding_window", "", "full_history")))
    asked = table(s, d, "labels").select((F.col("doc_id") % 7).alias("scenario_id"), F.col("doc_id").alias("place"), F.get(names, F.col("doc_id") * 13 % 9).alias("name"))
    return evaluate.chosen_strategies(asked, ["scenario_id"])


@query("p14_effective_budget", f"{LOG}, r AS (SELECT session_id, sequence, CASE WHEN sequence % 9 = 0 THEN sequence * 100 ELSE 0 END AS asked FROM e) SELECT session_id, sequence, coalesce(last_value(nullif(asked, 0) IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY sequence), 6000) AS budget FROM r")
def _(s, d):
    e = log_events(s, d).select("session_id", "sequence", F.when(F.col("sequence") % 9 == 0, F.col("sequence") * 100).alias("asked"))
    return e.select("session_id", "sequence", F.coalesce(F.last("asked", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("sequence")), F.lit(6000)).alias("budget"))


MODELS = "['gpt-5-mini', 'o1', 'gpt-4o', 'gpt-4', '', 'o3-x', 'gpt-3.5', 'chatgpt-4o', 'o4-mini']"


@query("p15_f40_models", f"""WITH m AS (SELECT event_id, ({MODELS})[1 + event_id % 9] || CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS model FROM events)
  SELECT event_id, model, regexp_matches(model, '^(o1|o3|gpt-5)') AS reasoning, CASE WHEN model = '' OR regexp_matches(model, '^(gpt-4o|gpt-5|o1|o3|o4)') THEN 'o200k_base' ELSE 'cl100k_base' END AS encoding FROM m""")
def _(s, d):
    names = F.array(*(F.lit(x) for x in ("gpt-5-mini", "o1", "gpt-4o", "gpt-4", "", "o3-x", "gpt-3.5", "chatgpt-4o", "o4-mini")))
    m = table(s, d, "events").select("event_id", F.concat(F.get(names, F.col("event_id") % 9), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type"))).alias("model"))
    return m.select("event_id", "model", text.is_reasoning_model(F.col("model")).alias("reasoning"), text.encoding_for_model(F.col("model")).alias("encoding"))


@query("p15_transient", "SELECT event_id, regexp_matches(m, 'status (429|500|502|503|504)|timeout|deadline exceeded|connection reset|EOF') AND NOT contains(m, 'insufficient_quota') AS transient FROM (SELECT event_id, 'status ' || (400 + event_id % 110) || CASE WHEN event_id % 13 = 0 THEN ' insufficient_quota' ELSE '' END || CASE WHEN event_id % 17 = 0 THEN ' timeout' ELSE '' END AS m FROM events)")
def _(s, d):
    n = F.col("event_id")
    message = F.concat(F.lit("status "), (400 + n % 110).cast("string"), F.when(n % 13 == 0, " insufficient_quota").otherwise(""), F.when(n % 17 == 0, " timeout").otherwise(""))
    return table(s, d, "events").select("event_id", text.is_transient(message).alias("transient"))


@query("f1_tokens", f"{CONV} SELECT session_id, sequence, token_count FROM c")
def _(s, d):
    return conversation_events(s, d).select("session_id", "sequence", "token_count")


@query("f2_message_tokens", f"{CONV} SELECT session_id, (3 + sum(strlen(role) // 4 + token_count + 3))::BIGINT AS tokens FROM c GROUP BY 1")
def _(s, d):
    e = conversation_events(s, d).groupBy("session_id").agg(F.collect_list(F.struct("role", F.col("payload").alias("content"))).alias("m"))
    return e.select("session_id", text.message_tokens(F.col("m")).alias("tokens"))


TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
DEDUPE = lambda c: f"(list_filter({c}, lambda x, i: list_position(list_transform({c}, lambda y: lower(y)), lower(x)) = i))[1:16]"
_LEX = "['TimescaleDB', 'JetStream', 'InfluxDB', 'PostgreSQL', 'MongoDB', 'Kafka', 'Kubernetes', 'CockroachDB', 'Cockroach', 'RabbitMQ', 'DataMatrix']"
REFS = lambda c: (
    f"list_concat(list_filter({_LEX}, lambda k: contains(lower({c}), lower(k))), list_filter([regexp_extract({c}, '(?i)(?:^|[^A-Za-z0-9_])(NATS)(?:$|[^A-Za-z0-9_])', 1), "
    f"regexp_extract({c}, '(?i)(?:^|[^A-Za-z0-9_])(Hetzner)(?:$|[^A-Za-z0-9_])', 1)], lambda k: k <> ''))"
)


@texts_query("f3_user_facts", f""", l AS (SELECT id, payload, unnest(string_split(payload, chr(10))) AS line, generate_subscripts(string_split(payload, chr(10)), 1) AS k FROM t WHERE event_type = 'user_prompt'),
m AS (SELECT id, payload, k, {TRIM('line')} AS line FROM l),
p AS (SELECT id, any_value(payload) AS payload, flatten(list(list_concat(CASE WHEN starts_with(lower(line), 'decision') AND regexp_extract(line, '(?im)^\\s*decision\\s*\\d+\\s*[:-]\\s*(.+)$', 1) <> '' THEN [regexp_extract(line, '(?im)^\\s*decision\\s*\\d+\\s*[:-]\\s*(.+)$', 1)] ELSE [] END, {REFS('line')}) ORDER BY k)) AS found FROM m GROUP BY id),
q AS (SELECT id, list_filter(list_transform(list_concat(found, regexp_extract_all(payload, '(?i)\\b(ADR[-_]?\\d+)\\b', 1)), lambda z: {TRIM('z')}), lambda z: z <> '') AS f FROM p)
SELECT id, array_to_string({DEDUPE('f')}, '|') AS facts FROM q""")
def _(t):
    return t.where("event_type = 'user_prompt'").select("id", F.array_join(text.user_facts(F.col("payload")), "|").alias("facts"))


FIRST = f"""left(CASE WHEN contains(w, chr(10)) THEN {TRIM("regexp_extract(w, '^([^' || chr(10) || ']*)' || chr(10), 1)")}
  ELSE coalesce({TRIM("left(w, (list_filter(range(1, length(w) + 1), lambda i: substr(w, i, 1) = '.' AND substr(w, i + 1, 1) IN ('', ' ') AND strlen(regexp_replace(left(w, i - 1), '^\\s+|\\s+$', '', 'g')) > 30))[1] - 1)")}, w) END, 220)"""


@texts_query("f4_f5_assistant_decisions", f""", a AS (SELECT id, {TRIM('payload')} AS w FROM t WHERE event_type = 'llm_response' AND {TRIM('payload')} <> ''),
n AS (SELECT id, w, list_filter(list_transform(string_split(w, chr(10)), lambda z: {TRIM('z')}), lambda z: starts_with(lower(z), 'noted')) AS lines FROM a),
f AS (SELECT id, w, list_filter(list_transform(lines, lambda z: {TRIM("CASE WHEN contains(z, ':') THEN substr(z, strpos(z, ':') + 1) WHEN starts_with(lower(z), 'noted -') THEN substr(z, 8) ELSE z END")}), lambda z: z <> '' AND lower(z) <> 'noted') AS found FROM n),
g AS (SELECT id, CASE WHEN len(found) > 0 THEN found ELSE [{TRIM(FIRST)}] END AS f FROM f)
SELECT id, array_to_string({DEDUPE('f')}, '|') AS decisions FROM g""")
def _(t):
    t = t.where((F.col("event_type") == "llm_response") & (text.trimmed(F.col("payload")) != ""))
    return t.select("id", F.array_join(text.assistant_decisions(F.col("payload")), "|").alias("decisions"))


@query("f5_first_sentences", f"{CONV}, a AS (SELECT session_id, sequence, {TRIM('payload')} AS w FROM c WHERE event_type = 'llm_response') SELECT session_id, sequence, {FIRST} AS sentence FROM a")
def _(s, d):
    e = conversation_events(s, d).where("event_type = 'llm_response'")
    return e.select("session_id", "sequence", text.first_sentence(F.col("payload")).alias("sentence"))


@texts_query("f7_f8_lexicon", f" SELECT id, array_to_string({REFS('payload')}, '|') AS refs FROM t")
def _(t):
    return t.select("id", F.array_join(text.lexicon_refs(F.col("payload")), "|").alias("refs"))


@texts_query("f9_extract_routing", f", r AS (SELECT id, event_type, payload, list_filter({REFS('payload')}, lambda z: z <> '') AS f FROM t WHERE event_type <> 'user_prompt') SELECT id, CASE WHEN {TRIM('payload')} = '' THEN '' ELSE array_to_string({DEDUPE('f')}, '|') END AS facts, event_type = 'llm_response' AND {TRIM('payload')} <> '' AS has_decisions FROM r")
def _(t):
    facts, decisions = text.extract(F.col("event_type"), F.col("payload"))
    return t.where("event_type <> 'user_prompt'").select("id", F.array_join(facts, "|").alias("facts"), (F.size(decisions) > 0).alias("has_decisions"))


@query("f10_facts_prefix", f"""{CONV}, f AS (SELECT session_id, sequence, (string_split(payload, ' '))[1:(sequence % 4)::INT] AS facts FROM c)
  SELECT session_id, sequence, CASE WHEN len(facts) > 0 THEN 'Verified facts (verbatim): ' || array_to_string(facts, ', ') || chr(10) || chr(10) ELSE '' END AS prefix FROM f""")
def _(s, d):
    facts = F.slice(F.split("payload", " "), F.lit(1), (F.col("sequence") % 4).cast("int"))
    return conversation_events(s, d).select("session_id", "sequence", text.facts_prefix(facts).alias("prefix"))


@query("f11_entities_line", f"""{CONV}, r AS (SELECT *, sequence % 2 = 0 AS has FROM c)
  SELECT session_id, sequence, {TRIM('payload')} AS body, CASE WHEN has THEN 'N' || session_id || '|T' || sequence ELSE '' END AS names FROM r""")
def _(s, d):
    names = F.concat(F.lit("\nEntities: N"), "session_id", F.lit(", n"), "session_id", F.lit(",, T"), "sequence", F.lit(" ,t"), "sequence")
    reply = F.concat("payload", F.when(F.col("sequence") % 2 == 0, names).otherwise(""))
    body, found = text.entities_line(reply)
    return conversation_events(s, d).select("session_id", "sequence", body.alias("body"), F.array_join(found, "|").alias("names"))


@query("f36_prompt_hash", f"{CONV} SELECT session_id, sequence, CASE WHEN payload = '' THEN 'empty' ELSE left(sha256(payload), 16) END AS hash FROM c")
def _(s, d):
    return conversation_events(s, d).select("session_id", "sequence", text.prompt_hash(F.col("payload")).alias("hash"))


@query("f37_needles", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(text), 'der')")
def _(s, d):
    c = table(s, d, "conversations")
    return c.where(text.contains_any(F.col("text"), ["the", "der"])).select("conv_id", "turn")


@query("f39_preview", "SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN left(text, 40) || '... (' || (length(text) - 40) || ' more)' ELSE text END AS preview FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.preview(F.col("text"), 40).alias("preview"))


@query("f42_cached_tokens", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id * 64 ELSE 0 END::BIGINT AS cached FROM events")
def _(s, d):
    usage = F.concat(F.lit('{"id":1,"usage":{"prompt_tokens":9,"prompt_tokens_details":{"cached_tokens":'), F.col("event_id") * 64, F.lit("}}}"))
    body = F.when(F.col("event_id") % 3 == 0, usage).when(F.col("event_id") % 3 == 1, '{"usage":{}}').otherwise(F.concat(F.lit("no json "), "props"))
    return table(s, d, "events").select("event_id", evaluation.cached_tokens(body).alias("cached"))


# --- scoring and collection -----------------------------------------------------------

PRIORITY = "CASE node_type WHEN 'goal' THEN 1.0 WHEN 'constraint' THEN 0.95 WHEN 'decision' THEN 0.8 WHEN 'issue' THEN 0.7 WHEN 'summary' THEN 0.6 WHEN 'compressed_branch' THEN 0.6 WHEN 'tool_result' THEN 0.5 WHEN 'attempt' THEN 0.4 WHEN 'background' THEN 0.2 ELSE 0.3 END::DOUBLE"


def scored_sql(source: str = "n", stale: int = 15, size: int = 2000, issues: str = "0") -> str:
    return f"""s AS (SELECT *, max(turn_number) OVER (PARTITION BY session_id) - turn_number AS distance FROM {source}),
dep AS (SELECT session_id, d AS node_id, count(*) AS dependents FROM (SELECT DISTINCT session_id, node_id AS other, unnest(dependencies) AS d FROM s WHERE status = 'active') WHERE d <> other GROUP BY 1, 2),
a AS (SELECT s.*, exp(-0.1 * distance) AS recency, {PRIORITY} AS type_priority, least(0.3 * coalesce(dependents, 0), 1)::DOUBLE AS dependency_weight,
  CASE WHEN {issues} > 0 AND status = 'active' THEN 1.0 ELSE 0.0 END::DOUBLE AS unresolved_boost,
  CASE WHEN count(*) OVER (PARTITION BY s.session_id, lower(title)) > 1 THEN least(0.3 * (count(*) OVER (PARTITION BY s.session_id, lower(title)) - 1), 1) ELSE 0 END::DOUBLE AS redundancy,
  CASE WHEN status = 'resolved' THEN 1.0 ELSE 0.0 END::DOUBLE AS resolved_penalty,
  CASE WHEN distance > {stale} THEN least((distance - {stale}) / {stale}.0, 1) ELSE 0 END::DOUBLE AS stale_penalty,
  CASE WHEN token_count > {size} THEN least(token_count / {size}.0 - 1, 1) ELSE 0 END::DOUBLE AS size_penalty
  FROM s LEFT JOIN dep USING (session_id, node_id) WHERE status IN ('active', 'resolved')),
x AS (SELECT *, greatest(0, least(1, 0.25 * recency + 0.2 * type_priority + 0.15 * dependency_weight + 0.15 * unresolved_boost - 0.1 * redundancy - 0.2 * resolved_penalty - 0.15 * stale_penalty - 0.05 * size_penalty))::DOUBLE AS retention_score FROM a)"""


SCORED = f"{NODE}, {scored_sql()}"


@query("f12_f21_scores", f"{SCORED} SELECT node_id, round(recency, 9) AS recency, type_priority, round(dependency_weight, 9) AS dependency_weight, round(redundancy, 9) AS redundancy, round(stale_penalty, 9) AS stale_penalty, round(retention_score, 9) AS retention_score FROM x")
def _(s, d):
    x = scoring.score_nodes(log_nodes(s, d))
    return x.select("node_id", F.round("recency", 9).alias("recency"), "type_priority", F.round("dependency_weight", 9).alias("dependency_weight"), F.round("redundancy", 9).alias("redundancy"), F.round("stale_penalty", 9).alias("stale_penalty"), F.round("retention_score", 9).alias("retention_score"))


@query("f15_f19_injected_scores", f"{RICH}, {scored_sql('i', size=100, issues='len(open_issues)')} SELECT node_id, unresolved_boost, resolved_penalty, round(size_penalty, 9) AS size_penalty, round(dependency_weight, 9) AS dependency_weight, round(retention_score, 9) AS retention_score FROM x")
def _(s, d):
    x = scoring.score_nodes(rich_nodes(s, d), Policy(max_node_tokens=100))
    return x.select("node_id", "unresolved_boost", "resolved_penalty", F.round("size_penalty", 9).alias("size_penalty"), F.round("dependency_weight", 9).alias("dependency_weight"), F.round("retention_score", 9).alias("retention_score"))


@query("j1_children", f"{NODE} SELECT session_id, parent_id, count(*) AS children, min(node_id) AS first_child FROM n WHERE parent_id <> '' GROUP BY ALL")
def _(s, d):
    return log_nodes(s, d).where("parent_id <> ''").groupBy("session_id", "parent_id").agg(F.count("*").alias("children"), F.min("node_id").alias("first_child"))


@query("j2_dependency_weight", f"{NODE}, {scored_sql()} SELECT session_id, node_id, dependents FROM dep")
def _(s, d):
    return scoring.dependency_weight(log_nodes(s, d))


@query("j5_swept_ids", f"{SCORED} SELECT session_id, node_id FROM x WHERE len(decisions) = 0 AND retention_score < 0.3")
def _(s, d):
    nodes = log_nodes(s, d)
    after = gc.sweep(nodes, gc.mark(nodes))
    was, now = nodes.where("status = 'active'").select("session_id", "node_id"), after.where("status = 'active'").select("session_id", "node_id")
    return was.join(now, ["session_id", "node_id"], "left_anti")


@query("j9_orphans", f"""{RICH}, d AS (SELECT session_id, node_id, turn_number, unnest(dependencies) AS dep FROM i WHERE status = 'active')
  SELECT DISTINCT node_id, dep FROM d WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.session_id = d.session_id AND i.node_id = d.dep AND i.turn_number <= d.turn_number)""")
def _(s, d):
    return gc.orphans(rich_nodes(s, d)).select("node_id", "dep")


@query("a6_tree_stats", f"{NODE}, w AS (SELECT session_id, max(k) AS max_width FROM (SELECT session_id, parent_id, count(*) AS k FROM n WHERE parent_id <> '' GROUP BY ALL) GROUP BY 1) SELECT session_id, count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'compressed') AS compressed, count(*) FILTER (WHERE status = 'archived') AS archived, any_value(max_width) AS max_width FROM n JOIN w USING (session_id) GROUP BY 1")
def _(s, d):
    return gc.tree_stats(log_nodes(s, d))


DEPTH = "dep_t AS (SELECT session_id, node_id, 0 AS depth FROM n WHERE parent_id = '' UNION ALL SELECT n.session_id, n.node_id, depth + 1 FROM n JOIN dep_t t ON n.session_id = t.session_id AND n.parent_id = t.node_id)"


@query("a7_tree_depth", f"{RNODE}, {DEPTH} SELECT session_id, max(depth)::BIGINT AS max_depth FROM dep_t GROUP BY 1")
def _(s, d):
    return gc.tree_depth(log_nodes(s, d))


@query("a8_title_index", f"{NODE} SELECT node_id, count(*) OVER (PARTITION BY session_id, lower(title)) AS n FROM n")
def _(s, d):
    return gc.title_counts(log_nodes(s, d)).select("node_id", "n")


@query("a9_a10_active_load", f"{SCORED} SELECT session_id, sum(token_count)::BIGINT AS tokens, round(avg(retention_score), 9) AS mean FROM x GROUP BY 1")
def _(s, d):
    return scoring.score_nodes(log_nodes(s, d)).groupBy("session_id").agg(F.sum("token_count").alias("tokens"), F.round(F.avg("retention_score"), 9).alias("mean"))


@query("g7_should_run", f"""{RNODE}, {scored_sql()}, {DEPTH},
t AS (SELECT session_id, max(depth) AS depth FROM dep_t GROUP BY 1),
w AS (SELECT session_id, max(k) AS width FROM (SELECT session_id, parent_id, count(*) AS k FROM n WHERE parent_id <> '' GROUP BY ALL) GROUP BY 1),
g AS (SELECT session_id, sum(token_count) AS tokens, count(*) AS active, avg(retention_score) AS mean FROM x GROUP BY 1)
SELECT session_id, CASE WHEN tokens > 700 THEN 'token_pressure' WHEN tokens > floor(700 * 0.6) THEN 'soft_headroom' WHEN active > 45 THEN 'active_count' WHEN depth > 10 THEN 'tree_depth' WHEN width > 50 THEN 'tree_width' WHEN mean < 0.3 THEN 'low_relevance' END AS reason FROM g JOIN t USING (session_id) LEFT JOIN w USING (session_id)""")
def _(s, d):
    return gc.should_run(log_nodes(s, d), Policy(budget=700, max_active=45))


@query("g8_g9_mark_and_sweep", f"{SCORED} SELECT session_id, count(*) FILTER (WHERE retention_score < 0.3) AS swept, coalesce(sum(token_count) FILTER (WHERE retention_score < 0.3), 0)::BIGINT AS freed FROM x WHERE len(decisions) = 0 GROUP BY 1")
def _(s, d):
    return gc.mark(log_nodes(s, d)).groupBy("session_id").agg(F.count_if("sweep").alias("swept"), F.coalesce(F.sum(F.when(F.col("sweep"), F.col("token_count"))), F.lit(0)).cast("long").alias("freed"))


MARKED = """m AS (SELECT *, retention_score < 0.3 AS sweep FROM x WHERE len(facts) = 0 AND len(decisions) = 0),
p AS (SELECT session_id, parent_id FROM m WHERE parent_id <> '' GROUP BY ALL HAVING (count(*) >= 4 OR count(*) FILTER (WHERE NOT sweep AND status = 'active') = 0) AND count(*) FILTER (WHERE node_type NOT IN ('goal', 'constraint')) >= 3)"""


@query("g10_g11_compact", f"""{RICH}, {scored_sql('i', issues='len(open_issues)')}, {MARKED},
k AS (SELECT session_id, parent_id, list(node_id ORDER BY turn_number, node_id) AS ids, list(summary ORDER BY turn_number, node_id) AS parts, sum(token_count)::BIGINT AS original_tokens FROM m JOIN p USING (session_id, parent_id) WHERE node_type NOT IN ('goal', 'constraint') GROUP BY ALL),
z AS (SELECT session_id, parent_id, array_to_string(ids, ',') AS children, 'Compressed branch: ' || CASE WHEN len(parts) > 3 THEN parts[1] || ' ... ' || parts[-1] ELSE array_to_string(parts, ' | ') END AS summary, original_tokens FROM k)
SELECT *, (strlen(summary) // 4)::BIGINT AS compressed_tokens FROM z""")
def _(s, d):
    return gc.compact(gc.mark(rich_nodes(s, d), Policy(max_children=4)), Policy(max_children=4)).select("session_id", "parent_id", F.array_join("child_ids", ",").alias("children"), "summary", "original_tokens", "compressed_tokens")


@query("g13_collect_injected", f"""{RICH}, {scored_sql('i', issues='len(open_issues)')}, {MARKED}
SELECT i.session_id, (SELECT count(*) FROM m WHERE m.session_id = i.session_id AND sweep) AS swept, (SELECT count(*) FROM p WHERE p.session_id = i.session_id) AS branches FROM (SELECT DISTINCT session_id FROM i) i""")
def _(s, d):
    return gc.collect_garbage(rich_nodes(s, d), Policy(max_children=4))[2].select("session_id", "swept", "branches")


# --- aggregates and windows -----------------------------------------------------------


@query("a1_a2_event_counts", f"{LOG} SELECT session_id, event_type, count(*) AS n FROM e GROUP BY ALL")
def _(s, d):
    return store.count_by_type(log_events(s, d))


@query("a3_token_usage", f"{LOG} SELECT session_id, sum(token_count)::BIGINT AS tokens FROM e GROUP BY 1")
def _(s, d):
    return store.token_usage(log_events(s, d))


@query("a4_compression_stats", f"{LOG} SELECT session_id, sum(token_count)::BIGINT AS original_tokens, sum(token_count // 3)::BIGINT AS compressed_tokens FROM e GROUP BY 1")
def _(s, d):
    return store.compression_stats(log_events(s, d).select("session_id", F.col("token_count").alias("original_token_count"), F.expr("token_count div 3").alias("compressed_token_count")))


@query("a5_gc_summary", f"{LOG} SELECT session_id, count(*) AS runs, sum(sequence)::BIGINT AS swept, sum(token_count)::BIGINT AS freed FROM e WHERE event_type = 'error' GROUP BY 1")
def _(s, d):
    return store.gc_summary(log_events(s, d).where("event_type = 'error'").select("session_id", F.col("sequence").alias("nodes_swept"), F.col("token_count").alias("tokens_freed")))


SCORES_SQL = "r AS (SELECT 'sc' || (doc_id % 7) AS scenario_id, 'p' || doc_id AS probe_id, s.strategy, CASE WHEN strategy = 'naive' THEN 5.0 * quality ELSE (doc_id % 11) / 2.0 END::DOUBLE AS score, CASE WHEN strategy = 'naive' THEN 4000 + doc_id % 100 ELSE 1000 + doc_id % 900 END::BIGINT AS tokens FROM labels, (VALUES ('naive'), ('sliding'), ('managed')) s(strategy) WHERE NOT (strategy = 'sliding' AND doc_id % 2 = 0))"
PAIR_SQL = """IPT AS (SELECT a.scenario_id, a.probe_id, b.strategy AS strategy_cand, a.score AS score_ref, b.score AS score_cand, a.tokens AS tokens_ref, b.tokens AS tokens_cand, a.score * 1000 / a.tokens AS ipt_ref, b.score * 1000 / b.tokens AS ipt_cand FROM r a JOIN r b USING (scenario_id, probe_id) WHERE a.strategy = 'naive' AND b.strategy <> 'naive'),
q AS (SELECT *, ipt_cand - ipt_ref AS ipt_delta, CASE WHEN ipt_ref > 0 THEN (ipt_cand - ipt_ref) * 100 / ipt_ref ELSE 0 END AS ipt_delta_pct, score_cand - score_ref AS quality_delta, (tokens_ref - tokens_cand) * 100.0 / tokens_ref AS token_reduction_pct FROM IPT),
pairs AS (SELECT *, CASE WHEN quality_delta >= -0.5 AND ipt_delta > 0 THEN 'win' WHEN quality_delta < -0.5 AND ipt_delta > 0 THEN 'win-star' WHEN quality_delta > 0.5 AND ipt_delta < 0 THEN 'baseline-win' WHEN quality_delta < -1 THEN 'loss' ELSE 'tie' END AS verdict FROM q)"""


def answers(s: SparkSession, d: str) -> DataFrame:
    """Scored answers of three strategies made from labels; one lacks half the probes."""
    rows = table(s, d, "labels").withColumn("strategy", F.explode(F.array(*(F.lit(x) for x in ("naive", "sliding", "managed")))))
    rows = rows.where(~((F.col("strategy") == "sliding") & (F.col("doc_id") % 2 == 0)))
    naive = F.col("strategy") == "naive"
    return rows.select(
        F.concat(F.lit("sc"), (F.col("doc_id") % 7).cast("string")).alias("scenario_id"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("probe_id"),
        "strategy",
        F.when(naive, 5.0 * F.col("quality")).otherwise((F.col("doc_id") % 11) / 2.0).alias("score"),
        F.when(naive, 4000 + F.col("doc_id") % 100).otherwise(1000 + F.col("doc_id") % 900).alias("tokens"),
    )


@query("j6_f27_f29_pairs", f"WITH {SCORES_SQL}, {PAIR_SQL} SELECT scenario_id, probe_id, strategy_cand, round(ipt_ref, 6) AS ipt_ref, round(ipt_cand, 6) AS ipt_cand, round(ipt_delta_pct, 6) AS ipt_delta_pct, quality_delta, round(token_reduction_pct, 6) AS token_reduction_pct, verdict FROM pairs")
def _(s, d):
    p = evaluate.pairs(answers(s, d), "naive")
    return p.select("scenario_id", "probe_id", "strategy_cand", F.round("ipt_ref", 6).alias("ipt_ref"), F.round("ipt_cand", 6).alias("ipt_cand"), F.round("ipt_delta_pct", 6).alias("ipt_delta_pct"), "quality_delta", F.round("token_reduction_pct", 6).alias("token_reduction_pct"), "verdict")


@query("a11_pair_aggregate", f"WITH {SCORES_SQL}, {PAIR_SQL} SELECT count(*) AS pairs, count(*) FILTER (WHERE verdict = 'win') AS wins, count(*) FILTER (WHERE verdict = 'win-star') AS wins_star, count(*) FILTER (WHERE verdict = 'tie') AS ties, count(*) FILTER (WHERE verdict = 'loss') AS losses, count(*) FILTER (WHERE verdict = 'baseline-win') AS baseline_wins, round(avg(token_reduction_pct), 6) AS token_reduction_pct, count(*) FILTER (WHERE quality_delta < -1) AS regressions, round(avg(score_cand) - avg(score_ref), 6) AS quality_delta, round((avg(ipt_cand) - avg(ipt_ref)) * 100 / avg(ipt_ref), 6) AS ipt_delta_pct FROM pairs")
def _(s, d):
    a = evaluate.aggregate_pairs(evaluate.pairs(answers(s, d), "naive"))
    return a.select("pairs", "wins", "wins_star", "ties", "losses", "baseline_wins", F.round("token_reduction_pct", 6).alias("token_reduction_pct"), "regressions", F.round("quality_delta", 6).alias("quality_delta"), F.round("ipt_delta_pct", 6).alias("ipt_delta_pct"))


@query("k10_report", f"WITH {SCORES_SQL}, {PAIR_SQL} SELECT scenario_id, probe_id, strategy_cand, verdict FROM pairs ORDER BY scenario_id, probe_id, strategy_cand")
def _(s, d):
    return evaluate.report(evaluate.pairs(answers(s, d), "naive")).select("scenario_id", "probe_id", "strategy_cand", "verdict")


@query("a12_strategy_aggregate", f"WITH {SCORES_SQL}, m AS (SELECT strategy, count(*) AS probes, avg(score) AS quality, avg(tokens) AS t, avg(score * 1000 / tokens) AS ipt FROM r GROUP BY 1), f AS (SELECT quality AS rq, t AS rt, ipt AS ri FROM m WHERE strategy = 'naive') SELECT strategy, probes, round(quality, 6) AS quality, round(ipt, 6) AS ipt, round(CASE WHEN strategy <> 'naive' THEN quality - rq ELSE 0 END, 6) AS quality_delta, round(CASE WHEN strategy <> 'naive' THEN (rt - t) * 100 / rt ELSE 0 END, 6) AS token_reduction_pct, round(CASE WHEN strategy <> 'naive' THEN (ipt - ri) * 100 / ri ELSE 0 END, 6) AS ipt_delta_pct FROM m, f")
def _(s, d):
    a = evaluate.aggregate_strategies(answers(s, d), "naive")
    return a.select("strategy", "probes", *(F.round(c, 6).alias(c) for c in ("quality", "ipt", "quality_delta", "token_reduction_pct", "ipt_delta_pct")))


@query("a15_scenario_totals", "SELECT 'sc' || (user_id % 5) AS scenario_id, event_type AS pipeline, sum(event_id % 100)::BIGINT AS prompt_tokens, sum(user_id)::BIGINT AS output_tokens, count(*)::BIGINT AS latency_ms FROM events GROUP BY ALL")
def _(s, d):
    e = table(s, d, "events")
    rows = e.select(F.concat(F.lit("sc"), (F.col("user_id") % 5).cast("string")).alias("scenario_id"), F.col("event_type").alias("pipeline"), (F.col("event_id") % 100).alias("prompt_tokens"), F.col("user_id").alias("output_tokens"), F.lit(1).alias("latency_ms"))
    return evaluate.scenario_totals(rows)


@query("a17_running_metrics", f"{LOG} SELECT session_id, count(*) AS total_events, count(*) FILTER (WHERE event_type = 'user_prompt') AS total_turns, sum(token_count)::BIGINT AS tokens FROM e GROUP BY 1")
def _(s, d):
    from quillon.streaming.sessions import running_metrics

    return running_metrics(log_events(s, d))


@query("a19_prompt_stability", f"{LOG}, p AS (SELECT session_id, sequence AS turn_number, event_type AS prompt, token_count FROM e), q AS (SELECT *, coalesce(lag(prompt) OVER (PARTITION BY session_id ORDER BY turn_number) = prompt, false) AS same FROM p) SELECT session_id, sum(token_count)::BIGINT AS compiled, sum(token_count // 2)::BIGINT AS cached, sum(CASE WHEN turn_number > 1 THEN token_count // 2 ELSE 0 END)::BIGINT AS cached_later, count(*) FILTER (WHERE same) AS stable_turns FROM q GROUP BY 1")
def _(s, d):
    rows = log_events(s, d).select("session_id", F.col("sequence").alias("turn_number"), F.col("event_type").alias("prompt"), F.col("token_count").alias("compiled_tokens"), F.expr("token_count div 2").alias("cached_tokens"))
    return evaluate.prompt_stability(rows)


@query("a20_latency_percentiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events WHERE event_id % 10 >= 2 AND event_type <> 'error' GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").select("event_type", "value", (F.col("event_id") % 10).alias("iter"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    p = evaluate.percentiles(e, F.col("value"), ["event_type"], 2, "iter", "error")
    return p.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query("a20_lineitem_percentiles", "SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1")
def _(s, d):
    p = evaluate.percentiles(table(s, d, "lineitem"), F.col("l_extendedprice"), ["l_returnflag"])
    return p.select("l_returnflag", "n", *(F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")))


@query("a21_warnings", "SELECT count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'view' AND value IS NULL) AS missing, count(*) FILTER (WHERE event_type = 'click') AS fallback FROM events")
def _(s, d):
    return table(s, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if((F.col("event_type") == "view") & F.col("value").isNull()).alias("missing"), F.count_if(F.col("event_type") == "click").alias("fallback"))


@query("w1_w2_w4_raw_growth", f"{LOG} SELECT session_id, sequence, sequence::INT AS turn_number, sum(token_count) OVER (PARTITION BY session_id ORDER BY sequence)::BIGINT AS raw_tokens, count(*) OVER (PARTITION BY session_id) - sequence AS distance FROM e")
def _(s, d):
    return replay.raw_growth(log_events(s, d))


@query("w3_f41_reduction", f"{CONV}, w AS (SELECT session_id, sequence, sum(token_count) OVER (PARTITION BY session_id ORDER BY sequence) AS raw, token_count FROM c) SELECT session_id, sequence, (raw - token_count)::BIGINT AS saved, round(CASE WHEN raw > 0 THEN (raw - token_count) * 100.0 / raw ELSE 0 END, 6) AS reduction_pct FROM w")
def _(s, d):
    w = conversation_events(s, d).withColumn("raw", F.sum("token_count").over(Window.partitionBy("session_id").orderBy("sequence")))
    saved = F.col("raw") - F.col("token_count")
    return w.select("session_id", "sequence", saved.alias("saved"), F.round(evaluation.percent(saved, F.col("raw")), 6).alias("reduction_pct"))


@query("w5_peaks", f"{LOG} SELECT session_id, sequence, max(token_count) OVER (PARTITION BY session_id ORDER BY sequence) AS peak FROM e")
def _(s, d):
    return log_events(s, d).select("session_id", "sequence", F.max("token_count").over(Window.partitionBy("session_id").orderBy("sequence")).alias("peak"))


@query("w6_user_anchor", f"{LOG} SELECT session_id, sequence, last_value(CASE WHEN event_type = 'user_prompt' THEN event_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY sequence) AS anchor FROM e")
def _(s, d):
    anchor = F.last(F.when(F.col("event_type") == "user_prompt", F.col("event_id")), ignorenulls=True)
    return log_events(s, d).select("session_id", "sequence", anchor.over(Window.partitionBy("session_id").orderBy("sequence")).alias("anchor"))


# --- selection under a budget ---------------------------------------------------------


def window_sql(source: str, order: str, limit: int) -> str:
    return f"""WITH RECURSIVE {source}, o AS (SELECT session_id, sequence, token_count, row_number() OVER (PARTITION BY session_id ORDER BY sequence {order}) AS k FROM {'c' if source is CONV_SQL else 'e'}),
g AS (SELECT session_id, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS included, []::BIGINT[] AS kept FROM (SELECT DISTINCT session_id FROM o)
  UNION ALL SELECT o.session_id, o.k, CASE WHEN used + token_count <= {limit} THEN used + token_count ELSE used END, CASE WHEN used + token_count <= {limit} THEN included + 1 ELSE included END, CASE WHEN used + token_count <= {limit} THEN list_append(kept, o.sequence) ELSE kept END FROM g JOIN o ON o.session_id = g.session_id AND o.k = g.k + 1),
l AS (SELECT session_id, max_by(included, k) AS included, max_by(used, k) AS used, max_by(kept, k) AS kept FROM g GROUP BY 1), t AS (SELECT session_id, sum(token_count)::BIGINT AS original FROM o GROUP BY 1)
SELECT session_id, included, used, original, round(CASE WHEN original > 0 THEN (original - used) * 100.0 / original ELSE 0 END, 6) AS reduction_pct, array_to_string(list_sort(kept), ',') AS kept FROM l JOIN t USING (session_id)"""


@query("k6_sliding_window", window_sql(CONV_SQL, "DESC", 300))
def _(s, d):
    return budget.history_window(conversation_events(s, d), 300, True)


@query("k5_naive_window", window_sql(CONV_SQL, "ASC", 300))
def _(s, d):
    return budget.history_window(conversation_events(s, d), 300, False)


@query("k4_greedy_log", window_sql(LOG_SQL, "DESC", 200))
def _(s, d):
    return budget.history_window(log_events(s, d), 200, True)


@query("k7_c4_strict_window", f"{CONV}, r AS (SELECT session_id, sequence, sum(token_count + 8) OVER (PARTITION BY session_id ORDER BY sequence DESC)::BIGINT AS running FROM c) SELECT * FROM r WHERE running <= 260")
def _(s, d):
    return budget.strict_window(conversation_events(s, d), 300, 40)


@query("c1_c2_f25_sections", f"""{window_sql(CONV_SQL, 'DESC', 300).split('SELECT session_id, included')[0]}, f AS (SELECT session_id, unnest(kept) AS sequence FROM l)
SELECT session_id, '## Conversation Context' || chr(10) || string_agg('- [' || role || '] ' || payload || chr(10), '' ORDER BY sequence) AS section FROM f JOIN c USING (session_id, sequence) GROUP BY 1""")
def _(s, d):
    e = conversation_events(s, d)
    kept = budget.history_window(e, 300, True).select("session_id", F.explode(F.split("kept", ",")).alias("sequence")).where("sequence <> ''")
    return prompts.history_section(e.withColumnRenamed("payload", "content"), kept.withColumn("sequence", F.col("sequence").cast("long")))


RANK = "CASE node_type WHEN 'goal' THEN 0 WHEN 'constraint' THEN 1 WHEN 'decision' THEN 2 WHEN 'compressed_branch' THEN 3 WHEN 'summary' THEN 3 WHEN 'tool_result' THEN 4 WHEN 'issue' THEN 5 ELSE 6 END"


@query("k1_k8_compile_order", f"{SCORED} SELECT node_id, {RANK} AS bucket, row_number() OVER (PARTITION BY session_id ORDER BY {RANK}, round(retention_score, 9) DESC, turn_number, node_id) AS place FROM x")
def _(s, d):
    x = scoring.score_nodes(log_nodes(s, d)).withColumn("bucket", scoring.bucket_rank(F.col("node_type")))
    order = Window.partitionBy("session_id").orderBy("bucket", F.round("retention_score", 9).desc(), "turn_number", "node_id")
    return x.select("node_id", "bucket", F.row_number().over(order).cast("long").alias("place"))


def compile_sql(limit: int) -> str:
    return f"""WITH RECURSIVE {NODE_SQL}, {scored_sql()}, y AS (SELECT session_id, node_id, {RANK} AS bucket, round(retention_score, 9) AS score, turn_number, CASE WHEN token_count = 0 THEN strlen(summary) // 4 ELSE token_count END AS cost, token_count, CASE WHEN summary <> '' THEN summary ELSE title END AS body FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY bucket, score DESC, turn_number, node_id) AS k FROM y),
g AS (SELECT session_id, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS before, -1 AS bucket, false AS fits, '' AS node_id FROM (SELECT DISTINCT session_id FROM o)
  UNION ALL SELECT o.session_id, o.k, CASE WHEN (CASE WHEN o.bucket <> g.bucket THEN g.used ELSE g.before END) < {limit} AND g.used + cost <= {limit} THEN g.used + cost ELSE g.used END, CASE WHEN o.bucket <> g.bucket THEN g.used ELSE g.before END, o.bucket,
    (CASE WHEN o.bucket <> g.bucket THEN g.used ELSE g.before END) < {limit} AND g.used + cost <= {limit}, o.node_id FROM g JOIN o ON o.session_id = g.session_id AND o.k = g.k + 1),
kept AS (SELECT o.* FROM o JOIN g USING (session_id, k) WHERE g.fits),
sec AS (SELECT session_id, bucket, '## ' || ['Active Goals', 'Constraints', 'Key Decisions', 'Prior Context', 'Tool Outputs', 'Open Issues', 'Additional Context'][bucket + 1] || chr(10) || string_agg('- ' || body || chr(10), '' ORDER BY k) AS part FROM kept GROUP BY session_id, bucket),
pr AS (SELECT session_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY bucket) AS prompt FROM sec GROUP BY 1),
ex AS (SELECT g.session_id, string_agg(g.node_id, ',' ORDER BY g.node_id) AS excluded FROM g JOIN (SELECT DISTINCT session_id, bucket FROM kept) b USING (session_id, bucket) WHERE NOT g.fits AND g.before < {limit} GROUP BY 1),
c AS (SELECT session_id, count(*) AS included, sum(cost)::BIGINT AS used FROM kept GROUP BY 1), t AS (SELECT session_id, sum(token_count)::BIGINT AS original_tokens FROM o GROUP BY 1)
SELECT session_id, coalesce(prompt, '') AS prompt, coalesce(included, 0) AS included, coalesce(used, 0) AS used, coalesce(excluded, '') AS excluded, original_tokens, (strlen(coalesce(prompt, '')) // 4)::BIGINT AS compiled_tokens FROM t LEFT JOIN pr USING (session_id) LEFT JOIN c USING (session_id) LEFT JOIN ex USING (session_id)"""


@query("g14_compile", compile_sql(250))
def _(s, d):
    x = scoring.score_nodes(log_nodes(s, d)).withColumn("score", F.round("retention_score", 9))
    return prompts.compile_prompts(x, 250, "score")


@query("g15_compile_with_hits", compile_sql(250).replace("round(retention_score, 9) AS score", "round(CASE WHEN turn_number % 3 = 0 THEN retention_score + 0.2 * (turn_number % 10) / 10.0 ELSE retention_score END, 9) AS score"))
def _(s, d):
    x = scoring.score_nodes(log_nodes(s, d))
    hits = x.where("turn_number % 3 = 0").select("session_id", "node_id", ((F.col("turn_number") % 10) / 10.0).alias("hit"))
    return prompts.compile_with_hits(x, hits, 250)


@query("k3_stable_render", compile_sql(250).replace("'- ' || body || chr(10), '' ORDER BY k", "'- ' || body || chr(10), '' ORDER BY turn_number, node_id"))
def _(s, d):
    x = scoring.score_nodes(log_nodes(s, d)).withColumn("score", F.round("retention_score", 9))
    return prompts.compile_prompts(x, 250, "score", stable=True)


@query("j10_grid", f"{CONV} SELECT session_id, sequence, strategy FROM c, (VALUES ('naive'), ('sliding'), ('managed')) t(strategy) WHERE event_type = 'user_prompt'")
def _(s, d):
    names = s.createDataFrame([("naive",), ("sliding",), ("managed",)], "strategy string")
    return evaluate.grid(conversation_events(s, d).where("event_type = 'user_prompt'").select("session_id", "sequence"), names)


@query("u3_replaced_children", f"{NODE}, p AS (SELECT session_id, parent_id, list(node_id ORDER BY node_id) AS ids FROM n WHERE parent_id <> '' GROUP BY ALL) SELECT session_id, parent_id, array_to_string(list_append(ids[2:], 'compressed_' || parent_id), ',') AS children FROM p")
def _(s, d):
    p = log_nodes(s, d).where("parent_id <> ''").groupBy("session_id", "parent_id").agg(F.sort_array(F.collect_list("node_id")).alias("ids"))
    new = store.replace_children(F.col("ids"), F.slice("ids", 1, 1), F.concat(F.lit("compressed_"), "parent_id"))
    return p.select("session_id", "parent_id", F.array_join(new, ",").alias("children"))


@query("v5_v7_live_index", "SELECT label::VARCHAR AS session_id, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 10 <> 0 GROUP BY 1")
def _(s, d):
    v = vector_nodes(s, d)
    gone = v.where(F.col("node_id").endswith("0")).select("session_id", "node_id")
    live = index.valid(store.node_embeddings(v, False), 64).join(gone, ["session_id", "node_id"], "left_anti")
    return live.groupBy("session_id").agg(F.count("*").alias("n"))


@query("st_session_stream")
def _(s, d):
    from quillon.streaming.sessions import conversation_stream

    return conversation_stream(s, d, Policy(budget=300))


# --- vectors ---------------------------------------------------------------------------


@query("v1_v2_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(s, d):
    v = table(s, d, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


TOPK = f"{VECTORS}, q AS (SELECT session_id, arg_min(embedding, node_id) AS query FROM v GROUP BY 1), h AS (SELECT session_id, node_id, status, round(greatest(0, least(1, list_cosine_similarity(query::DOUBLE[], embedding::DOUBLE[]))), 9) AS hit FROM q JOIN v USING (session_id))"


def _hits(s, d, status, k=12):
    v = vector_nodes(s, d)
    q = v.groupBy("session_id").agg(F.min_by("embedding", "node_id").alias("embedding"))
    return index.top_k(q, index.valid(v.where(F.col("status") == status)).select("session_id", "node_id", "embedding"), k)


@query("v3_j8_k9_top_k", f"WITH {TOPK} SELECT session_id, node_id, round(hit, 6) AS hit FROM h WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY hit DESC, node_id) <= 12")
def _(s, d):
    return _hits(s, d, "active").select("session_id", "node_id", F.round("hit", 6).alias("hit"))


@query("u1_j3_merged_hits", f"WITH {TOPK}, z AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY session_id, status ORDER BY hit DESC, node_id) <= 5) SELECT session_id, node_id, round(max(hit), 6) AS hit FROM z GROUP BY ALL")
def _(s, d):
    m = index.merge_hits(_hits(s, d, "active", 5), _hits(s, d, "archived", 5), _hits(s, d, "active", 3))
    return m.select("session_id", "node_id", F.round("hit", 6).alias("hit"))


@query("u4_g16_nodes_for_compile", f"WITH {TOPK}, z AS (SELECT * FROM h WHERE status = 'archived' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY hit DESC, node_id) <= 5) SELECT session_id, count(*) AS n FROM (SELECT session_id, node_id FROM v WHERE status = 'active' UNION ALL SELECT session_id, node_id FROM z) GROUP BY 1")
def _(s, d):
    nodes = index.nodes_for_compile(vector_nodes(s, d), _hits(s, d, "archived", 5))
    return nodes.groupBy("session_id").agg(F.count("*").alias("n"))


@query("f22_j4_effective", f"WITH {TOPK}, z AS (SELECT * FROM h WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY hit DESC, node_id) <= 5) SELECT v.node_id, round(CASE WHEN z.hit IS NOT NULL THEN 0.4 + 0.2 * (z.hit - 0.1) ELSE 0.4 END, 6) AS effective FROM v LEFT JOIN z USING (session_id, node_id)")
def _(s, d):
    v = vector_nodes(s, d).select("session_id", "node_id").join(_hits(s, d, "active", 5).select("session_id", "node_id", "hit"), ["session_id", "node_id"], "left")
    return v.select("node_id", F.round(scoring.effective_score(F.lit(0.4), F.lit(0.1), F.col("hit"), 0.2), 6).alias("effective"))


VECTOR_SQL = f"""{CONV}, w AS (SELECT session_id, sequence, list_filter(regexp_split_to_array(payload, '[ \\n\\t.,:;!?]'), lambda z: z <> '') AS words FROM c),
h AS (SELECT session_id, sequence, list_transform(words, lambda z: list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(strlen(z)), lambda i: ('0x' || substr(hex(z), 2 * i + 1, 2))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) % 16) AS slots FROM w),
n AS (SELECT session_id, sequence, list_transform(range(16), lambda k: len(list_filter(slots, lambda z: z = k))::DOUBLE) AS counts FROM h)
SELECT session_id, sequence, list_transform(range(16), lambda k: CASE WHEN list_sum(counts) = 0 THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END ELSE round(counts[k + 1] / sqrt(list_sum(list_transform(counts, lambda z: z * z))), 6) END::DOUBLE) AS embedding FROM n"""


@query("v8_mock_embedding", VECTOR_SQL)
def _(s, d):
    e = conversation_events(s, d)
    return e.select("session_id", "sequence", F.transform(vectors.mock_embedding(F.col("payload"), 16), lambda x: F.round(x, 6)).alias("embedding"))


@query("v9_embedding_provider", f"SELECT * FROM ({VECTOR_SQL}) WHERE (session_id, sequence) IN ({CONV} SELECT session_id, sequence FROM c WHERE payload <> '')")
def _(s, d):
    e = conversation_events(s, d).select("session_id", "sequence", providers.embedding(F.col("payload"), lambda: providers.MockProvider(16)).alias("v"))
    return e.where("v is not null").select("session_id", "sequence", F.transform("v", lambda x: F.round(x, 6)).alias("embedding"))


# --- answers ---------------------------------------------------------------------------


ABSTAINS = "len(list_filter([" + ", ".join("'" + p.replace("'", "''") + "'" for p in evaluation.ABSTAIN_PHRASES) + "], lambda p: contains(lower(translate(response, '‘’‚‛“”„', chr(39) || chr(39) || chr(39) || chr(39) || '\"\"\"')), p))) > 0"
PROBE_KINDS = "['regex', 'exact', 'contains_all', 'contains_any', 'numeric', 'judge', 'other']"


@query("f30_f34_probe_scores", f"""WITH r AS (SELECT conv_id, turn, ({PROBE_KINDS})[1 + conv_id % 7] AS kind, CASE WHEN conv_id % 9 = 0 THEN 'I don’t recall, ' WHEN conv_id % 9 = 1 THEN '' ELSE (conv_id % 50) || ' ' END || CASE WHEN turn = 6 THEN '' ELSE text END AS response, ['The', 'der', 'zzz'] AS expected, turn = 5 AS failed FROM conversations),
  n AS (SELECT *, try_cast(regexp_extract(response, '[-+]?\\d*\\.?\\d+') AS DOUBLE) AS got FROM r),
  w AS (SELECT *, CASE kind WHEN 'regex' THEN CASE WHEN regexp_matches(response, '(?i)the\\s+|zzz') THEN 5.0 ELSE 0.0 END
      WHEN 'exact' THEN CASE WHEN contains(lower(response), 'the') OR contains(lower(response), 'der') OR contains(lower(response), 'zzz') THEN 5.0 ELSE 0.0 END
      WHEN 'contains_any' THEN CASE WHEN contains(lower(response), 'the') OR contains(lower(response), 'der') OR contains(lower(response), 'zzz') THEN 5.0 ELSE 0.0 END
      WHEN 'contains_all' THEN (contains(lower(response), 'the')::INT + contains(lower(response), 'der')::INT + contains(lower(response), 'zzz')::INT) * 5.0 / 3
      WHEN 'numeric' THEN CASE WHEN abs(got - 20) <= 10 THEN 5.0 ELSE 0.0 END ELSE 0.0 END AS raw FROM n)
  SELECT conv_id, turn, round(CASE WHEN failed THEN 0.0 WHEN kind = 'judge' THEN -1.0 WHEN {TRIM('response')} = '' THEN 0.0 WHEN raw > 0 AND {ABSTAINS} THEN 0.0 ELSE raw END, 6)::DOUBLE AS score FROM w""")
def _(s, d):
    kinds = F.array(*(F.lit(x) for x in ("regex", "exact", "contains_all", "contains_any", "numeric", "judge", "other")))
    start = F.when(F.col("conv_id") % 9 == 0, "I don’t recall, ").when(F.col("conv_id") % 9 == 1, "").otherwise(F.concat((F.col("conv_id") % 50).cast("string"), F.lit(" ")))
    words = F.when(F.col("kind") == "regex", F.array(F.lit(r"the\s+"), F.lit("zzz"))).otherwise(F.array(F.lit("The"), F.lit("der"), F.lit("zzz")))
    p = table(s, d, "conversations").select("conv_id", "turn", F.get(kinds, F.col("conv_id") % 7).alias("kind"), F.concat(start, F.when(F.col("turn") == 6, "").otherwise(F.col("text"))).alias("response"), F.when(F.col("turn") == 5, "failed").alias("error"))
    return p.select("conv_id", "turn", F.round(evaluation.score(F.col("kind"), F.col("response"), words, F.lit(20.0), F.lit(0.5), F.col("error")), 6).alias("score"))


@query("f35_judge_reply", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN greatest(0, least(5, value)) WHEN event_id % 4 = 1 THEN greatest(0, least(5, event_id % 9 - 2)) END::DOUBLE AS score FROM events")
def _(s, d):
    kind = F.col("event_id") % 4
    reply = F.when(kind == 0, F.concat(F.lit('so {"why": {"a": 1}, "score": '), F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit("}"))).when(kind == 1, F.concat(F.lit('{"score": '), F.col("event_id") % 9 - 2, F.lit("} ok"))).when(kind == 2, F.col("props")).otherwise("none")
    return table(s, d, "events").select("event_id", evaluation.judge_reply(reply).alias("score"))


@query("f38_takeaway", """WITH h AS (SELECT conv_id, contains(lower(text), 'the') OR contains(lower(text), 'der') AS hit, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
  k AS (SELECT conv_id, bool_or(hit AND turn <= 2) AS a, bool_or(hit AND turn > last - 2) AS b FROM h GROUP BY 1)
  SELECT conv_id, CASE WHEN a AND b THEN 'both recalled' WHEN b THEN 'managed recalled, full history dropped it' WHEN a THEN 'full history recalled, managed missed' ELSE 'neither recalled' END AS line FROM k""")
def _(s, d):
    c = table(s, d, "conversations").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    hit = evaluation.match_any(F.col("text"), F.array(F.lit("the"), F.lit("der"))) > 0
    sides = c.groupBy("conv_id").agg(F.bool_or(hit & (F.col("turn") <= 2)).alias("a"), F.bool_or(hit & (F.col("turn") > F.col("last") - 2)).alias("b"))
    return sides.select("conv_id", evaluation.takeaway(F.col("a"), F.col("b")).alias("line"))


# --- replay ----------------------------------------------------------------------------

LOG_POLICY = Policy()


@query("g17_replay_log")
def _(s, d):
    return replay.replay(log_events(s, d), LOG_POLICY)


@query("g17_replay_conversations")
def _(s, d):
    return replay.replay(conversation_events(s, d), Policy(budget=300))


@query("c3_managed")
def _(s, d):
    return replay.session_summary(replay.replay(conversation_events(s, d), Policy(budget=300)))


@query("a13_a14_suite")
def _(s, d):
    return replay.suite_summary(replay.session_summary(replay.replay(log_events(s, d), LOG_POLICY)))


@query("a18_t1_coherency")
def _(s, d):
    return replay.coherency(log_events(s, d), LOG_POLICY)


@query("g17_semantic_replay")
def _(s, d):
    return replay.semantic_replay(replay.embedded(conversation_events(s, d)), Policy(budget=300))


@query("g17_turn_hits")
def _(s, d):
    hits = replay.turn_hits(replay.embedded(log_events(s, d)), LOG_POLICY)
    return hits.withColumn("hit", F.round("hit", 9))


@query("c3_managed_question")
def _(s, d):
    events = conversation_events(s, d)
    last = F.max("sequence").over(Window.partitionBy("session_id"))
    asked = events.where("role <> 'system'").withColumn("last", last).where("sequence = last").select("session_id", "sequence", F.col("payload").alias("question"))
    system = events.where("role = 'system'").groupBy("session_id").agg(F.min_by("payload", "sequence").alias("system_text"))
    history = events.where("role <> 'system'").join(asked.select("session_id", "sequence"), ["session_id", "sequence"], "left_anti")
    return replay.managed(history, asked.join(system, "session_id", "left"), Policy(budget=300))


LIVES = """l AS (SELECT label::VARCHAR AS session_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS node_turn, vec_id, embedding FROM embeddings),
  n AS (SELECT *, CASE WHEN node_turn % 3 = 0 THEN node_turn + 5 + vec_id % 20 END AS swept FROM l)"""


@query("g17_v3_asof_hits", f"""WITH {LIVES}, p AS (
    SELECT q.session_id, q.node_turn AS turn_number, n.node_turn, coalesce(n.swept <= q.node_turn, false) AS archived,
      greatest(0, least(1, round(coalesce(array_cosine_similarity(q.embedding::DOUBLE[64], n.embedding::DOUBLE[64]), 0), 12))) AS hit
    FROM n q JOIN n ON q.session_id = n.session_id AND n.node_turn <= q.node_turn)
  SELECT session_id, turn_number, node_turn, archived, round(hit, 9) AS hit, (row_number() OVER (PARTITION BY session_id, turn_number, archived ORDER BY hit DESC, node_turn))::INTEGER AS rank
  FROM p QUALIFY row_number() OVER (PARTITION BY session_id, turn_number, archived ORDER BY hit DESC, node_turn) <= 12""")
def _(s, d):
    v = table(s, d, "embeddings")
    turn = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")
    nodes = v.select(F.col("label").cast("string").alias("session_id"), turn.alias("node_turn"), turn.alias("made"), "vec_id", F.col("embedding").alias("vector"))
    nodes = nodes.withColumn("swept", F.when(F.col("node_turn") % 3 == 0, F.col("node_turn") + 5 + F.col("vec_id") % 20))
    hits = asof.asof_top_k(nodes.select("session_id", F.col("node_turn").alias("turn_number"), "vector"), nodes)
    return hits.withColumn("hit", F.round("hit", 9))


def nearest_sql(rows: str) -> str:
    """The 12 nearest of `rows` for each vector whose id is divisible by 50."""
    return f"""WITH {VECTORS}, h AS ({rows}), p AS (SELECT q.node_id AS query_id, h.node_id,
      greatest(0, least(1, round(array_cosine_similarity(q.embedding::DOUBLE[64], h.embedding::DOUBLE[64]), 12))) AS hit
    FROM v q JOIN h ON q.session_id = h.session_id WHERE q.node_id::BIGINT % 50 = 0)
  SELECT query_id, node_id, round(hit, 9) AS hit, (row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, node_id))::INTEGER AS rank
  FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, node_id) <= 12"""


def nearest(found: DataFrame) -> DataFrame:
    return found.select("query_id", "node_id", F.round("hit", 9).alias("hit"), "rank")


def index_queries(v: DataFrame) -> DataFrame:
    return v.where("cast(node_id as long) % 50 = 0").select(F.col("node_id").alias("query_id"), "session_id", F.col("embedding").alias("vector"))


@query("v3_index_search", nearest_sql("SELECT * FROM v"))
def _(s, d):
    v = vector_nodes(s, d)
    return nearest(ann.VectorIndex(s, Scratch(s).root + "/index").build(v).search(index_queries(v), exact=True))


@query("v4_v5_v6_index_changes", nearest_sql("SELECT * FROM v WHERE node_id::BIGINT % 5 <> 0 OR node_id::BIGINT % 10 = 0"))
def _(s, d):
    v = vector_nodes(s, d)
    number = F.col("node_id").cast("long")
    built = ann.VectorIndex(s, Scratch(s).root + "/index").build(v.where(number % 3 > 0))
    built.insert(v.where(number % 3 == 0)).delete(v.where(number % 5 == 0)).insert(v.where(number % 10 == 0))
    return nearest(built.search(index_queries(v), exact=True))


@query("s7_s8_s11_s12_stored_nodes", f"{NODE} SELECT session_id, node_id, CASE WHEN turn_number % 4 = 0 THEN 'archived' WHEN turn_number % 3 = 0 THEN 'resolved' ELSE status END AS status, turn_number FROM n")
def _(s, d):
    nodes = log_nodes(s, d).select("session_id", "node_id", "status", "turn_number")
    t = StoredTable(s, Scratch(s).root + "/nodes", "session_id string, node_id string, status string, turn_number long", ["session_id", "node_id"], buckets=8)
    t.upsert(nodes, 0, "log")
    t.upsert(nodes.where("turn_number % 3 = 0").withColumn("status", F.lit("resolved")), 1, "log")
    t.upsert(nodes, 0, "log")  # comes again
    t.update(nodes.where("turn_number % 4 = 0").select("session_id", "node_id"), status=F.lit("archived"))
    return t.read()


@query("s18_stored_metrics", f"{LOG} SELECT session_id, count(*) AS total_events, count(*) FILTER (WHERE event_type = 'user_prompt') AS total_turns, sum(token_count)::BIGINT AS total_tokens FROM e GROUP BY 1")
def _(s, d):
    t = StoredTable(s, Scratch(s).root + "/metrics", "session_id string, total_events long, total_turns long, total_tokens long", ["session_id"], "total_events", buckets=8)
    e = log_events(s, d)
    for k, part in enumerate((e.where("sequence <= 5"), e.where("sequence <= 30"), e)):  # flushed now and then
        t.upsert(part.groupBy("session_id").agg(F.count("*").alias("total_events"), F.count_if(F.col("event_type") == "user_prompt").alias("total_turns"), F.sum("token_count").alias("total_tokens")), k, "log")
    return t.read()


@query("a19_w7_prefix_blocks", """WITH p AS (SELECT conv_id, turn, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 2 = 0 THEN turn ELSE -turn END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt FROM conversations),
  n AS (SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_number, prompt FROM p),
  b AS (SELECT session_id, turn_number, prompt, unnest(range(1, (length(prompt) + 63) // 64 + 1)) AS k FROM n WHERE prompt <> ''),
  s AS (SELECT b.session_id, b.turn_number, k, max(q.turn_number) AS last FROM b LEFT JOIN n q ON q.session_id = b.session_id AND q.turn_number < b.turn_number AND left(q.prompt, k * 64) = left(b.prompt, k * 64) AND q.prompt <> '' GROUP BY ALL),
  c AS (SELECT session_id, count(*) AS blocks, count(*) FILTER (WHERE last = turn_number - 1) AS kept, count(last) AS seen FROM s GROUP BY 1),
  t AS (SELECT session_id, count(*) AS turns, count(*) FILTER (WHERE same) AS stable_turns FROM (SELECT session_id, coalesce(lag(prompt) OVER (PARTITION BY session_id ORDER BY turn_number) = prompt, false) AS same FROM n) GROUP BY 1)
  SELECT session_id, turns, coalesce(blocks, 0) AS blocks, coalesce(kept, 0) AS kept, coalesce(seen, 0) AS seen, stable_turns FROM t LEFT JOIN c USING (session_id)""")
def _(s, d):
    c = table(s, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy(F.when(F.col("conv_id") % 2 == 0, F.col("turn")).otherwise(-F.col("turn"))).rowsBetween(Window.unboundedPreceding, 0)
    turns = c.select(F.col("conv_id").cast("string").alias("session_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("turn_number"), F.array_join(F.collect_list("text").over(order), "\n").alias("prompt"))
    return evaluate.prompt_cache(turns)


@query("a19_w7_prompt_cache")
def _(s, d):
    events = log_events(s, d)
    return evaluate.prompt_cache(replay.prompts(events, LOG_POLICY, None), by=("session_id", "stable")).select("session_id", "turns", "blocks", "kept", "seen", "stable_turns", "stable")


@query("f7_f8_large_lexicon", """WITH w AS (SELECT list(DISTINCT k ORDER BY k) AS names FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS k FROM benchmark))
  SELECT conv_id, turn, array_to_string(list_filter(names, lambda k: contains(lower(text), lower(k))), '|') AS refs FROM conversations, w""")
def _(s, d):
    words = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,})"))).alias("k")).distinct()
    names = sorted(r["k"] for r in words.collect())  # of the benchmark's few items; `references` checks the size
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(lexicon.references(F.col("text"), names, ()), "|").alias("refs"))
