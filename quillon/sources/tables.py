"""Adapters from the star-schema test tables to the engine's event, node and vector tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_events(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    c = table(spark, sf_dir, "conversations") if rows is None else rows
    return c.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).cast("long").alias("sequence"), text.event_type_of_role(F.col("role")).alias("event_type"), "role", F.col("text").alias("payload"), text.token_count(F.col("text")).alias("token_count"))


LOG_TYPES = {"signup": "user_prompt", "view": "tool_result", "click": "tool_call", "purchase": "llm_response", "error": "error"}


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for pair in LOG_TYPES.items() for x in pair))[F.col("event_type")]
    payload = F.concat("event_type", F.lit(": "), "props")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("session_id"), F.row_number().over(order).cast("long").alias("sequence"), F.coalesce(kind, F.lit("system")).alias("event_type"), payload.alias("payload"), text.token_count(payload).alias("token_count"), F.col("ts").alias("created_at"))


def log_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat tree of the log: a node for each event under the session's root, every seventh archived."""
    e = log_events(spark, sf_dir)
    kind = text.classify(F.col("event_type"), F.col("payload"))
    node = lambda n: F.concat(F.lit("node_"), "session_id", F.lit("_"), F.lpad(n.cast("string"), 4, "0"))
    none = F.array().cast("array<string>")
    return e.select(
        "session_id",
        node(F.col("sequence")).alias("node_id"),
        F.when(F.col("sequence") > 1, node(F.expr("sequence div 2"))).otherwise("").alias("parent_id"),
        kind.alias("node_type"),
        F.when(F.col("sequence") % 7 == 0, "archived").otherwise("active").alias("status"),
        text.title(F.col("event_type"), F.col("payload")).alias("title"),
        text.summary(F.col("payload")).alias("summary"),
        none.alias("facts"),
        F.when(F.col("event_type") == "llm_response", F.array("payload")).otherwise(none).alias("decisions"),
        none.alias("open_issues"),
        F.when(F.col("sequence") % 5 == 0, F.array(node(F.col("sequence") - 1), node(F.col("sequence") - 1), node(F.col("sequence")))).otherwise(none).alias("dependencies"),
        "token_count",
        F.col("sequence").alias("turn_number"),
        F.col("created_at").alias("updated_at"),
    )


def rich_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of the log with five children a node, resolved nodes, open issues, large nodes and dependencies of all kinds: on itself, twice, later, nowhere."""
    n = log_nodes(spark, sf_dir)
    q = F.col("turn_number")
    node = lambda k: F.concat(F.lit("node_"), "session_id", F.lit("_"), F.lpad(k.cast("string"), 4, "0"))
    none = F.array().cast("array<string>")
    return n.withColumns({
        "parent_id": F.when(q > 1, node(F.greatest(F.lit(1), F.expr("turn_number div 5")))).otherwise(""),
        "status": F.when(q % 7 == 0, "archived").when(q % 11 == 0, "resolved").otherwise("active"),
        "open_issues": F.when(q % 6 == 0, F.array(F.concat(F.lit("issue "), q.cast("string")))).otherwise(none),
        "dependencies": F.when(q % 5 == 0, F.array(node(q - 1), node(q - 1), node(q))).when(q % 8 == 0, F.array(node(q + 3), F.concat(F.lit("gone_"), q.cast("string")))).otherwise(none),
        "token_count": F.col("token_count") * (1 + q % 13 * 4),
    })


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as nodes: session = label, even ids active, odd ones archived."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("label").cast("string").alias("session_id"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("node_id"), F.when(F.col("vec_id") % 2 == 0, "active").otherwise("archived").alias("status"), "embedding")


CONV_SQL = """c AS (SELECT conv_id::VARCHAR AS session_id, (turn + 1)::BIGINT AS sequence,
  CASE WHEN role = 'assistant' THEN 'llm_response' ELSE 'user_prompt' END AS event_type, role, text AS payload,
  (strlen(text) // 4)::BIGINT AS token_count FROM conversations)"""
LOG_SQL = """e AS (SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS session_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS sequence,
  CASE event_type WHEN 'signup' THEN 'user_prompt' WHEN 'view' THEN 'tool_result' WHEN 'click' THEN 'tool_call'
    WHEN 'purchase' THEN 'llm_response' WHEN 'error' THEN 'error' ELSE 'system' END AS event_type,
  event_type || ': ' || props AS payload, (strlen(event_type || ': ' || props) // 4)::BIGINT AS token_count, ts AS created_at FROM events)"""
NODE_SQL = LOG_SQL + """, n AS (SELECT session_id, 'node_' || session_id || '_' || lpad(sequence::VARCHAR, 4, '0') AS node_id,
  CASE WHEN sequence > 1 THEN 'node_' || session_id || '_' || lpad((sequence // 2)::VARCHAR, 4, '0') ELSE '' END AS parent_id,
  CASE event_type WHEN 'user_prompt' THEN CASE WHEN regexp_matches(lower(payload), 'must|always|never|require|constraint') THEN 'constraint' ELSE 'goal' END
    WHEN 'tool_call' THEN 'attempt' WHEN 'tool_result' THEN 'tool_result' WHEN 'llm_response' THEN 'decision' WHEN 'error' THEN 'issue' ELSE 'background' END AS node_type,
  CASE WHEN sequence % 7 = 0 THEN 'archived' ELSE 'active' END AS status,
  '[' || event_type || '] ' || CASE WHEN strlen(payload) > 80 THEN left(payload, 80) || '...' ELSE payload END AS title,
  CASE WHEN strlen(payload) > 500 THEN left(payload, 500) || '...' ELSE payload END AS summary,
  CASE WHEN event_type = 'llm_response' THEN [payload] ELSE []::VARCHAR[] END AS decisions,
  CASE WHEN sequence % 5 = 0 THEN ['node_' || session_id || '_' || lpad((sequence - 1)::VARCHAR, 4, '0'), 'node_' || session_id || '_' || lpad(sequence::VARCHAR, 4, '0')] ELSE []::VARCHAR[] END AS dependencies,
  token_count, sequence AS turn_number, created_at FROM e)"""
RICH_SQL = NODE_SQL + """, i AS (SELECT * REPLACE (
    CASE WHEN turn_number > 1 THEN 'node_' || session_id || '_' || lpad(greatest(1, turn_number // 5)::VARCHAR, 4, '0') ELSE '' END AS parent_id,
    CASE WHEN turn_number % 7 = 0 THEN 'archived' WHEN turn_number % 11 = 0 THEN 'resolved' ELSE 'active' END AS status,
    CASE WHEN turn_number % 5 = 0 THEN ['node_' || session_id || '_' || lpad((turn_number - 1)::VARCHAR, 4, '0'), 'node_' || session_id || '_' || lpad(turn_number::VARCHAR, 4, '0')]
      WHEN turn_number % 8 = 0 THEN ['node_' || session_id || '_' || lpad((turn_number + 3)::VARCHAR, 4, '0'), 'gone_' || turn_number] ELSE []::VARCHAR[] END AS dependencies,
    token_count * (1 + turn_number % 13 * 4) AS token_count),
  CASE WHEN turn_number % 6 = 0 THEN ['issue ' || turn_number] ELSE []::VARCHAR[] END AS open_issues, []::VARCHAR[] AS facts FROM n)"""
