"""File sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.schemas import LATENCY_FIXTURE, PROBE_RESULT, TURN


def conversation_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """session_id (the file's name), sequence, role, content of one-file-a-session JSON lines.

    The order is the line's within its file; a file is one session and read by one task."""
    rows = spark.read.schema(TURN).option("mode", "DROPMALFORMED").option("wholetext", False).json(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    order = F.row_number().over(Window.partitionBy("file").orderBy("block", "line"))
    return rows.select(F.regexp_replace("file", r"\.jsonl?$", "").alias("session_id"), order.cast("long").alias("sequence"), "role", "content")


def cache_key(df: DataFrame) -> DataFrame:
    """With the key scenario::probe::strategy[::suffix]."""
    key = F.concat_ws("::", "scenario_id", "probe_id", "pipeline", F.nullif(F.col("cache_key_suffix"), F.lit("")))
    return df.withColumn("key", key)


def response_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached answers: bad lines are skipped and the last line of a key wins."""
    rows = spark.read.schema(PROBE_RESULT).option("mode", "DROPMALFORMED").json(path)
    rows = cache_key(rows).where("scenario_id is not null").withColumn("line", F.monotonically_increasing_id())
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("line")))).where("k = 1").drop("k", "line")


def write_response_cache(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def latency_fixture(spark: SparkSession, path: str) -> DataFrame:
    """A fixture's rows; each must have a probe."""
    rows = spark.read.schema(LATENCY_FIXTURE).option("multiLine", True).json(path)
    return rows.withColumn("probe", F.when(F.coalesce("probe", F.lit("")) == "", F.raise_error(F.lit("the fixture has no probe"))).otherwise(F.col("probe")))


def nested_sessions(rows: DataFrame) -> DataFrame:
    """Turns of nested sessions: question_id, session_no, turn_no, role, content.

    rows: question_id, haystack_sessions array<array<struct<role, content>>>."""
    sessions = rows.select("question_id", F.posexplode("haystack_sessions").alias("session_no", "turns"))
    return sessions.select("question_id", "session_no", F.posexplode("turns").alias("turn_no", "turn")).select("question_id", "session_no", "turn_no", "turn.role", "turn.content")


def dialogue_turns(rows: DataFrame) -> DataFrame:
    """Turns of dialogues whose sessions are dynamic keys session_N.

    rows: sample_id, conversation map<string,string> (JSON text by key)."""
    item = "array<struct<speaker:string,dia_id:string,text:string,blip_caption:string>>"
    sessions = rows.select("sample_id", F.explode("conversation").alias("key", "value")).where(F.col("key").rlike(r"^session_\d+$"))
    turns = sessions.select("sample_id", F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("session_no"), F.posexplode(F.from_json("value", item)).alias("turn_no", "turn"))
    text = F.when(F.coalesce("turn.blip_caption", F.lit("")) != "", F.concat("turn.text", F.lit(" [image: "), "turn.blip_caption", F.lit("]"))).otherwise(F.col("turn.text"))
    return turns.select("sample_id", "session_no", "turn_no", F.col("turn.speaker").alias("speaker"), text.alias("content"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_report(df: DataFrame, limit: int = 10_000) -> str:
    """A Markdown table of a summary; summaries are short, and longer ones are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(["" if x is None else f"{x:.4f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x) for x in r]) for r in rows)])
