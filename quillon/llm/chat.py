"""Chat formatting by event-sourced reconstruction.

A log of a conversation has events in the order of `seq`: `open` begins a message of a role,
`delta` adds text to a message, `edit` replaces its text, `regenerate` empties it for the deltas
of another attempt. Events are partitioned by conversation and message and sorted by sequence;
a fold carries one message's text at a time, over batches of Arrow rows. Final messages are then
dealt in the order of their conversations and opening events, in slices, and rendered turn by
turn into rows of bounded size, with the spans whose text is under the loss mask.

    user       [INST] text [/INST]
    assistant   text</s>            (a blank before the text; the text is under the loss mask)
    others     [ROLE] role [TEXT] text [/ROLE]

Control strings in a text or role get a backslash after their first character, and a backslash
becomes two, so that a control string in the output is always a mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.spark_util import Scratch

# fixed values: marks of the template and further control strings of public tokenizers
CONTROLS = ("[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]", "<s>", "</s>", "<unk>", "<pad>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
PIECE, PIECES = 256, 64  # characters of a delta, most deltas of an attempt (longer ones beyond)
CHUNK = 8 << 20  # characters of a row of the output, a longer conversation has several
LOG = "conv_id long, message string, event string, role string, text string"
FORMATTED = "conv_id long, part int, chunk int, whole boolean, n_turns long, text string, loss array<struct<start:long,end:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_CONTROL = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|\[ROLE\] (.*?) \[TEXT\] (.*?) \[/ROLE\]| (.*?)</s>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn's segment and the span of it that is under the loss mask."""
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]", None
    if role == "assistant":
        return f" {body}</s>", (1, 1 + len(body))
    return f"[ROLE] {escape(role)} [TEXT] {body} [/ROLE]", None


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of rendered turns."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at character {at}")
        user, role, other, assistant = m.groups()
        yield ("user", unescape(user)) if user is not None else ("assistant", unescape(assistant)) if assistant is not None else (unescape(role), unescape(other))
        at = m.end()


def conversation_log(conversations: DataFrame) -> DataFrame:
    """The events (conv_id, message, seq, event, role, text) that would have left the turns (conv_id, turn, role, text).

    A turn is streamed in pieces. By a digest of its text, one in four came in one go, one had
    a first draft that was edited, one was broken off half-way and regenerated, and one was
    edited after it had ended."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tie", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)).withColumn("row", F.monotonically_increasing_id())
    n = F.length("text")
    size = F.greatest(F.lit(PIECE), F.ceil(n / PIECES).cast("int"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("event"), text.alias("text"))
    none = F.lit(None).cast("string")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"), size), lambda i: event("delta", F.substring(F.col("text"), i + 1, size)))
    draft = F.array(event("delta", F.reverse(F.substring(F.col("text"), F.lit(1), size))), event("edit", F.substring(F.col("text"), F.lit(1), size)))
    half = F.array(event("delta", F.substring(F.col("text"), F.lit(1), (n / 2).cast("int"))), event("regenerate", none))
    late = F.array(event("delta", F.lit(" (sic)")), event("edit", F.col("text")))
    way = F.crc32(F.col("text").cast("binary")) % 4
    stream = F.when(way == 1, F.concat(draft, F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))))).when(way == 2, F.concat(half, pieces)).when(way == 3, F.concat(pieces, late)).otherwise(pieces)
    log = rows.select("conv_id", "turn", "tie", "row", "role", F.posexplode(F.concat(F.array(event("open", none)), stream)).alias("step", "x"))
    return log.select("conv_id", F.col("row").cast("string").alias("message"), F.struct("turn", "tie", "row", "step").alias("seq"), "x.event", F.when(F.col("step") == 0, F.col("role")).alias("role"), "x.text")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each message: what its events, which come one after the other, leave of it."""
    key, first, role, pieces, kinds = None, None, "", [], None
    for batch in batches:
        kinds, out = batch.schema, []
        for k, (conv, message, event, who, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "message", "event", "role", "text")))):
            if (conv, message) != key:
                if key is not None:
                    out.append((key[0], first, role, "".join(pieces)))
                key, first, role, pieces = (conv, message), batch.column("seq")[k].as_py(), "", []
            if event == "open":
                role = who or ""
            elif event == "delta":
                pieces.append(text or "")
            elif event in ("edit", "regenerate"):
                pieces = [text or ""] if event == "edit" else []
        yield _messages(out, kinds)
    if key is not None:
        yield _messages([(key[0], first, role, "".join(pieces))], kinds)


def _messages(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    types = [pa.int64(), kinds.field("seq").type, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["conv_id", "at", "role", "text"])


def fold_log(log: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the final messages of a log (conv_id, message, seq, event, role, text), `at` being the seq of a message's first event.

    seq may be of any type that sorts; events of equal seq in a message have no order of their
    own. A null text is empty, a message without `open` has an empty role, events of other kinds
    change nothing. A null conv_id is a conversation, a null message a message of it."""
    seq = log.schema["seq"].dataType.simpleString()
    log = log.select("conv_id", "message", "seq", "event", "role", "text").repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq")
    return log.mapInArrow(_fold, f"conv_id long, at {seq}, role string, text string")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of conversations, of which only the partition's first and last may go on in another one."""
    part, held, conv, started, convs = TaskContext.get().partitionId(), [], None, False, 0
    segments, loss, chars, turns, chunk = [], [], 0, 0, 0

    def close(whole: bool):
        return {"conv_id": conv, "part": part, "chunk": chunk, "whole": whole, "n_turns": turns, "text": "".join(segments), "loss": loss}

    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    size = 0
    for batch in batches:
        for c, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if not started or c != conv:
                if started:
                    held.append(close(convs > 1 and chunk == 0))
                conv, started, convs, chunk = c, True, convs + 1, 0
                segments, loss, chars, turns = [], [], 0, 0
            elif chars >= CHUNK:
                held.append(close(False))
                segments, loss, chars, turns, chunk = [], [], 0, 0, chunk + 1
            segment, span = render_turn(role, text)
            if span:
                loss.append({"start": chars + span[0], "end": chars + span[1]})
            segments.append(segment)
            chars, turns, size = chars + len(segment), turns + 1, size + len(segment)
            if size >= CHUNK:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
    if started:
        held.append(close(False))
    yield pa.RecordBatch.from_pylist(held, schema)


def render(messages: DataFrame) -> DataFrame:
    """Formatted conversations in rows (conv_id, part, chunk, whole, n_turns, text, loss); one of several rows is their texts in the order of part and chunk."""
    return messages.repartitionByRange("conv_id", "at").sortWithinPartitions("conv_id", "at").select("conv_id", "role", "text").mapInArrow(_render, FORMATTED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose rows come one after the other; only hashes are carried on."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    conv, state = None, None
    close = lambda: {n: x for n, x in zip(names, (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))}
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        out = []
        for c, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))):
            if state is None or c != conv:
                if state is not None:
                    out.append(close())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, turn in parse_turns(text):
                state[0] += 1
                state[1].update(f"{role}\n{turn}\n".encode())
            for span in loss:
                under = unescape(text[span["start"] : span["end"]])
                state[2] += len(under)
                state[3].update(under.encode())
            state[4] += len(text)
        yield pa.RecordBatch.from_pylist(out, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([close()], schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back of formatted conversations. A conversation of one row is read where it lies; others meet by their id."""
    columns = ["conv_id", "text", "loss"]
    alone = formatted.where("whole").select(columns).mapInArrow(_digest, DIGESTS)
    parted = formatted.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").select(columns).mapInArrow(_digest, DIGESTS)
    return alone.unionByName(parted)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted rows of the turns (conv_id, turn, role, text), by way of their event log.

    Null role or text is empty, a null turn comes first, rows of equal turn are ordered by a
    digest of role and text, repeated rows are turns of their own, rows without a conv_id are a
    conversation. An empty table gives no row; further columns are ignored."""
    return render(fold_log(conversation_log(conversations)))


def query(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(Scratch(spark).keep(format_conversations(turns.unionByName(probe)), "formatted"))


_ESCAPED = lambda x: f"(length({x}) + length({x}) - length(replace({x}, '\\', '')) + " + " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in CONTROLS) + ")"
ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 23 + {_ESCAPED("role")} END + {_ESCAPED("text")} AS chars, role = 'assistant' AS loss FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (loss), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (loss), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
