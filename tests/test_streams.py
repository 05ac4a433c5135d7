"""Streams of sessions: equal to batch over many files, restart, idle timeout, restored start."""

import random
import time

import pytest

from quillon.plans import replay
from quillon.sources.tables import log_events
from quillon.streaming import sessions
from quillon.streaming.sessions import SNAPSHOT, run_to_end, session_stream, snapshot_stream

SCHEMA = "session_id string, sequence long, event_type string, payload string, token_count long"


@pytest.fixture(scope="module")
def keyed(spark):
    """A session whose state store keeps state in parts."""
    s = sessions.keyed_session(spark)
    s.conf.set("spark.sql.shuffle.partitions", "2")
    return s


def key(r):
    return r["session_id"], r["turn_number"]


def write(spark, rows, source):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    time.sleep(1.1)  # files are taken in order of their time


def test_stream_over_files_equals_batch(keyed, small, tmp_path):
    """One file a batch: parents, twins, queues and aged nodes come from the state."""
    events = log_events(keyed, small).where("cast(session_id as int) % 3 = 0").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    source = str(tmp_path / "in")
    for low, high in ((0, 3), (3, 20), (20, 10**6)):
        events.where(f"sequence > {low} and sequence <= {high}").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = keyed.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    run_to_end(session_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    want = sorted(replay.replay(events).collect(), key=key)
    assert sorted(keyed.read.parquet(str(tmp_path / "out")).collect(), key=key) == want
    assert len(list((tmp_path / "check" / "commits").glob("[0-9]*"))) >= 3


def long_session(n):
    kinds = ["llm_response", "tool_result", "user_prompt", "error"]
    return [("s", k, kinds[k % 4], f"text {k % 7} of number {k % 90}. more", 9 + k % 50) for k in range(1, n + 1)]


def test_restart_of_a_session_longer_than_old(keyed, tmp_path):
    """The query ends and starts again from its checkpoint, within a session whose first nodes have aged."""
    rows = long_session(900)
    source = str(tmp_path / "in")
    for part in (rows[:450], rows[450:880], rows[880:]):
        write(keyed, part, source)
        run_to_end(session_stream(keyed.readStream.schema(SCHEMA).parquet(source)), str(tmp_path / "out"), str(tmp_path / "check"))
    want = sorted(replay.replay(keyed.createDataFrame(rows, SCHEMA)).collect(), key=key)
    assert sorted(keyed.read.parquet(str(tmp_path / "out")).collect(), key=key) == want


def test_idle_session_is_written_and_starts_again(keyed, tmp_path):
    """A session times out, its rows are written; another query starts from them and goes on as if nothing had been."""
    rows = long_session(60)
    source, out = str(tmp_path / "in"), str(tmp_path / "snapshots")
    write(keyed, rows[:40], source)
    stream = snapshot_stream(keyed.readStream.schema(SCHEMA).parquet(source), idle_ms=1500)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end:
            if keyed.read.schema(SNAPSHOT).parquet(out).count() if (tmp_path / "snapshots").exists() else 0:
                break
            time.sleep(1)
    finally:
        query.stop()
    snapshot = keyed.read.schema(SNAPSHOT).parquet(out)
    first = snapshot.first()
    assert first["turn"] == 40 and snapshot.where("node_turn = 0").count() == 1
    later = str(tmp_path / "later")
    write(keyed, rows[40:], later)
    run_to_end(session_stream(keyed.readStream.schema(SCHEMA).parquet(later), initial=snapshot), str(tmp_path / "out"), str(tmp_path / "check2"))
    want = [r for r in sorted(replay.replay(keyed.createDataFrame(rows, SCHEMA)).collect(), key=key) if r["turn_number"] > 40]
    assert sorted(keyed.read.parquet(str(tmp_path / "out")).collect(), key=key) == want


def test_idle_session_is_dropped(keyed, tmp_path):
    """After the timeout a session of the same id begins anew."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(keyed, long_session(5), source)
    stream = session_stream(keyed.readStream.schema(SCHEMA).parquet(source), idle_ms=1000)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        time.sleep(12)
        write(keyed, [("s", 6, "user_prompt", "again", 3)], source)
        end = time.time() + 60
        while time.time() < end and keyed.read.schema(replay.TURN_STATS).parquet(out).count() < 6:
            time.sleep(1)
    finally:
        query.stop()
    assert sorted(r["turn_number"] for r in keyed.read.parquet(out).collect()) == [1, 1, 2, 3, 4, 5]


def test_query_keeps_the_callers_state_store(spark, small):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = sessions.conversation_stream(spark, small)
    from quillon.sources.tables import conversation_events

    assert sorted(got.collect(), key=key) == sorted(replay.replay(conversation_events(spark, small)).collect(), key=key)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_stream_with_hits_equals_semantic_replay(keyed, tmp_path):
    """Vectors, anchors and archived nodes come from the state, also after a restart."""
    from quillon.schemas import Policy

    r, words = random.Random(4), ["kafka", "queue", "postgres", "index", "retry", "budget"]
    rows = [(s, k, r.choice(["user_prompt", "llm_response", "tool_result", "error"]), " ".join(r.choice(words) for _ in range(r.randint(1, 8))), 9) for s in ("a", "b") for k in range(1, 71)]
    source = str(tmp_path / "in")
    policy = Policy(budget=60)
    for low, high in ((0, 30), (30, 31), (31, 70)):
        write(keyed, [x for x in rows if low < x[1] <= high], source)
        stream = replay.embedded(keyed.readStream.schema(SCHEMA).parquet(source))
        run_to_end(session_stream(stream, policy, hits=4), str(tmp_path / "out"), str(tmp_path / "check"))
    want = replay.semantic_replay(replay.embedded(keyed.createDataFrame(rows, SCHEMA)), policy, 4).collect()
    got = sorted(keyed.read.parquet(str(tmp_path / "out")).collect(), key=key)
    assert got == sorted(want, key=key) and any(x["archived_nodes"] for x in got)
    assert [x["compiled_tokens"] for x in got] != [x["compiled_tokens"] for x in sorted(replay.replay(keyed.createDataFrame(rows, SCHEMA), policy).collect(), key=key)]
