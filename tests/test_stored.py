"""Stored upserts: latest row of a key, replayed batches, whole versions, point reads, updates."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators.stored import StoredTable
from quillon.streaming.sessions import running_metrics

SCHEMA = "session_id string, node_id string, status string, turn long"


def table(spark, tmp_path, **more):
    return StoredTable(spark, f"file://{tmp_path}/t", SCHEMA, ["session_id", "node_id"], "turn", buckets=8, **more)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upserts_equal_a_dictionary(spark, tmp_path):
    r, held, t = random.Random(1), {}, table(spark, tmp_path)
    assert t.read().count() == 0 and t.get("a", "n1").count() == 0
    for batch in range(4):
        new = [(r.choice(["a", "b", None]), f"n{r.randrange(40)}", r.choice(["active", "archived"]), batch * 1000 + k) for k in range(30)]
        assert t.upsert(spark.createDataFrame(new, SCHEMA).repartition(3))
        held |= {x[:2]: x for x in new}
        assert rows_of(t.read()) == sorted(held.values(), key=repr)
    key = next(iter(held))
    assert rows_of(t.get(*key)) == [held[key]] and t.get("a", "nowhere").count() == 0
    plan = t.get("b", "n1")._jdf.queryExecution().toString()
    assert plan.count("_bucket=") <= 8


def test_replayed_batch_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    first, second = ([("a", "x", s, k)] for k, s in enumerate(("active", "resolved")))
    assert t.upsert(spark.createDataFrame(first, SCHEMA), 0, "s") and t.upsert(spark.createDataFrame(second, SCHEMA), 1, "s")
    version = t._newest()
    assert not t.upsert(spark.createDataFrame(first, SCHEMA), 0, "s") and not t.upsert(spark.createDataFrame(second, SCHEMA), 1, "s")
    assert t._newest() == version and rows_of(t.read()) == [("a", "x", "resolved", 1)]
    assert t.upsert(spark.createDataFrame(first, SCHEMA), 0, "other")


def test_reader_keeps_its_version(spark, tmp_path):
    """A frame read before an upsert gives the old rows after it; an upsert that fails before it is published changes nothing."""
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([("a", f"n{k}", "active", 1) for k in range(20)], SCHEMA))
    old = t.read()
    t.upsert(spark.createDataFrame([("a", f"n{k}", "archived", 2) for k in range(20)], SCHEMA))
    assert old.where("status = 'active'").count() == 20 and t.read().where("status = 'archived'").count() == 20
    t._publish = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        t.upsert(spark.createDataFrame([("a", "n1", "gone", 3)], SCHEMA))
    again = table(spark, tmp_path)
    assert again.read().where("status = 'archived'").count() == 20
    again.vacuum()
    assert again.read().count() == 20


def test_update_and_archive(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([("a", f"n{k}", "active", k) for k in range(6)], SCHEMA))
    t.update(spark.createDataFrame([("a", "n2"), ("a", "n3"), ("b", "n4")], "session_id string, node_id string"), status=F.lit("archived"), turn=F.col("turn") + 10)
    assert rows_of(t.read().where("status = 'archived'")) == [("a", "n2", "archived", 12), ("a", "n3", "archived", 13)]
    assert t.read().count() == 6


def test_stream_of_metrics_is_stored_once(spark, tmp_path):
    """Running metrics as upserts of a stream over several files, stopped and started again."""
    events = "session_id string, event_type string, token_count long"
    t = StoredTable(spark, f"file://{tmp_path}/m", "session_id string, total_events long, total_turns long, tokens long", ["session_id"], "total_events", buckets=4)
    want = {}
    for part in range(3):
        rows = [(f"s{k % 5}", "user_prompt" if k % 2 else "error", k) for k in range(part * 7, part * 7 + 7)]
        for s, kind, n in rows:
            old = want.get(s, (0, 0, 0))
            want[s] = (old[0] + 1, old[1] + (kind == "user_prompt"), old[2] + n)
        spark.createDataFrame(rows, events).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events).parquet(str(tmp_path / "in"))
        t.sink(running_metrics(stream), "metrics").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        assert rows_of(t.read()) == sorted((s, *x) for s, x in want.items())
    assert rows_of(t.get("s3")) == [("s3", *want["s3"])]
