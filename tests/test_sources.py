import json

from quillon.operators import store
from quillon.sources import files


def test_conversation_lines(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"role": "user", "content": "a"}\n{"role": "assistant", "content": "b"}\n')
    (tmp_path / "two.jsonl").write_text('{"role": "user", "content": "c"}\n')
    rows = files.conversation_jsonl(spark, str(tmp_path)).orderBy("session_id", "sequence").collect()
    assert [tuple(r) for r in rows] == [("one", 1, "user", "a"), ("one", 2, "assistant", "b"), ("two", 1, "user", "c")]


def test_response_cache_keeps_the_last_line(spark, tmp_path):
    line = lambda r: json.dumps({"scenario_id": "s", "probe_id": "p", "pipeline": "naive", "response": r})
    (tmp_path / "m.jsonl").write_text(line("old") + "\nnot json\n" + line("new") + "\n")
    rows = files.response_cache(spark, str(tmp_path)).collect()
    assert [(r["key"], r["response"]) for r in rows] == [("s::p::naive", "new")]


def test_latency_fixture_needs_a_probe(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"system": "s", "warm_pairs": [], "probe": ""}')
    try:
        files.latency_fixture(spark, str(tmp_path)).collect()
    except Exception as e:
        assert "no probe" in str(e)
    else:
        raise AssertionError


def test_nested_sources(spark):
    rows = spark.createDataFrame([("q", [[("user", "a"), ("assistant", "b")], [("user", "c")]])], "question_id string, haystack_sessions array<array<struct<role:string,content:string>>>")
    assert [tuple(r)[1:] for r in files.nested_sessions(rows).orderBy("session_no", "turn_no").collect()] == [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "c")]
    talk = {"session_1": json.dumps([{"speaker": "A", "dia_id": "1", "text": "hi", "blip_caption": "cat"}]), "session_1_date_time": "today", "speaker_a": "A"}
    rows = spark.createDataFrame([("x", talk)], "sample_id string, conversation map<string,string>")
    assert [tuple(r) for r in files.dialogue_turns(rows).collect()] == [("x", 1, 0, "A", "hi [image: cat]")]


def test_append_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, "x")], "k string, v long, s string")
    store.append(rows, path)
    store.append(rows.limit(0), path)
    assert spark.read.parquet(path).count() == 1
    new = spark.createDataFrame([("a", 1, "y"), ("b", 0, "z")], "k string, v long, s string")
    assert sorted(map(tuple, store.upsert(rows, new, ["k"], "v").collect())) == [("a", 1, "y"), ("b", 0, "z")]


def test_markdown_report(spark):
    report = files.markdown_report(spark.createDataFrame([("a", 1.5, None)], "s string, x double, n int"))
    assert report.splitlines()[-1] == "| a | 1.5 |  |"
