"""JSON lines in byte ranges: every line once, last line wins, bad lines left out, growing files as a stream."""

import json
import random

from quillon.schemas import TURN
from quillon.sources import jsonl
from quillon.sources.jsonl import JsonLines, last_lines, read_lines


def test_every_line_once_whatever_the_ranges(spark, tmp_path):
    r = random.Random(3)
    rows = [{"role": r.choice(["user", "assistant"]), "content": "é" * r.randint(0, 40) + f" {k}"} for k in range(400)]
    lines = [json.dumps(x, ensure_ascii=r.random() < 0.5) for x in rows]
    (tmp_path / "one.jsonl").write_text("\n".join(lines[:250]) + "\n\nnot json\n[1]\n")
    (tmp_path / "two.jsonl").write_text("\n".join(lines[250:]))  # no line end at the end
    (tmp_path / "_hidden.jsonl").write_text(lines[0])
    (tmp_path / "empty.jsonl").write_text("")
    want = sorted((x["role"], x["content"]) for x in rows)
    for path, size in ((f"file://{tmp_path}", 700), (str(tmp_path), 1000), (str(tmp_path), 1 << 20)):
        assert sorted(map(tuple, read_lines(spark, path, TURN, bytes=size).collect())) == want
    for size in (1, 2, 7, 64):  # the ranges alone
        for name in ("one.jsonl", "two.jsonl", "empty.jsonl"):
            data = (tmp_path / name).read_bytes()
            got = [x for a in range(0, len(data), size) for x in jsonl._lines(str(tmp_path), str(tmp_path / name), a, min(len(data), a + size))]
            assert [x for _, x in got] == data.split(b"\n")[: len(got)] and b"\n".join(x for _, x in got) == data.rstrip(b"\n") or not data
    assert read_lines(spark, str(tmp_path), TURN, bytes=1000).rdd.getNumPartitions() > 10


def test_last_line_wins(spark, tmp_path):
    lines = [{"scenario_id": f"s{k % 5}", "probe_id": "p", "response": f"r{k}", "latency_ms": k} for k in range(40)]
    (tmp_path / "cache.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines) + '{"scenario_id": "s1", "pro')
    got = last_lines(spark, str(tmp_path / "cache.jsonl"), "scenario_id string, probe_id string, response string, latency_ms long", ["scenario_id", "probe_id"], bytes=100)
    assert sorted((x["scenario_id"], x["response"]) for x in got.collect()) == sorted((f"s{k % 5}", f"r{k}") for k in range(35, 40))


def test_values_of_other_types_are_null(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": "x", "d": 1, "b": 1, "a": [1, "y"], "s": {"k": "v"}, "m": {"q": "w"}, "t": {"u": 2}}\n{}\n{"n": 5, "d": 2.5, "b": true}\n')
    got = read_lines(spark, str(tmp_path / "a.jsonl"), "n long, d double, b boolean, a array<long>, s struct<k:string>, m map<string,string>, t string")
    assert [tuple(x) for x in got.collect()] == [(None, 1.0, None, [1, None], ("v",), {"q": "w"}, '{"u": 2}'), (None,) * 7, (5, 2.5, True, None, None, None, None)]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    spark.dataSource.register(JsonLines)
    source, want = tmp_path / "in", []
    source.mkdir()
    for part in range(3):
        with (source / "log.jsonl").open("a") as f:
            for k in range(5):
                want.append(f"turn {part} {k}")
                f.write(json.dumps({"role": "user", "content": want[-1]}) + "\n")
        (source / f"other{part}.jsonl").write_text(json.dumps({"role": "user", "content": f"file {part}"}) + "\n")
        want.append(f"file {part}")
        stream = spark.readStream.format("quillon_jsonl").schema(TURN).option("path", str(source)).option("bytes", 60).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)
