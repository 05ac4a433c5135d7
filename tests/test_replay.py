import random
import time

from quillon.plans import fold, replay
from quillon.schemas import Policy
from quillon.sources.tables import log_events
from quillon.streaming.sessions import keyed_session, run_to_end, session_stream, windowed_counts
from tests import session_model

KINDS = ["goal", "constraint", "decision", "attempt", "tool_result", "issue", "background"]


def random_events(r, n, twins="abcdefgh"):
    return [{"kind": r.choice(KINDS), "title": r.choice(twins), "summary": r.choice(["", "a summary " * r.randint(1, 9)]), "payload": "what now" * r.randint(0, 3), "token_count": r.choice([0, 3, 12, 60, 2500]), "bare": r.random() < 0.6} for _ in range(n)]


def test_fold_equals_plain_model():
    """All columns, sessions short and longer than OLD, few and many twins, budgets that bind and that don't."""
    r = random.Random(5)
    for case in range(40):
        policy = Policy(budget=r.choice([200, 1500, 6000]), max_depth=r.choice([4, 10, 10**6]), max_children=r.choice([50, 10**6]), max_active=r.choice([0, 8, 25, 10**6]), threshold=r.choice([0.3, 0.3, 0.12]), decision_floor=r.choice([0.2, 0.5, 0.0]), headroom=r.choice([0.6, 0.0]))
        events = random_events(r, 700 if case % 8 == 0 else r.randint(1, 120), r.choice(["abcdefgh", [str(k) for k in range(300)]]))
        s, m = fold.Session(str(case), policy), session_model.Session(str(case))
        for e in events:
            assert fold.step(s, e) == session_model.step(m, e, policy)
        assert fold.coherency(s, [e["payload"] for e in events]) == session_model.coherency(m, [e["payload"] for e in events], policy)


def test_time_is_linear_in_events():
    """A session of five times as many events, two thirds of whose nodes stay, takes five times as long, with room for noise."""

    def seconds(n):
        r, s = random.Random(1), fold.Session("long", Policy())
        kinds = ["decision", "decision", "tool_result"]
        start = time.process_time()
        for k in range(n):
            kind = kinds[k % 3]
            fold.step(s, {"kind": kind, "title": f"title {r.randrange(n)}", "summary": "s" * r.randint(1, 40), "payload": "q", "token_count": r.randint(5, 40), "bare": kind != "decision"})
        assert s.n_active > n // 2
        return time.process_time() - start

    assert seconds(25_000) < 12 * seconds(5_000)


def test_group_finds_what_fits():
    r = random.Random(8)
    for _ in range(30):
        g, held = fold.Group(), {}
        for _ in range(r.randint(1, 1500)):
            if held and r.random() < 0.3:
                turn = r.choice(list(held))
                g.remove(turn)
                del held[turn]
            else:
                turn = r.randrange(10**6)
                if turn not in held:
                    held[turn] = r.randint(0, 50)
                    g.add(turn, held[turn])
        room, want = 200, []
        for turn in sorted(held):
            if held[turn] <= room:
                want.append((turn, held[turn]))
                room -= held[turn]
        assert list(g.fitting(200)) == want and g.count == len(held)


def test_selected_cost_fits_and_stays_in_budget():
    s = fold.Session("x")
    for k in range(30):
        fold.add(s, KINDS[k % 7], f"t{k}", f"summary {k}", 20 + k, True)
    size, chosen = s.compiled(300, "what now")
    assert sum(s.nodes[t].tokens for t in chosen) <= 300 - fold.tokens("what now")
    assert size > 0


def test_assistant_turns_are_never_swept(spark, small):
    prepared = replay.prepared(log_events(spark, small))
    assert prepared.where("kind = 'decision' and bare").count() == 0


def test_stream_equals_batch(spark, small, tmp_path):
    spark = keyed_session(spark)
    events = log_events(spark, small).where("cast(session_id as int) % 5 = 0")
    source = str(tmp_path / "in")
    columns = ["session_id", "sequence", "event_type", "payload", "token_count"]
    events.where("sequence <= 20").select(*columns).coalesce(1).write.parquet(source)
    events.where("sequence > 20").select(*columns).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.select(*columns).schema).option("maxFilesPerTrigger", 100).parquet(source)
    run_to_end(session_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    key = lambda r: (r["session_id"], r["turn_number"])
    want = sorted(replay.replay(events.select(*columns)).collect(), key=key)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key) == want


def test_state_is_carried_between_batches(spark, tmp_path):
    spark = keyed_session(spark)
    schema = "session_id string, sequence long, event_type string, payload string, token_count long"
    rows = [("a", k, "user_prompt", f"text number {k}", 5) for k in range(1, 9)]
    source = str(tmp_path / "in")
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run_to_end(session_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = [r["raw_tokens"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("turn_number").collect()]
    assert got == [5 * k for k in range(1, 9)]


def test_windowed_counts(spark, small, tmp_path):
    events = log_events(spark, small)
    source = str(tmp_path / "in")
    events.select("created_at", "event_type").write.parquet(source)
    stream = spark.readStream.schema("created_at timestamp, event_type string").parquet(source)
    query = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == events.count()


def test_depth_of_a_chain_of_over_a_thousand(spark):
    from quillon.plans.gc import tree_depth

    rows = [("a", str(k), str(k - 1) if k else "") for k in range(1500)] + [("b", "x", None), ("b", "y", "x"), ("b", "u", "v"), ("b", "v", "u"), ("b", "o", "gone")]
    got = tree_depth(spark.createDataFrame(rows, "session_id string, node_id string, parent_id string")).collect()
    assert sorted(map(tuple, got)) == [("a", 1499), ("b", 1)]


def test_prompt_is_what_was_counted():
    """The rendered prompt has the size that compiled counts, and stable rendering only reorders lines within sections."""
    r = random.Random(9)
    for _ in range(10):
        s = fold.Session("p", Policy(budget=r.choice([100, 900])))
        for e in random_events(r, 60):
            fold.ingest(s, e)
            size, chosen = s.compiled(s.policy.budget, e["payload"])
            free, stable = s.prompt(chosen), s.prompt(chosen, True)
            assert size == fold.tokens(e["payload"]) + fold.tokens(free)
            assert sorted(free.split("\n")) == sorted(stable.split("\n"))


def test_prompt_cache_equals_plain_reading(spark):
    from quillon.plans.evaluate import prompt_cache

    r = random.Random(1)
    rows, want = [], {}
    for s in ("a", "b", "c"):
        texts = ["".join(r.choice("xy") * r.randint(1, 9) for _ in range(4))]
        for _ in range(30):
            texts.append(r.choice([texts[-1], texts[-1] + "more text", texts[0] + "z", "", texts[-1][: r.randint(0, 30)]]))
        blocks = [[t[:k + 5] for k in range(0, len(t), 5)] for t in texts]
        kept = sum(sum(x in blocks[k - 1] for x in b) for k, b in enumerate(blocks) if k)
        seen = sum(sum(any(x in e for e in blocks[:k]) for x in b) for k, b in enumerate(blocks))
        want[s] = (len(texts), sum(map(len, blocks)), kept, seen, sum(a == b for a, b in zip(texts, texts[1:])))
        rows += [(s, k + 1, t) for k, t in enumerate(texts)]
    got = prompt_cache(spark.createDataFrame(rows, "session_id string, turn_number long, prompt string").repartition(3), 5)
    assert {x["session_id"]: tuple(x)[1:] for x in got.collect()} == want


def test_sessions_share_score_tables():
    """A table of scores by distance depends on nothing of a session, and most sessions are short."""
    from quillon.plans import fold

    def run(name):
        s = fold.Session(name)
        for k in range(30):
            fold.step(s, {"kind": "decision" if k % 3 else "goal", "title": f"t{k % 4}", "summary": "x", "token_count": 3, "bare": True, "payload": "x"})

    run("a")
    before = fold.table_of.cache_info().misses
    run("b")
    assert fold.table_of.cache_info().misses == before


def test_both_prompts_come_from_one_pass(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["a19_w7_prompt_cache"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") + plan.count("FlatMapGroupsInPandas") == 1
