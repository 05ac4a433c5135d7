"""The semantic arm: as-of hits, scores against the anchor and prompts with hits, against plain models."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.functions.providers import MockProvider
from quillon.operators import asof
from quillon.plans import fold, replay
from quillon.schemas import BUCKET_RANK, OTHER_PRIORITY, SECTION_LABELS, TYPE_PRIORITY, Policy


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not a:
        return 0.0
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / norms if norms else 0.0


def best(pairs, k):
    return sorted(pairs, key=lambda x: (-x[1], x[0]))[:k]


def brute_hits(queries, nodes, k):
    out = []
    for session, turn, vector in queries:
        if vector is None or any(x is None or math.isnan(x) for x in vector):
            continue
        for archived in (False, True):
            found = []
            for s, node, made, swept, held in nodes:
                if s == session and held is not None and len(held) == len(vector) > 0 and not any(x is None or math.isnan(x) for x in held) and made <= turn and (swept is not None and swept <= turn) == archived:
                    found.append((node, min(1.0, max(0.0, round(cosine(vector, held), 12)))))
            out += [(session, turn, node, archived, round(hit, 9), rank) for rank, (node, hit) in enumerate(best(found, k), 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1024, 4096), (7, 11)])
def test_asof_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(asof, "TURNS", blocks[0])
    monkeypatch.setattr(asof, "NODES", blocks[1])
    r = random.Random(3)
    vector = lambda: r.choice([None, [], [0.0] * 4, [math.nan] * 4, [1.0, None, 0.0, 0.0], [1.0, 2.0, 3.0]]) if r.random() < 0.15 else [float(r.randint(-2, 2)) for _ in range(4)]
    nodes = [(s, t, t, t + r.randint(1, 30) if r.random() < 0.5 else None, vector()) for s, n in (("a", 90), ("b", 3), ("long", 200)) for t in range(1, n + 1)]
    queries = [(s, t, vector()) for s, n in (("a", 95), ("b", 3), ("long", 200), ("none", 2)) for t in range(1, n + 1)]
    got = asof.asof_top_k(spark.createDataFrame(queries, "session_id string, turn_number long, vector array<double>"), spark.createDataFrame(nodes, "session_id string, node_turn long, made long, swept long, vector array<double>").repartition(3), 3)
    assert sorted((r["session_id"], r["turn_number"], r["node_turn"], r["archived"], round(r["hit"], 9), r["rank"]) for r in got.collect()) == brute_hits(queries, nodes, 3)


def test_nearest_are_selected_without_sorting_all_pairs():
    """Ties at the k-th place go to the first columns; what is below 0 is no hit."""
    r = np.random.default_rng(4)
    for n in (3, 40):
        hits = r.integers(-2, 5, (50, n)) / 4
        i, j = asof._best(hits, 7)
        want = [(a, b) for a in range(50) for b in sorted(sorted((b for b in range(n) if hits[a, b] >= 0), key=lambda b: (-hits[a, b], b))[:7])]
        assert list(zip(i.tolist(), j.tolist())) == want


def test_a_worker_holds_one_pair_of_blocks(spark, monkeypatch):
    """A session of many blocks goes to Python pair by pair, and short sessions share a group."""
    monkeypatch.setattr(asof, "TURNS", 8)
    monkeypatch.setattr(asof, "NODES", 16)
    rows = [(s, t, [float(t % 5), 1.0]) for s, n in (("long", 100), *((f"s{k}", 3) for k in range(40))) for t in range(n)]
    nodes = spark.createDataFrame(rows, "session_id string, node_turn long, vector array<double>").selectExpr("*", "node_turn as made", "cast(null as long) as swept")
    monkeypatch.setattr(asof, "_compare", lambda k: lambda a, b: pa.table({"session_id": ["x"], "turn_number": [len(a)], "node_turn": [len(b)], "archived": [False], "hit": [0.0]}, asof._SCHEMA))
    sizes = asof.asof_top_k(nodes.selectExpr("session_id", "node_turn as turn_number", "vector"), nodes, 1000).collect()
    assert len(sizes) < 13 * 7 + 40
    assert max(r["turn_number"] for r in sizes) <= 8 + 3 * 12 and max(r["node_turn"] for r in sizes) <= 16 + 3 * 12


def test_empty_sides(spark):
    queries = spark.createDataFrame([], "session_id string, turn_number long, vector array<double>")
    nodes = spark.createDataFrame([("a", 1, 1, None, [1.0])], "session_id string, node_turn long, made long, swept long, vector array<double>")
    assert asof.asof_top_k(queries, nodes).count() == 0
    assert asof.asof_top_k(nodes.selectExpr("session_id", "node_turn as turn_number", "vector"), nodes.limit(0)).count() == 0


def plain_replay(events, policy, k):
    """Turn statistics and hits of one session, everything looked at again at each event."""
    nodes = {0: dict(kind="goal", title="session root", text="Session Root", tokens=0, cost=0, bare=True, up=None, vec=None, on=True, score=0.0, near=0.0)}
    anchor, raw, out, all_hits = None, 0, [], []
    for turn, e in enumerate(events, 1):
        raw += e["token_count"]
        live = [t for t in nodes if nodes[t]["on"]]
        up = 0 if e["kind"] in ("goal", "constraint") or not live else max(live)
        nodes[turn] = dict(kind=e["kind"], title=e["title"].lower(), text=e["summary"] or e["title"], tokens=e["token_count"], cost=e["token_count"] or len(e["summary"].encode()) // 4, bare=e["bare"], up=up, vec=e["vector"], on=True, score=0.0, near=0.0)
        if e["is_user"]:
            anchor = e["vector"]
        live = [t for t in nodes if nodes[t]["on"]]
        titles = [nodes[t]["title"] for t in live]
        for t in live:
            n, far = nodes[t], turn - t
            twins = titles.count(n["title"])
            v = 0.25 * math.exp(-0.1 * far) + 0.2 * TYPE_PRIORITY.get(n["kind"], OTHER_PRIORITY)
            v -= 0.1 * (min(0.3 * (twins - 1), 1) if twins > 1 else 0)
            v -= 0.15 * (min((far - 15) / 15, 1) if far > 15 else 0)
            n["near"] = cosine(anchor, n["vec"])
            n["score"] = max(0.0, min(1.0, v + 0.2 * n["near"]))

        def depth(t):
            return 0 if nodes[t]["up"] is None else 1 + depth(nodes[t]["up"])

        used = sum(nodes[t]["tokens"] for t in live)
        widest = max(sum(n["up"] == t for n in nodes.values()) for t in nodes)
        fire = used > policy.budget or used > int(policy.budget * policy.headroom) or len(live) > policy.max_active or max(map(depth, nodes)) > policy.max_depth or widest > policy.max_children or sum(nodes[t]["score"] for t in live) / len(live) < policy.threshold
        swept = [t for t in live if fire and nodes[t]["bare"] and nodes[t]["score"] < policy.threshold]
        for t in swept:
            nodes[t]["on"] = False
        hits = {}
        if e["is_user"] and e["payload"]:
            for on in (True, False):
                found = best([(t, min(1.0, max(0.0, round(cosine(e["vector"], n["vec"]), 12)))) for t, n in nodes.items() if n["on"] == on and n["vec"] is not None], k)
                hits |= dict(found)
                all_hits += [(turn, t, not on, round(hit, 9), rank) for rank, (t, hit) in enumerate(found, 1)]
        room, spent, size, chosen = policy.budget - len(e["payload"].encode()) // 4, 0, 0, 0
        effective = {t: nodes[t]["score"] + (0.2 * (hits[t] - nodes[t]["near"]) if t in hits else 0.0) for t in nodes if nodes[t]["on"] or t in hits}
        for rank in range(7):
            own = sorted((t for t in effective if BUCKET_RANK.get(nodes[t]["kind"], 6) == rank), key=lambda t: (-effective[t], t))
            if spent >= room:
                continue
            text = ""
            for t in own:
                if spent + nodes[t]["cost"] <= room:
                    spent += nodes[t]["cost"]
                    text += f"- {nodes[t]['text']}\n"
            if text:
                size += len(f"## {SECTION_LABELS[rank]}\n{text}".encode()) + (7 if chosen else 0)
                chosen += 1
        compiled = len(e["payload"].encode()) // 4 + size // 4
        out.append((turn, raw, compiled, sum(n["on"] for n in nodes.values()), len(swept), sum(nodes[t]["tokens"] for t in swept)))
    return out, all_hits


def conversation(r, n):
    words = ["kafka", "queue", "postgres", "index", "retry", "budget", "sweep", "plan"]
    rows = []
    for k in range(1, n + 1):
        kind = r.choice(["user_prompt", "llm_response", "tool_result", "error", "tool_call"])
        rows.append((k, kind, " ".join(r.choice(words) for _ in range(r.randint(0 if kind != "llm_response" else 1, 9)))))
    return rows


def test_replay_with_hits_equals_plain_model(spark):
    r = random.Random(12)
    talks = {f"s{k}": conversation(r, n) for k, n in enumerate((1, 40, 90, 160))}
    rows = [(s, k, kind, text, len(text.encode()) // 4) for s, talk in talks.items() for k, kind, text in talk]
    events = spark.createDataFrame(rows, "session_id string, sequence long, event_type string, payload string, token_count long").repartition(4)
    policy = Policy(budget=60)
    turns = sorted(map(tuple, replay.semantic_replay(replay.embedded(events), policy, 4).select("session_id", "turn_number", "raw_tokens", "compiled_tokens", "active_nodes", "gc_nodes_swept", "gc_tokens_freed").collect()))
    hits = sorted((x["session_id"], x["turn_number"], x["node_turn"], x["archived"], round(x["hit"], 9), x["rank"]) for x in replay.turn_hits(replay.embedded(events), policy, 4).collect())
    columns = {(x["session_id"], x["sequence"]): x for x in replay.prepared(events).collect()}
    provider, want, want_hits = MockProvider(), [], []
    for s, talk in talks.items():
        plain = [columns[s, k].asDict() | {"vector": provider.embed([text])[0], "is_user": kind == "user_prompt"} for k, kind, text in talk]
        out, found = plain_replay(plain, policy, 4)
        want += [(s, *x) for x in out]
        want_hits += [(s, *x) for x in found]
    assert any(x[3] for x in hits), "no archived node was hit"
    assert hits == sorted(want_hits)
    assert turns == sorted(want)


def test_managed_keeps_question_and_system_apart(spark):
    events = spark.createDataFrame([("a", k, "user_prompt" if k % 2 else "llm_response", f"word {k} " * 12, 30) for k in range(1, 9)], "session_id string, sequence long, event_type string, payload string, token_count long")
    questions = spark.createDataFrame([("a", "what was word 3?", "be brief " * 10), ("b", "nothing before", None)], "session_id string, question string, system_text string")
    got = {r["session_id"]: r for r in replay.managed(events, questions, Policy(budget=120)).collect()}
    s = fold.Session("a", Policy(budget=120))
    for e in sorted(replay.prepared(events).collect(), key=lambda e: e["sequence"]):
        fold.ingest(s, e.asDict())
    asked = len("what was word 3?") // 4 + len("be brief " * 10) // 4
    size, chosen = s.compiled(120 - asked, "")
    assert (got["a"]["compiled_tokens"], got["a"]["included"]) == (asked + size, len(chosen))
    assert got["a"]["original_tokens"] == asked + sum(n.tokens for n in s.active())
    assert got["a"]["included"] + got["a"]["excluded"] == s.n_active
    assert got["b"]["included"] == 1 and got["b"]["original_tokens"] == len("nothing before") // 4
