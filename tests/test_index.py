"""The stored index: exact search against brute force, recall, inserts, deletes, rebuilds and odd input."""

import random

import numpy as np
import pytest

from quillon.operators.ann import VectorIndex

VECTORS = "session_id string, node_id string, embedding array<float>"
QUERIES = "query_id string, session_id string, vector array<float>"


def vectors(r, n, d=16, sessions=("a", "b")):
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(12)]
    return [(r.choice(sessions), f"n{k:05d}", np.array([x + r.gauss(0, 0.4) for x in r.choice(centres)], np.float32).tolist()) for k in range(n)]


def brute(rows, queries, k):
    out = {}
    for q, session, v in queries:
        v = np.array(v, np.float64)
        scored = []
        for s, node, x in rows:
            if s == session:
                x = np.array(x, np.float64)
                scored.append((-min(1.0, max(0.0, round(float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), 12))), node))
        out[q] = sorted(scored)[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((-r["hit"], r["node_id"]))
    return out


def same(got, want):
    assert {q: [n for _, n in x] for q, x in got.items()} == {q: [n for _, n in x] for q, x in want.items() if x}
    for q, x in got.items():
        assert np.allclose([h for h, _ in x], [h for h, _ in want[q]], atol=1e-9)


@pytest.fixture(scope="module")
def data():
    r = random.Random(4)
    rows = vectors(r, 3000)
    return rows, [(f"q{k}", s, v) for k, (s, _, v) in enumerate(r.sample(rows, 40))]


def test_exact_search_and_recall(spark, tmp_path, data):
    rows, queries = data
    index = VectorIndex(spark, f"file://{tmp_path}/i").build(spark.createDataFrame(rows, VECTORS).repartition(4))
    asked = spark.createDataFrame(queries, QUERIES)
    want = brute(rows, queries, 12)
    same(found(index.search(asked, exact=True)), want)
    got = found(index.search(asked))
    recall = np.mean([len({n for _, n in got[q]} & {n for _, n in want[q]}) / 12 for q in want])
    assert len(index) == 3000 and recall >= 0.9
    fewer = found(index.search(asked, probes=1))
    assert np.mean([len({n for _, n in fewer[q]} & {n for _, n in want[q]}) / 12 for q in want]) <= recall


def test_inserts_deletes_and_rebuild(spark, tmp_path, data):
    rows, queries = data
    rows = rows[:600]
    held = {(s, n): v for s, n, v in rows}
    index = VectorIndex(spark, f"file://{tmp_path}/i").build(spark.createDataFrame(rows, VECTORS))
    asked = spark.createDataFrame(queries, QUERIES)
    builds = lambda: {p.name for p in (tmp_path / "i").iterdir() if p.name.startswith("build-")}
    gone = list(held)[:60]
    index.delete(spark.createDataFrame([*gone, ("a", "not there")], "session_id string, node_id string"))
    for key in gone:
        del held[key]
    assert len(index) == 540 and len(builds()) == 1
    same(found(index.search(asked, exact=True)), brute([(*k, v) for k, v in held.items()], queries, 12))
    new = [(s, n, [-x for x in v]) for s, n, v in rows[30:90]]  # some deleted, some replaced
    index.insert(spark.createDataFrame(new, VECTORS))
    held |= {(s, n): v for s, n, v in new}
    assert len(index) == 570
    same(found(index.search(asked, exact=True)), brute([(*k, v) for k, v in held.items()], queries, 12))
    more = list(held)[200:420]
    index.delete(spark.createDataFrame(more, "session_id string, node_id string"))
    for key in more:
        del held[key]
    assert len(builds()) == 2  # dead rows times 5 exceed the live ones
    same(found(index.search(asked, exact=True)), brute([(*k, v) for k, v in held.items()], queries, 12))
    again = VectorIndex(spark, f"file://{tmp_path}/i")  # another reader of the folder
    assert len(again) == len(held) == again.live().count()


def test_what_is_not_accepted(spark, tmp_path):
    rows = [("a", "x", [1.0, 0.0]), ("a", "", [1.0, 0.0]), ("a", None, [1.0, 0.0]), ("a", "none", None), ("a", "empty", []), ("a", "zero", [0.0, 0.0]), ("a", "nan", [float("nan"), 1.0]), ("a", "null", [None, 1.0]), ("a", "long", [1.0, 0.0, 0.0]), (None, "y", [0.6, 0.8])]
    index = VectorIndex(spark, f"file://{tmp_path}/i").build(spark.createDataFrame(rows, VECTORS), 2)
    assert len(index) == 2
    index.insert(spark.createDataFrame([("a", "wrong", [1.0, 2.0, 3.0]), ("a", "z", [0.0, -1.0])], VECTORS))
    got = found(index.search(spark.createDataFrame([("q", "a", [1.0, 0.0]), ("r", None, [0.6, 0.8]), ("s", "other", [1.0, 1.0])], QUERIES), exact=True))
    assert {q: [n for _, n in x] for q, x in got.items()} == {"q": ["x", "z"], "r": ["y"]}
    with pytest.raises(Exception, match="components"):
        index.search(spark.createDataFrame([("q", "a", [1.0])], QUERIES)).collect()


def test_empty_index(spark, tmp_path):
    asked = spark.createDataFrame([("q", "a", [1.0, 0.0])], QUERIES)
    nothing = VectorIndex(spark, f"file://{tmp_path}/i")
    assert nothing.search(asked).count() == 0 and len(nothing) == 0
    index = nothing.build(spark.createDataFrame([], VECTORS), 2)
    assert index.search(asked).count() == 0
    index.insert(spark.createDataFrame([("a", "x", [1.0, 0.1])], VECTORS))
    assert [r["node_id"] for r in index.search(asked, exact=True).collect()] == ["x"]


def test_ties_and_copies(spark, tmp_path):
    rows = [("a", f"n{k:03d}", [1.0, 2.0, float(k % 2)]) for k in range(300)]
    index = VectorIndex(spark, f"file://{tmp_path}/i").build(spark.createDataFrame(rows, VECTORS).repartition(5))
    got = index.search(spark.createDataFrame([("q", "a", [1.0, 2.0, 0.0])], QUERIES), k=5, exact=True).orderBy("rank").collect()
    assert [r["node_id"] for r in got] == ["n000", "n002", "n004", "n006", "n008"]
