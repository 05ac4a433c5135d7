import math

from pyspark.sql import functions as F

from quillon.functions import providers, text, vectors
from quillon.operators import store
from quillon.plans import evaluate, fold
from quillon.schemas import Policy

WORDS = "größe naïve 日本 plain, text"


class Flaky(providers.MockProvider):
    """Fails the first time in each task."""

    failed = False

    def embed(self, texts):
        if not self.failed:
            self.failed = True
            raise providers.TransientError("status 503")
        return super().embed(texts)


def test_provider_equals_expression_and_tries_again(spark):
    df = spark.createDataFrame([(1, WORDS), (2, None), (3, ""), (4, " . ")], "id int, t string")
    got = {r.id: (r.a, r.b) for r in df.select("id", providers.embedding(F.col("t"), lambda: Flaky(8), 1).alias("a"), vectors.mock_embedding(F.col("t"), 8).alias("b")).collect()}
    assert all(math.isclose(x, y) for k in (1, 4) for x, y in zip(*got[k], strict=True))
    assert got[2][0] is None and got[3][0] is None and got[4][0][0] == 1.0


def test_counters(spark):
    df = spark.createDataFrame([("abcdefgh",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(providers.counter()(F.col("t"))).collect()] == [2, 0, 0]
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = [r[0] for r in df.select(providers.counter(path)(F.col("t"))).collect()]
    assert got[0] > 0 and got[1:] == [0, 0]


def test_transient(spark):
    rows = [("api status 503", True), ("status 429 insufficient_quota", False), ("unexpected EOF", True), ("status 400", False), (None, False)]
    df = spark.createDataFrame(rows, "m string, want boolean")
    assert all(r.got == r.want for r in df.select("want", text.is_transient(F.col("m")).alias("got")).collect())


def test_restore_takes_latest_snapshot_and_parentless_root(spark):
    columns = "session_id string, node_id string, parent_id string, node_type string, status string, turn_number long"
    old = spark.createDataFrame([("a", "r", "", "goal", "active", 0)], columns)
    new = spark.createDataFrame([("a", "r", "", "goal", "active", 0), ("a", "g", "r", "goal", "resolved", 4), ("b", "x", "gone", "goal", "active", 2)], columns)
    snapshots = store.snapshot(old, F.lit(1)).unionByName(store.snapshot(new, F.lit(2)))
    nodes = store.restore(snapshots)
    assert sorted(map(tuple, nodes.select(*new.columns).collect())) == sorted(map(tuple, new.collect()))
    assert sorted(map(tuple, store.tree_state(nodes).collect())) == [("a", "r", 4), ("b", None, 2)]
    assert [r.snapshot_at for r in store.snapshot_times(snapshots, 1).orderBy("session_id").collect()] == [2, 2]
    assert store.restore(snapshots.limit(0)).count() == 0


def test_status_changes_time(spark):
    nodes = spark.sql("select '1' session_id, 'a' node_id, 'active' status, timestamp '2020-01-01' updated_at union all select '1', 'b', 'active', timestamp '2020-01-01'")
    got = {r.node_id: (r.status, r.updated_at.year > 2020) for r in store.set_status(nodes, "1", "b", "stale").collect()}
    assert got == {"a": ("active", False), "b": ("stale", True)}


def test_report_is_in_order(spark):
    rows = spark.createDataFrame([("b", "p1", "x"), ("a", "p2", "y"), ("a", "p2", "x"), ("a", "p1", "z")], "scenario_id string, probe_id string, strategy_cand string")
    got = [tuple(r) for r in evaluate.report(rows).collect()]
    assert got == sorted(got) and len(got) == 4


def test_orphan_dependencies_fail_a_check():
    s = fold.Session("x")
    node = fold.add(s, "goal", "t", "hello there", 5, True)
    whole = fold.coherency(s, ["hello there"])
    node.dependencies = ("root_x",)
    assert fold.coherency(s, ["hello there"]) == whole == 1.0
    node.dependencies = ("root_x", "gone")
    assert fold.coherency(s, ["hello there"]) == 0.8


class Short:
    """Answers with the number of nodes and names; fails once in each task."""

    failed = False

    def complete(self, prompts):
        if not self.failed:
            self.failed = True
            raise providers.TransientError("timeout")
        assert len(prompts) <= 16
        return [providers.Completion(f"{p.count('Node ')} nodes in short\nENTITIES: Kafka, kafka, " + ("x" * 400 if "note" in p else "Redis"), 5, 2) for p in prompts]


def test_external_compressor(spark):
    """Facts of the answer's last line come before it; a branch costs the call or its summary, whichever is more."""
    from quillon.plans import gc
    from tests.fixtures import injected

    policy = Policy(max_children=4)
    marked = gc.mark(injected(spark), policy)
    plain = {r["parent_id"]: r for r in gc.compact(marked, policy).collect()}
    got = {r["parent_id"]: r for r in gc.compact(marked, policy, gc.external_compressor(Short)).collect()}
    assert got.keys() == plain.keys() and len(got) == 3
    for parent, r in got.items():
        names = ["Kafka", "x" * 400 if parent == "a1" else "Redis"]
        assert r["child_ids"] == plain[parent]["child_ids"] and r["facts"] == names
        assert r["summary"] == f"Verified facts (verbatim): {', '.join(names)}\n\n{len(r['child_ids'])} nodes in short"
        assert r["compressed_tokens"] == max(7, len(r["summary"]) // 4)
    assert gc.collect_garbage(injected(spark), policy, gc.external_compressor(Short))[2].first()["branches"] == 3
