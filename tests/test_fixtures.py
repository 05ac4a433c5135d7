"""Small inline tables for what the given tables don't reach."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import evaluation, text
from quillon.plans import catalog, evaluate, gc
from quillon.functions import scoring
from quillon.schemas import Policy
from tests.fixtures import NODES_SQL, PROBES, TEXTS_SQL, injected, probes, texts
from tests.oracle import connect, duck_rows, spark_rows


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.TEXT_QUERIES))
def test_texts(spark, con, name):
    f, sql = catalog.TEXT_QUERIES[name]
    assert spark_rows(f(texts(spark))) == duck_rows(con, TEXTS_SQL + sql)


def on_nodes(name):
    """The registered SQL over the inline nodes."""
    return catalog.oracle_sql()[name].replace(catalog.RICH, NODES_SQL)


def test_scores_of_inline_nodes(spark, con):
    x = scoring.score_nodes(injected(spark), Policy(max_node_tokens=100))
    rounded = [F.round(c, 9).alias(c) for c in ("size_penalty", "dependency_weight", "retention_score")]
    assert spark_rows(x.select("node_id", "unresolved_boost", "resolved_penalty", *rounded)) == duck_rows(con, on_nodes("f15_f19_injected_scores"))


def test_compaction_of_inline_nodes(spark, con):
    policy = Policy(max_children=4)
    got = gc.compact(gc.mark(injected(spark), policy), policy).select("session_id", "parent_id", F.array_join("child_ids", ",").alias("children"), "summary", "original_tokens", "compressed_tokens")
    assert spark_rows(got) == duck_rows(con, on_nodes("g10_g11_compact"))
    assert spark_rows(gc.collect_garbage(injected(spark), policy)[2].select("session_id", "swept", "branches")) == duck_rows(con, on_nodes("g13_collect_injected"))


def test_orphans_of_inline_nodes(spark):
    assert sorted(map(tuple, gc.orphans(injected(spark)).collect())) == [("s1", "p1", "gone"), ("s1", "p1", "p2")]  # p2 is made after p1


def test_probe_scores(spark):
    p = probes(spark)
    got = p.select("id", evaluation.score(F.col("match_type"), F.col("response"), F.col("expected"), F.col("value"), F.col("tolerance"), F.col("error")).alias("score")).orderBy("id").collect()
    assert [round(r["score"], 9) for r in got] == [round(x[-1], 9) for x in PROBES]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_typed_answers(spark):
    assert one(spark, ["a", "b"], text.facts_prefix, "array<string>") == "Verified facts (verbatim): a, b\n\n" and one(spark, [], text.facts_prefix, "array<string>") == ""
    assert one(spark, "body\nENTITIES: A, b, a,", lambda x: F.struct(*text.entities_line(x))) == ("body", ["A", "b"])
    assert one(spark, "no line", lambda x: F.struct(*text.entities_line(x))) == ("no line", [])
    assert [one(spark, x, evaluation.cached_tokens) for x in ('{"usage":{"prompt_tokens_details":{"cached_tokens":64}}}', '{"usage":{}}', "not json")] == [64, 0, 0]
    assert [one(spark, x, evaluation.judge_reply) for x in ('so {"score": 4.5}', '{"score": 9} ok', "none")] == [4.5, 5.0, None]
    assert [one(spark, x, text.encoding_for_model) for x in ("gpt-5-mini", "o1", "gpt-4o", "gpt-4", "")] == ["o200k_base"] * 3 + ["cl100k_base", "o200k_base"]
    assert [one(spark, x, text.is_reasoning_model) for x in ("gpt-5-mini", "o1", "gpt-4o", "gpt-4", "")] == [True, True, False, False, False]


def test_strategies_are_taken_as_written(spark):
    asked = lambda *names: spark.createDataFrame([("s", k, n) for k, n in enumerate(names)], "scenario string, place int, name string")
    got = evaluate.chosen_strategies(asked("", " window ", "full", "sliding", "managed", "naive"), ["scenario"]).orderBy("place").collect()
    assert [(r["strategy"], r["is_reference"]) for r in got] == [("sliding_window", True), ("naive_full_history", False), ("managed", False)]
    with pytest.raises(Exception, match="unknown strategy"):
        evaluate.chosen_strategies(asked("Naive"), ["scenario"]).collect()
