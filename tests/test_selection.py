"""Order statistics and greedy walks against plain readings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import selection


def test_sort_keys_keep_the_order(spark):
    values = [0.0, -0.0, 1.5, -1.5, 5e-324, -5e-324, 1e308, -1e308, math.inf, -math.inf, math.nan, 0.1, 0.2]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", selection.sort_key("v").alias("k")).withColumn("back", selection.of_sort_key("k")).orderBy("k").collect()
    got = [r["v"] for r in rows]
    assert math.isnan(got[-1]) and got[:-1] == sorted(v for v in values if not math.isnan(v))
    assert all(r["back"] == r["v"] or math.isnan(r["v"]) for r in rows)


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_percentiles_equal_numpy(spark, monkeypatch, few):
    """With few = 0 all rounds take place, one group holding most rows."""
    monkeypatch.setattr(selection, "FEW", few)
    r = random.Random(6)
    groups = {"hot": [r.gauss(0, 1) for _ in range(3000)], "same": [7.0] * 50, "one": [3.25], "two": [1.0, 2.0], "wide": [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(200)], None: [5.0, None, 6.0], "none": [None, None]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {x["g"]: x for x in selection.exact_percentiles(rows, F.col("v"), ["g"], shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        held = [v for v in vs if v is not None]
        assert got[g]["n"] == len(vs)
        for name, p in shares.items():
            if held:
                assert got[g][name] == pytest.approx(np.quantile(held, p), rel=1e-12)
            else:
                assert got[g][name] is None


def test_percentiles_of_nothing(spark):
    assert selection.exact_percentiles(spark.createDataFrame([], "g string, v double"), F.col("v"), ["g"], {"p": 0.5}).count() == 0


def walk(rows, bucketed):
    out, used, at, open_ = {}, 0, None, False
    for n, (bucket, _, cost, room) in sorted(rows.items(), key=lambda x: (x[1][0], x[1][1], x[0])):
        if bucket != at:
            at, open_ = bucket, used < room or not bucketed
        fits = open_ and used + cost <= room
        used += cost if fits else 0
        out[n] = (fits, open_)
    return out


@pytest.mark.parametrize("bucketed", [True, False])
def test_walk_equals_plain_reading(spark, bucketed):
    """Sessions longer than a batch of rows, budgets used up at a bucket's start, rows without cost."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        r = random.Random(2)
        sessions = {s: {k: (r.randrange(4) if bucketed else 0, r.randrange(50), r.choice([0, 0, 1, 5, 30]), room) for k in range(n)} for s, n, room in (("a", 1000, 400), ("b", 7, 10), ("c", 300, 0), ("d", 300, -5), (None, 20, 33))}
        rows = [(s, n, *x) for s, held in sessions.items() for n, x in held.items()]
        df = spark.createDataFrame(rows, "s string, n long, bucket int, by int, cost long, room long").repartition(6)
        got = selection.greedy_walk(df, "s", [F.col("bucket"), F.col("by"), F.col("n")], "cost", "room", "bucket" if bucketed else None)
        want = {(s, n): x for s, held in sessions.items() for n, x in walk(held, bucketed).items()}
        assert {(x["s"], x["n"]): (x["kept"], x["met"]) for x in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
