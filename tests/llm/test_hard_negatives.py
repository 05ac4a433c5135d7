"""Hard negatives against brute force, and their defined results for odd input."""

import math
import random

import numpy as np
import pytest

from quillon.llm import hard_negatives as H
from tests.oracle import connect, duck_rows, spark_rows

FIELDS = "vec_id long, label int, q string, anchor long"


def brute(rows):
    held = []
    for vec_id, label, v, *_ in rows:
        if vec_id is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if any(not math.isfinite(256 * x) for x in v):
            continue
        held.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a, anchor in enumerate(held):
        if anchor[0] % 100:
            continue
        scores = []
        for b, other in enumerate(held):
            if b != a and len(other[2]) == len(anchor[2]):
                score = sum(x * y for x, y in zip(anchor[2], other[2]))
                if -(2**63) <= score < 2**63:
                    scores.append((-score, other[0], other[1]))
        scores.sort()
        for p, positive, _ in [x for x in scores if x[2] == anchor[1]][:5]:
            inside = [x for x in scores if x[2] != anchor[1] and 80 * -p <= 100 * -x[0] <= 100 * -p]
            out += [(anchor[0], positive, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(inside[:5])]
    return sorted(out)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows, kind):
    return spark.createDataFrame([(i, lab, "clash", 1, v) for i, lab, v in rows], f"{FIELDS}, embedding array<{kind}>").repartition(3)


def vectors(r, n, d, spread):
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    return [(k, r.randrange(4), [x + r.gauss(0, spread) for x in r.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(H, "LEAST", 100)
    r = random.Random(3)
    rows = [(i, lab, np.array(v, np.float32).tolist()) for i, lab, v in vectors(r, 420, 8, 0.3)]
    rows += [(500, None, [1.0] * 8), (600, 1, None), (700, 1, []), (800, 1, [1.0, None] * 4), (900, 1, [math.nan] * 8), (1000, 1, [math.inf] * 8), (None, 1, [1.0] * 8)]
    rows += [(1100, 2, [0.0] * 8), (1200, 1, [1.0, 2.0]), (1201, 1, [1.0, 2.0]), (1202, 2, [1.0, 1.9]), (1300, 9, [-1.0] * 8), (-100, 0, [0.5] * 8)]
    rows += [rows[100], rows[100], rows[101], rows[102]]  # repeated rows, an anchor's among them
    rows += [(2000 + k, 3, [0.25] * 8) for k in range(30)]  # ties
    assert got(H.hard_negatives(table(spark, rows, kind))) == brute(rows)


def test_huge_components(spark):
    r = random.Random(4)
    rows = [(k, k % 3, [(1 + r.gauss(0, 0.1)) * 10**4 for _ in range(4)]) for k in range(1, 320)]
    rows += [(k, k % 3, [r.gauss(0, 1) * 10 ** r.choice([0, 3, 9, 13, 17, 200, 307]) for _ in range(4)]) for k in range(401, 520)]
    rows += [(1000, 0, [1e5, 1e10, 3.0, 2.0]), (1100, 0, [1e11, 1e11, 1e8, 1.0])]
    assert brute(rows) and got(H.hard_negatives(table(spark, rows, "double"))) == brute(rows)


def test_empty_and_lonely(spark):
    assert got(H.hard_negatives(table(spark, [], "float"))) == []
    assert got(H.hard_negatives(table(spark, [(100, 1, [1.0, 2.0])], "float"))) == []


def test_planes_drop_rows_and_keep_scores():
    """Within a block: intervals always hold the score, narrow with each plane, and end at it."""
    r = np.random.default_rng(1)
    rows, anchors = r.integers(-300, 300, (200, 16)), r.integers(-300, 300, (7, 16))
    s, exact, width = H._Sliced(rows, anchors), rows @ anchors.T, None
    while True:
        low, high = s.ends()
        assert (low <= exact).all() and (exact <= high).all()
        assert width is None or ((high - low) < width).all()
        width = high - low
        if not s.plane:
            break
        s.add_plane()
    assert (low == exact).all() and (high == exact).all()


def test_many_blocks_equal_one(monkeypatch):
    """What earlier rows of a stripe have found only drops rows that can't qualify."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    q = r.integers(-50, 50, (900, 6))
    labels = r.integers(0, 3, 900)
    side = np.arange(900), np.arange(900), labels, q
    block = lambda bands: pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(range(20)), pa.array(labels[:20]), pa.array([False] * 20), pa.array([x.tobytes() for x in q[:20]]), pa.array(bands, pa.list_(pa.int64()))], names=["uid", "vec_id", "label", "wide", "q", "bands"])
    for bands in ([None] * 20, [[5000, 4000, -3]] * 10 + [[2500]] * 10):
        whole = [b.to_pylist() for b in H._compare(side, block(bands), 6)]
        monkeypatch.setattr(H, "ROWS", 37)
        assert [b.to_pylist() for b in H._compare(side, block(bands), 6)] == whole and whole[0]
        monkeypatch.undo()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert spark_rows(H.query(spark, d)) == duck_rows(connect(d), H.ORACLE_SQL)
