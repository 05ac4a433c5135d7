"""The prefix trie against brute force, and its defined results for odd input."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quillon.llm import trie
from tests.oracle import connect, duck_rows, spark_rows

SCHEMA = "conv_id long, turn long, role string, text string, depth long, words string, part int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda x: (x[0], x[1], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest())
    own = {c: [x[2:] for x in sorted(v, key=key)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, ids in members.items():
        under = [x for x in members if x[: len(node)] == node]
        inner = {x[:-1] for x in members if x}
        ends = sorted(c for c in ids if len(built[c]) == len(node))
        out.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(x[:-1] == node for x in members if x),
            sum(x not in inner for x in under), sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in under if x),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(r, conversations, common):
    rows = []
    for c in conversations:
        script = common if r.random() < 0.4 else [(r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "hello there  you"])) for _ in range(r.randrange(0, 7))]
        rows += [(c, k, *x) for k, x in enumerate(script)]
    return [(*x, 1, "clash", 2) for x in rows]


def test_equals_brute_force(spark):
    r = random.Random(5)
    common = [("user", "a b"), ("assistant", "c"), ("user", "same words here"), ("assistant", "x")]
    rows = rows_of(r, [*range(-45, 45), 10**15, -(2**63)], common)
    rows += [(7, None, None, None, 1, "", 1), (7, None, "user", "first", 1, "", 1), (7, 2, "user", "tie", 1, "", 1), (7, 2, "user", "tie", 1, "", 1), (7, 2, "assistant", "other", 1, "", 1), (None, 1, "user", "nobody", 1, "", 1)]
    rows += [(3000 + k, 0, "user", "deep " * (k % 3), 1, "", 1) for k in range(40)]
    r.shuffle(rows)
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_nested_paths_and_long_conversation(spark, monkeypatch):
    """Conversation k leaves the common line after k turns; one is longer than a block and lies in several slices."""
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)
    rows = [(20 * k + 20, t, "user", f"line {t}" if t < k else f"end {k}", 0, "", 0) for k in range(12) for t in range(k + 1)]
    rows += [(5000, t, "user", f"line {t}", 0, "", 0) for t in range(300)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_hot_node_hashes_all_its_ids(spark):
    """Forty thousand equal conversations end at one node, and their ids come in blocks."""
    ids = spark.range(0, 40_000).selectExpr("id * 20 as conv_id", "0 as turn", "'user' as role", "'hi there' as text")
    rows = {r["depth"]: r for r in trie.prefix_trie(ids).collect()}
    want = hashlib.sha256(",".join(str(20 * k) for k in range(40_000)).encode()).hexdigest()
    assert len(rows) == 2 and rows[1]["ends_sha256"] == want and rows[1]["n_convs"] == 40_000 and rows[0]["saved_tokens"] == 2 * 39_999


def test_empty_table_and_no_turns(spark):
    assert got(trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    short = [(c, 0, "user", "x", 0, "", 0) for c in (1, 2, 3, 4, 5)]  # some lose their only turn to a base that is absent
    assert got(trie.prefix_trie(spark.createDataFrame(short, SCHEMA))) == brute(short)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert spark_rows(trie.query(spark, d)) == duck_rows(connect(d), trie.ORACLE_SQL)
