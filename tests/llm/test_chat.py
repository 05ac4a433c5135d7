"""Chat formatting: round trips, folds of odd logs, and brute force."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import chat
from tests.oracle import connect, duck_rows, spark_rows

SCHEMA = "conv_id long, turn long, role string, text string, at string, seq int, message int"
FRAGMENTS = [*chat.CONTROLS, "\\", "<", "[", "/", "s>", "INST]", " ", "\n", "é", "a", "]"]
tricky = st.lists(st.sampled_from(FRAGMENTS)).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), tricky), tricky)))
def test_render_and_parse(turns):
    done = [chat.render_turn(*t) for t in turns]
    assert list(chat.parse_turns("".join(x for x, _ in done))) == turns
    for (role, text), (segment, span) in zip(turns, done):
        assert (span is not None) == (role == "assistant")
        if span:
            assert chat.unescape(segment[span[0] : span[1]]) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    convs = {}
    for c, _, role, text, *_ in sorted(rows, key=key):
        convs.setdefault(c, []).append((role or "", text or ""))
    out = []
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.render_turn(*t)[0]) for t in turns)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def read_back(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return got(chat.digests(chat.Scratch(spark).keep(chat.format_conversations(table), "formatted")))


def odd_rows():
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "tool\\ [TEXT]"]), "".join(r.choice(FRAGMENTS + ["word "] * 9) for _ in range(r.randrange(0, 900)))) for c in range(-3, 25) for t in range(r.randrange(1, 9))]
    rows += [(30, None, "user", "no turn"), (30, 5, "assistant", None), (30, 5, "assistant", "tie"), (30, 5, "assistant", "tie"), (30, -2, None, ""), (None, 1, "user", "nobody"), (None, 0, "assistant", "no one")]
    rows += [(31, t, "assistant", f"long {t} " * 3) for t in range(400)] + [(32, 0, "assistant", "very long é " * 60_000)]
    rows = [(*x, "clash", 1, 2) for x in rows]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [chat.CHUNK, 500])
def test_equals_brute_force(spark, chunk, monkeypatch):
    """Once with conversations in one row, once in rows of 500 characters (set in the workers by a fresh function)."""
    rows = odd_rows()
    if chunk != chat.CHUNK:
        body = chat._render

        def small(batches):
            chat.CHUNK = 500
            yield from body(batches)

        monkeypatch.setattr(chat, "_render", small)
    assert read_back(spark, rows) == brute(rows)


def test_long_conversation_lies_in_several_slices(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"turn {t} " * 20, "", 0, 0) for t in range(3000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        formatted = chat.Scratch(spark).keep(chat.format_conversations(spark.createDataFrame(rows, SCHEMA)), "formatted")
        assert formatted.select("part").distinct().count() > 1
        assert got(chat.digests(formatted)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_empty_table(spark):
    assert read_back(spark, []) == []


def test_log_has_drafts_edits_and_regenerations(spark, small):
    log = chat.conversation_log(spark.read.parquet(f"{small}/conversations.parquet"))
    kinds = {r["event"]: r["count"] for r in log.groupBy("event").count().collect()}
    assert min(kinds[k] for k in ("open", "delta", "edit", "regenerate")) > 0
    assert kinds["open"] == spark.read.parquet(f"{small}/conversations.parquet").count()


def test_fold_of_interleaved_log(spark):
    """Events of several messages mixed, an early message edited last, unknown and null events, no open."""
    r = random.Random(9)
    rows, want = [], []
    for c in (1, 2, None):
        state, order = {}, []
        for seq in range(400):
            m = r.choice("abcdefg")
            event = r.choice(["delta"] * 6 + ["edit", "regenerate", "noise", None]) if m in state or m == "g" else "open"
            text = r.choice(["x ", "y", None, ""])
            rows.append((c, m, seq, event, r.choice(["user", None]) if event == "open" else None, text))
            if m not in state:
                state[m] = ["", ""]
                order.append((seq, m))
            if event == "open":
                state[m][0] = rows[-1][4] or ""
            elif event == "delta":
                state[m][1] += text or ""
            elif event == "edit":
                state[m][1] = text or ""
            elif event == "regenerate":
                state[m][1] = ""
        want += [(c, seq, *state[m]) for seq, m in order]
    r.shuffle(rows)
    log = spark.createDataFrame(rows, "conv_id long, message string, seq long, event string, role string, text string").repartition(4)
    assert got(chat.fold_log(log)) == sorted(want, key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert spark_rows(chat.query(spark, d)) == duck_rows(connect(d), chat.ORACLE_SQL)
