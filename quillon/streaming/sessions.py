"""The session reducer under Structured Streaming: keyed state in parts, timers and a restored start.

A session's state is its running numbers, a map of its active nodes (and the root) and a map of
archived ones. A batch reads the active nodes of the sessions that have events in it and writes
back only the nodes that these events have added or changed. State in parts needs the RocksDB
provider (ROCKSDB)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.asof import PLACES
from quillon.plans import fold
from quillon.plans.replay import TURN_STATS, prepared
from quillon.schemas import Policy
from quillon.sources.folders import Scratch

IDLE_MS = 1800 * 1000
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
NUMBERS = ["turn", "raw", "gc_runs", "freed", "archived", "tokens", "deepest", "widest", "anchor_turn"]
NODE = "kind string, title string, text string, node_tokens long, cost long, bare boolean, parent long, depth long, children long, swept long, vector array<double>, score double, semantic double"
#: a session as rows, one for each node that is active, and the root; with vectors archived ones too
SNAPSHOT = "session_id string, " + ", ".join(f"{n} long" for n in NUMBERS) + ", node_turn long, " + NODE
NODE_COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def _stored(n: fold.Node) -> tuple:
    return n.kind, n.title, n.text, n.tokens, n.cost, n.bare, n.parent, n.depth, n.children, n.swept, None if n.vector is None else n.vector.tolist(), float(n.score), float(n.semantic)


def _node(turn: int, kind, title, text, tokens, cost, bare, parent, depth, children, swept, vector, score, semantic) -> fold.Node:
    gone = None if pd.isna(swept) else int(swept)
    return fold.Node(int(turn), kind, title, text, int(tokens), int(cost), bool(bare), int(parent), int(depth), active=gone is None, swept=gone, children=int(children), vector=None if vector is None else np.asarray(list(vector), np.float64), score=float(score), semantic=float(semantic))


class _Sessions(StatefulProcessor):
    """Turn statistics as events come or, with `snapshots`, a session's rows when it times out."""

    def __init__(self, policy: Policy, idle_ms: int | None, snapshots: bool, hits: int | None):
        self.policy, self.idle_ms, self.snapshots, self.hits = policy, idle_ms, snapshots, hits
        self.semantic = hits is not None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", ", ".join(f"{n} long" for n in NUMBERS))
        self.nodes = handle.getMapState("nodes", "turn long", NODE)
        self.archive = handle.getMapState("archive", "turn long", NODE)

    def _load(self, session_id: str) -> fold.Session:
        if not self.numbers.exists():
            return fold.Session(session_id, self.policy, self.semantic)
        nodes = [_node(*turn, *value) for turn, value in self._rows()]
        return fold.Session.restored(session_id, nodes, self.policy, self.semantic, **{n: int(x) for n, x in zip(NUMBERS, self.numbers.get())})

    def _rows(self) -> list:
        """Stored nodes; a search looks at archived ones too."""
        return [*self.nodes.iterator(), *(self.archive.iterator() if self.semantic else ())]

    def _save(self, s: fold.Session) -> None:
        self.numbers.update(tuple(getattr(s, n) for n in NUMBERS))
        for turn in s.touched:
            n = s.nodes[turn]
            if n.active or not turn:
                self.nodes.updateValue((turn,), _stored(n))
            else:
                self.archive.updateValue((turn,), _stored(n))
                if self.nodes.containsKey((turn,)):
                    self.nodes.removeKey((turn,))

    def _wait(self, timerValues) -> None:
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._load(key[0])
        events = sorted((e for frame in rows for e in frame.to_dict("records")), key=lambda e: e["sequence"])
        search = {"search": (self.hits, PLACES)} if self.semantic else {}
        out = [{"session_id": key[0]} | fold.step(s, e | search, not self.snapshots) for e in events]
        self._save(s)
        self._wait(timerValues)
        yield pd.DataFrame([] if self.snapshots else out, columns=[c.split()[0] for c in (SNAPSHOT if self.snapshots else TURN_STATS).split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.snapshots and self.numbers.exists():
            numbers = self.numbers.get()
            rows = [(key[0], *numbers, *turn, *value) for turn, value in self._rows()]
            yield pd.DataFrame(rows, columns=["session_id", *NUMBERS, "node_turn", *NODE_COLUMNS]).astype({"swept": "Int64"})
        for state in (self.numbers, self.nodes, self.archive):
            state.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.to_dict("records"):
            self.numbers.update(tuple(int(row[n]) for n in NUMBERS))
            turn, node = int(row["node_turn"]), _node(row["node_turn"], *(row[c] for c in NODE_COLUMNS))
            (self.nodes if node.active or not turn else self.archive).updateValue((turn,), _stored(node))
        self._wait(timerValues)

    def close(self) -> None:
        pass


def keyed_session(spark: SparkSession) -> SparkSession:
    """A session whose streams keep state in parts; the caller's keeps its own state store."""
    keyed = spark.newSession()
    for name, value in ROCKSDB.items():
        keyed.conf.set(name, value)
    return keyed


def _sessions(events: DataFrame, policy: Policy, idle_ms: int | None, initial: DataFrame | None, snapshots: bool, hits: int | None) -> DataFrame:
    start = initial.select([c.split()[0] for c in SNAPSHOT.split(", ")]).groupBy("session_id") if initial is not None else None
    return prepared(events, hits is not None).groupBy("session_id").transformWithStateInPandas(_Sessions(policy, idle_ms, snapshots, hits), SNAPSHOT if snapshots else TURN_STATS, "Append", "ProcessingTime" if idle_ms else "None", start)


def session_stream(events: DataFrame, policy: Policy = Policy(), idle_ms: int | None = None, initial: DataFrame | None = None, hits: int | None = None) -> DataFrame:
    """Turn statistics of a stream of events, as the batch replay gives them.

    A batch's events of a session are taken in order of sequence. With idle_ms (such as IDLE_MS),
    a session idle so long is dropped; `snapshot_stream` gives what is dropped. A query that is
    to end by itself (availableNow) must leave idle_ms out: timers keep it running. initial: a
    batch table of SNAPSHOT rows (a node's rows of a session may come in any order) that sessions
    start from. hits: with events that have a vector, how many live and archived nodes a user's
    turn finds, as in the semantic replay; a batch then reads all nodes of its sessions. Nothing
    is dropped for lack of room."""
    return _sessions(events, policy, idle_ms, initial, False, hits)


def snapshot_stream(events: DataFrame, policy: Policy = Policy(), idle_ms: int = IDLE_MS, initial: DataFrame | None = None, hits: int | None = None) -> DataFrame:
    """SNAPSHOT rows of each session that has been idle for idle_ms, which is then dropped."""
    return _sessions(events, policy, idle_ms, initial, True, hits)


def running_metrics(events: DataFrame) -> DataFrame:
    """Events, user turns and tokens of each session so far (A17); update or complete mode."""
    return events.groupBy("session_id").agg(F.count("*").alias("total_events"), F.count_if(F.col("event_type") == "user_prompt").alias("total_turns"), F.sum("token_count").alias("tokens"))


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows, late ones within the watermark counted."""
    return events.withWatermark("created_at", watermark).groupBy(F.window("created_at", window), "event_type").agg(F.count("*").alias("n"))


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is available as Parquet and stops."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def conversation_stream(spark: SparkSession, sf_dir: str, policy: Policy = Policy()) -> DataFrame:
    """Turn statistics of the conversations table read as a stream, to its end, by way of Parquet files."""
    from quillon.sources.tables import conversation_events

    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    spark = keyed_session(spark)
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.par*")
    folder = Scratch(spark).root  # goes when the application ends
    run_to_end(session_stream(conversation_events(spark, sf_dir, stream), policy), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(TURN_STATS).parquet(f"{folder}/out")
