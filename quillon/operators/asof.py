"""As-of similarity join: a query of a turn meets the nodes that were alive, or archived, at that turn.

A node lives from `made` to before `swept` and is archived from `swept` on, so that one pair of
numbers decides in which of the two searches it takes part. Turns and nodes of a session are cut
into blocks by turn; a block of turns meets the blocks of nodes made no later than its last turn.
Two blocks are one group, compared by products of matrices, which leave each turn's k nearest of either
kind; a window over these few rows merges them. A long session is thus many pairs of blocks, not
one group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_K = 12
TURNS, NODES = 1024, 4096  # turns of a block of queries, and of a block of nodes
SLICE = 256  # turns that are compared at once
PLACES = 12  # sums of products in another order differ beyond these places

HITS = "session_id string, turn_number long, node_turn long, archived boolean, hit double"
_SCHEMA = pa.schema([("session_id", pa.string()), ("turn_number", pa.int64()), ("node_turn", pa.int64()), ("archived", pa.bool_()), ("hit", pa.float64())])


def _matrix(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit rows of the vectors of each length; zero vectors stay zero."""
    out, sizes = {}, np.asarray(pc.list_value_length(vectors))
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        x = np.asarray(vectors.take(pa.array(at)).flatten(), np.float64).reshape(len(at), d)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        out[d] = at, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return out


def _best(hits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row, equal ones by column; what is below 0 doesn't count."""
    if hits.shape[1] > k:
        least = np.partition(hits, -k, axis=1)[:, -k, None]
        above, ties = hits > least, hits == least
        i, j = np.nonzero(ties)  # of those equal to the k-th, the first that there is room for
        nth = np.arange(len(i)) - np.searchsorted(i, i, "left")
        late = nth >= (k - above.sum(axis=1))[i]
        ties[i[late], j[late]] = False
        return np.nonzero((above | ties) & (hits >= 0))
    return np.nonzero(hits >= 0)


def _nearest(session: str, turns, asked, nodes, made, swept, held, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest live and archived nodes of each turn within two blocks; equal hits by node."""
    far = np.iinfo(np.int64).max
    swept = np.asarray(swept.fill_null(far), np.int64)
    sides = _matrix(held)
    for d, (at, x) in _matrix(asked).items():
        if d not in sides:
            continue
        place, y = sides[d]
        order = np.argsort(nodes[place], kind="stable")
        place, y = place[order], y[order]
        hits = np.clip(np.round(x @ y.T, PLACES), 0.0, 1.0)
        when = turns[at][:, None]
        for archived in (False, True):
            can = (made[place] <= when) & ((swept[place] <= when) if archived else (swept[place] > when))
            i, j = _best(np.where(can, hits, -1.0), k)
            if not len(i):
                continue
            hit = hits[i, j]
            yield pa.RecordBatch.from_arrays([pa.array([session] * len(i), pa.string()), pa.array(turns[at][i]), pa.array(nodes[place[j]]), pa.array(np.full(len(i), archived)), pa.array(hit)], schema=_SCHEMA)


def _sessions(rows: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    rows = rows.sort_by("session_id")
    runs = pc.run_end_encode(rows["session_id"].combine_chunks())
    start = 0
    for session, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
        yield session, rows.slice(start, end - start)
        start = end


def _compare(k: int):
    """Blocks of turns and blocks of nodes of a bundle's sessions, as rows; a pair of blocks is compared in parts of SLICE turns."""

    def run(turns: pa.Table, nodes: pa.Table) -> Iterator[pa.RecordBatch]:
        of_session = dict(_sessions(nodes))
        for session, some in _sessions(turns):
            if session in of_session:
                there = of_session[session]
                held = [there["node_turn"].to_numpy(), there["made"].to_numpy(), there["swept"].combine_chunks(), there["vector"].combine_chunks()]
                turn, asked = some["turn_number"].to_numpy(), some["vector"].combine_chunks()
                for a in range(0, len(turn), SLICE):
                    yield from _nearest(session, turn[a : a + SLICE], asked.slice(a, SLICE), *held, k)

    def whole(turns: pa.Table, nodes: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(turns, nodes)), _SCHEMA)

    return whole


def asof_top_k(queries: DataFrame, nodes: DataFrame, k: int = TOP_K) -> DataFrame:
    """(session_id, turn_number, node_turn, archived, hit, rank) of queries (session_id, turn_number, vector).

    nodes: (session_id, node_turn, made, swept, vector); swept is null for a node that was never
    swept. hit is the cosine, to PLACES places, held between 0 and 1, and 0 for a zero vector; equal hits
    are ordered by node_turn. Vectors that are null or hold null or NaN, and vectors of other lengths than the
    query's, take no part. k below 1 means 10."""
    k = k if k > 0 else 10
    sound = F.expr("vector is not null and not exists(vector, x -> x is null or isnan(x))")
    again = lambda *columns: [F.col(c).alias(c) for c in columns]  # noqa: E731  # both sides may come of one table
    asked = queries.where(sound).select(*again("session_id", "turn_number", "vector"))
    held = nodes.where(sound).select(*again("session_id", "node_turn", "made", "swept", "vector"))
    bundles = max(1, -(-asked.count() // TURNS))  # short sessions share a group
    bundle = F.pmod(F.xxhash64("session_id"), F.lit(bundles)).alias("bundle")
    turn_block, made_block = F.expr(f"greatest(0, turn_number) div {TURNS}"), F.expr(f"greatest(0, made) div {NODES}")
    last = asked.groupBy("session_id").agg(F.max(turn_block).alias("last"))
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"((greatest(0, turn_number) div {TURNS} + 1) * {TURNS} - 1) div {NODES}"))
    asked = asked.select(bundle, turn_block.alias("turn_block"), F.explode(blocks).alias("made_block"), "session_id", "turn_number", "vector")
    held = held.withColumn("made_block", made_block).join(last, "session_id").withColumn("from", F.expr(f"made_block * {NODES} div {TURNS}")).where("from <= last")
    held = held.select(bundle, F.explode(F.sequence("from", "last")).alias("turn_block"), "made_block", "session_id", "node_turn", "made", "swept", "vector")
    key = ["bundle", "turn_block", "made_block"]
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(_compare(k), HITS)
    best = Window.partitionBy("session_id", "turn_number", "archived").orderBy(F.desc("hit"), "node_turn")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
