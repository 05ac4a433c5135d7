"""Hard-negative mining by bit-sliced integer products.

Components are whole numbers in two's complement. A product with an anchor is summed plane by
plane, the most significant bit of all components first: after each plane the bits that are left
of a component lie between 0 and 2^b - 1, which gives every score an interval of
(2^b - 1) * [sum of the anchor's negative components, sum of its positive ones]. A row whose
interval can no longer qualify is dropped before the next plane is added: for positives, when it
lies under the k-th best lower end; for negatives, when it meets no positive's band, or lies
under the k-th best lower end of those sure to be in the band. What is left after the last plane
has its exact score.

Rows are dealt into stripes of bounded size. Every anchor visits every stripe, in blocks, and
leaves its best few there; windows merge these. First come the positives, whose scores give the
bands that the anchors carry on their second visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.spark_util import Scratch, parts_for

POSITIVES, NEGATIVES = 5, 5
LOW_SHARE, SHARE = 80, 100  # a negative's score is at least 80 / 100 of the positive's, and at most all of it
SCALE = 256
STRIPE, STRIPE_BYTES = 1 << 17, 128 << 20  # most rows and bytes of a stripe, which one task holds
LEAST = 1 << 11  # a stripe has more rows than this, unless the table is small
TASKS = 2_000  # most tasks that the stripes are dealt to; a task takes several stripes one after the other
ROWS, BLOCK = 8_192, 64  # rows and anchors whose scores are held at once
SPARSE = 8  # once fewer than one pair in so many is left, pairs are carried on one by one
EXACT = 1 << 62  # products below are summed in 64 bits, others in Python's whole numbers
LONGS = -(1 << 63), (1 << 63) - 1

OUT = "anchor long, other_uid long, other_id long, slot int, score long"
_SCHEMA = pa.schema([("anchor", pa.int64()), ("other_uid", pa.int64()), ("other_id", pa.int64()), ("slot", pa.int32()), ("score", pa.int64())])


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components as floor(SCALE * x). Rows whose scaled components aren't finite go; `wide` marks those beyond 64 bits, whose numbers are text."""
    for batch in batches:
        out = []
        for uid, vec_id, label, v in zip(*(c.to_pylist() for c in batch.columns)):
            x = np.floor(SCALE * np.asarray(v, np.float64))
            if np.isfinite(x).all():
                wide = bool((np.abs(x) >= float(EXACT)).any())
                q = ",".join(str(int(y)) for y in x).encode() if wide else x.astype(np.int64).tobytes()
                out.append((uid, vec_id, label, len(x), wide, q))
        names = ["uid", "vec_id", "label", "d", "wide", "q"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("d", pa.int32()), ("wide", pa.bool_()), ("q", pa.binary())]))


def _whole(blobs: list[bytes], wide: np.ndarray, d: int) -> np.ndarray:
    """Rows of whole numbers: 64 bits where all fit, else Python's."""
    if not wide.any():
        return np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), d)
    rows = [[int(y) for y in b.split(b",")] if w else np.frombuffer(b, np.int64).tolist() for b, w in zip(blobs, wide)]
    return np.array(rows, object).reshape(len(rows), d)


def _kth(values: np.ndarray, can: np.ndarray, k: int, least: int) -> np.ndarray:
    """The k-th largest value of each column among those that can be it, or `least`."""
    if len(values) < k:
        return np.full(values.shape[1], least, values.dtype)
    held = np.where(can, values, least)
    return np.sort(held, axis=0)[-k] if held.dtype == object else np.partition(held, len(held) - k, axis=0)[len(held) - k]


class _Sliced:
    """Scores of rows with anchors as intervals that each plane narrows."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        most = lambda x: max((abs(int(y)) for y in (x.max(), x.min())), default=0) if x.size else 0
        bits = most(rows).bit_length()
        fits = (most(rows) + 1) * most(anchors) * rows.shape[1] * 4 < EXACT
        self.fits, kind = fits, np.int64 if fits else object
        self.rows, self.anchors = rows.astype(kind), anchors.astype(kind)
        self.least = -EXACT if fits else -(1 << 8192)
        self.plane = bits  # bits that are left below the part that has been added
        # sums of up to 2^53 are exact in floating point, whose products of matrices are faster
        self.fast = fits and most(anchors) * rows.shape[1] < 1 << 52
        zero = np.zeros_like(self.anchors)
        self.up, self.down = np.maximum(self.anchors, zero).sum(axis=1), np.minimum(self.anchors, zero).sum(axis=1)
        self.part = self._product(self.rows >> bits, self.anchors)  # the sign: 0 or -1
        self.alive = np.arange(len(rows))

    def _product(self, planes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        if self.fast:
            return np.rint(planes.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
        return planes.dot(anchors.T)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        rest = (1 << self.plane) - 1
        full = self.part * (1 << self.plane)
        return full + rest * self.down[None, :], full + rest * self.up[None, :]

    def add_plane(self) -> None:
        self.plane -= 1
        self.part = self.part * 2 + self._product((self.rows >> self.plane) & 1, self.anchors)

    def keep_rows(self, some: np.ndarray) -> None:
        self.rows, self.part, self.alive = self.rows[some], self.part[some], self.alive[some]


def _finish(s: _Sliced, can: np.ndarray, useful) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, anchors and exact scores of the pairs left when few are: plane by plane for each pair."""
    i, j = np.nonzero(can)
    part, plane = s.part[i, j], s.plane
    while True:
        rest, full = (1 << plane) - 1, part * (1 << plane)
        keep = useful(full + rest * s.down[j], full + rest * s.up[j], j)
        i, j, part = i[keep], j[keep], part[keep]
        if not plane or not len(i):
            return s.alive[i], j, part * (1 << plane)
        plane -= 1
        part = part * 2 + (((s.rows[i] >> plane) & 1) * s.anchors[j]).sum(axis=1)


def _best(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Places of the first k pairs of each column by score, then id; columns in ascending order."""
    order = sorted(range(len(rows)), key=lambda x: (cols[x], -scores[x], ids[rows[x]])) if scores.dtype == object else np.lexsort((ids[rows], -scores, cols))
    order = np.asarray(order, np.int64)
    c = cols[order]
    first = np.searchsorted(c, c, "left") if len(c) else c
    return order[np.arange(len(c)) - first < k]


def mine_positives(rows, uids, labels, anchors, anchor_uids, anchor_labels, floor: list[int | None], k: int = POSITIVES):
    """(row, anchor, slot 0, score) of all rows of each anchor's label that can be among its first k; none with a score under `floor`."""
    s = _Sliced(rows, anchors)
    known = np.array([s.least if x is None else min(x, -s.least) for x in floor], s.part.dtype)
    can = (labels[:, None] == anchor_labels[None, :]) & (uids[:, None] != anchor_uids[None, :])
    while True:
        low, high = s.ends()
        sure = can if s.fits else can & (low >= LONGS[0]) & (high <= LONGS[1])
        known = np.maximum(known, _kth(low, sure, k, s.least))
        can &= high >= known[None, :]
        some = can.any(axis=1)
        if not some.all():
            s.keep_rows(some)
            can = can[some]
        if not s.plane or not len(can):
            i, j = np.nonzero(can)
            found = s.alive[i], j, s.part[i, j]
            break
        if np.count_nonzero(can) * SPARSE < can.size:
            found = _finish(s, can, lambda low, high, j: high >= known[j])
            break
        s.add_plane()
    some = (found[2] >= LONGS[0]) & (found[2] <= LONGS[1])
    return found[0][some], found[1][some], np.zeros(np.count_nonzero(some), np.int64), found[2][some]


def mine_negatives(rows, labels, anchors, anchor_labels, bands: list[list[int]], floor: list[list[int | None]], k: int = NEGATIVES):
    """(row, anchor, slot, score) of all rows of another label that can be among the first k of a band; none with a score under `floor` (slot, anchor).

    The band of a positive's score p is LOW_SHARE * p <= SHARE * score <= SHARE * p."""
    s = _Sliced(rows, anchors)
    kind = s.part.dtype
    slots = max(map(len, bands), default=0)
    # the least and largest whole score of each band; that of a negative score holds none
    ends = [[(-(-LOW_SHARE * b[t] // SHARE), b[t]) if t < len(b) and b[t] >= 0 else (-s.least, s.least) for b in bands] for t in range(slots)]
    lo, hi = (np.array([[x[e] for x in row] for row in ends], kind).reshape(slots, len(bands)) for e in (0, 1))
    can = labels[:, None] != anchor_labels[None, :]
    known = np.array([[s.least if x is None else min(x, -s.least) for x in row] for row in floor], kind).reshape(slots, len(bands))

    def meets(low, high, j):
        out = np.zeros(low.shape, bool)
        for t in range(slots):
            out |= (high >= np.maximum(lo[t], known[t])[j]) & (low <= hi[t][j])
        return out

    columns = np.arange(len(bands))
    while True:
        low, high = s.ends()
        for t in range(slots):
            sure = can & (low >= lo[t][None, :]) & (high <= hi[t][None, :])
            known[t] = np.maximum(known[t], _kth(low, sure, k, s.least))
        can &= meets(low, high, np.broadcast_to(columns, low.shape))
        some = can.any(axis=1)
        if not some.all():
            s.keep_rows(some)
            can = can[some]
        if not s.plane or not len(can):
            i, j = np.nonzero(can)
            found = s.alive[i], j, s.part[i, j]
            break
        if np.count_nonzero(can) * SPARSE < can.size:
            found = _finish(s, can, meets)
            break
        s.add_plane()
    out = []
    i, j, score = found
    for t in range(slots):
        inside = (score >= np.maximum(lo[t], known[t])[j]) & (score <= hi[t][j])
        out.append((i[inside], j[inside], np.full(np.count_nonzero(inside), t), score[inside]))
    return tuple(np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64) for c in range(4))


def _visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stripe's rows come before its anchors; only the stripe and a block of anchors are held."""
    stripe, held, sides = None, [], None
    for batch in batches:
        column = {name: batch.column(name) for name in batch.schema.names}
        keys = np.column_stack([column[c].to_numpy(zero_copy_only=False) for c in ("d", "stripe", "side")]).astype(np.int64)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            where, side = tuple(keys[a][:2]), keys[a][2]
            if where != stripe:
                stripe, held, sides = where, [], None
            part = batch.slice(a, b - a)
            if side == 0:
                held.append(part)
                continue
            if not held and sides is None:
                continue  # no row lies in this stripe
            if sides is None:
                sides = _columns(pa.Table.from_batches(held), int(stripe[0]))
                held = []
            for at in range(0, len(part), BLOCK):
                yield from _compare(sides, part.slice(at, BLOCK), int(stripe[0]))


def _columns(table, d: int):
    uid, vec_id, label, wide = (table.column(c).to_numpy() if isinstance(table, pa.Table) else table.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "vec_id", "label", "wide"))
    return uid, vec_id, label, _whole(table.column("q").to_pylist(), wide, d)


def _compare(rows, block: pa.RecordBatch, d: int) -> Iterator[pa.RecordBatch]:
    uids, ids, labels, q = rows
    a_uids, _, a_labels, a = _columns(block, d)
    bands = block.column("bands").to_pylist()
    k, slots = (POSITIVES, 1) if bands[0] is None else (NEGATIVES, max(map(len, bands)))
    best, floor = None, [[None] * len(block) for _ in range(slots)]
    for at in range(0, len(q), ROWS):
        x = slice(at, at + ROWS)
        if bands[0] is None:
            i, *found = mine_positives(q[x], uids[x], labels[x], a, a_uids, a_labels, floor[0], k)
        else:
            i, *found = mine_negatives(q[x], labels[x], a, a_labels, bands, floor, k)
        found = [i + at, *found]
        best = found if best is None else [np.concatenate(y) for y in zip(best, found)]
        first = _best(best[0], best[2] * len(block) + best[1], best[3], ids, k)
        best = [y[first] for y in best]
        full, count = np.unique(best[2] * len(block) + best[1], return_counts=True)
        for y, last in zip(full[count == k], (np.cumsum(count) - 1)[count == k]):
            floor[y // len(block)][y % len(block)] = int(best[3][last])
    i, j, slot, score = best
    yield pa.RecordBatch.from_arrays([pa.array(a_uids[j]), pa.array(uids[i]), pa.array(ids[i]), pa.array(slot.astype(np.int32)), pa.array(score.astype(np.int64))], schema=_SCHEMA)


def _meet(rows: DataFrame, anchors: DataFrame, stripes: int) -> DataFrame:
    columns = ["d", "stripe", "side", "uid", "vec_id", "label", "wide", "q", "bands"]
    rows = rows.withColumns({"side": F.lit(0), "bands": F.lit(None).cast("array<long>")}).select(columns)
    anchors = anchors.withColumns({"side": F.lit(1), "stripe": F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))}).select(columns)
    both = rows.unionByName(anchors)
    return both.repartition(min(stripes, TASKS), "d", "stripe").sortWithinPartitions("d", "stripe", "side").mapInArrow(_visit, OUT)


def hard_negatives(vectors: DataFrame, every: int = 100, relabel: int = 7, labels: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`; where it is divisible by
    `relabel`, the label becomes (label + 1) % `labels` first. Rows whose vec_id, label or vector
    is null, or that hold null or non-finite components, or components that are not finite when
    scaled, take no part. Vectors of different lengths are not compared, nor are pairs whose
    score is beyond 64 bits. Repeated rows of a vec_id are rows of their own; an anchor is only
    barred from its own row. An empty table gives an empty result; further columns are ignored."""
    scratch = Scratch(vectors.sparkSession)
    name = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    label = F.col("label").cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast(f"array<{name}>").alias("v")).where("vec_id is not null and label is not null")
    rows = rows.where(F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    # uid numbers the rows; it is fixed by the table that is written
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "v").mapInArrow(_scaled, "uid long, vec_id long, label long, d int, wide boolean, q binary")
    rows = scratch.keep(rows, "rows")
    n, d = rows.agg(F.count("*"), F.max("d")).first()
    tasks = min(TASKS, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    stripes = max(parts_for(n, min(STRIPE, max(LEAST, STRIPE_BYTES // (8 * (d or 1))))), min(tasks, parts_for(n, LEAST)))
    rows = rows.withColumn("stripe", F.pmod(F.xxhash64("uid"), F.lit(stripes)).cast("int"))
    anchors = rows.where(F.col("vec_id") % every == 0)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "other_id", "other_uid")
    positives = _meet(rows, anchors.withColumn("bands", F.lit(None).cast("array<long>")), stripes)
    positives = scratch.keep(positives.withColumn("slot", F.row_number().over(first) - 1).where(F.col("slot") < POSITIVES), "positives")
    bands = positives.groupBy(F.col("anchor").alias("uid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "score"))), lambda x: x["score"]).alias("bands"))
    negatives = _meet(rows, anchors.join(bands, "uid"), stripes)
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other_id", "other_uid")
    negatives = negatives.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES)
    known = positives.select("anchor", "slot", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(known, ["anchor", "slot"]).join(anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.other_id))::INTEGER AS rank,
       n.other_id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN scores n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.other_id) <= 5
"""
