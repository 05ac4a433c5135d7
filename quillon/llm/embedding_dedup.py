"""Embedding near-dedup by PCA-ordered tiled comparison.

Distinct vectors are rotated onto the principal axes of all vectors, split into cells along
the leading axes and packed into tiles. Two cells are compared unless their boxes are
further apart than the threshold allows. Within two tiles the products of the leading axes
come first; with the norms of what is left of both vectors they bound the cosine, and pairs
that can't reach the threshold are dropped before more axes are added. What remains is
decided by the cosine of the vectors as given, in double precision.

A tile pair returns link counts and a forest of its links, never its links.

Tiles are dealt in stripes of neighbouring cells. A task compares two stripes; a round brings one
or several stripes to the tasks of all others that are near, and its shuffle files go when it
ends. What lies on disk thus stays in proportion to the vectors, though all rounds together
move each tile once for each stripe near it, as an exact join of what doesn't separate must.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.spark_util import Scratch, components, freed_shuffles, parts_for

COSINE = 0.95
TILE, CELLS, FAN = 4096, 4096, 4  # vectors of a tile, most cells (one box each), parts that an axis splits a cell into
STRIPE, STRIPES = 8 << 20, 24  # bytes of a stripe's tiles at most; as many stripes where there are tiles enough
ROUND = 64 << 20  # bytes that a round shuffles, or else twice those of all tiles
STEPS = (8, 24)  # leading axes after which pairs are dropped
MARGIN = 1e-9
BLOCK = 512


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if len(batch):
            x = _unit(_matrix(batch.column(0)))
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])


def _axes(vectors: DataFrame, d: int) -> np.ndarray:
    """Principal axes (columns, widest first) of all unit vectors: sums of outer products by partition, then by row."""
    rows = vectors.select("v").mapInArrow(_moments, "i int, row array<double>").groupBy("i").agg(F.array(*(F.sum(F.col("row")[j]) for j in range(d))).alias("row")).collect()
    square = np.zeros((d, d))
    for r in rows:
        square[r["i"]] = r["row"]
    return np.linalg.eigh((square + square.T) / 2)[1][:, ::-1].copy()


def _leading(axes: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                p = _unit(_matrix(batch.column(2))) @ axes[:, :n]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(p), pa.list_(pa.float64()))], names=["rep", "copies", "v", "p"])

    return run


def _cells(spark, points: DataFrame, count: int, n: int) -> DataFrame:
    """points with their cell: cells are split in FAN parts by quantiles of one leading axis after the other.

    The quantiles, one row a cell, are broadcast: at most CELLS rows."""
    points, cells, axis = points.withColumn("cell", F.lit(0)), 1, 0
    while cells < min(CELLS, count / TILE) and axis < n:
        cuts = points.groupBy("cell").agg(F.percentile_approx(F.col("p")[axis], [k / FAN for k in range(1, FAN)], 1000).alias("q")).collect()
        cuts = spark.createDataFrame([(r["cell"], list(r["q"])) for r in cuts], "cell int, q array<double>")
        x = F.col("p")[axis]
        points = points.join(F.broadcast(cuts), "cell").withColumn("cell", (F.col("cell") * FAN + F.size(F.filter("q", lambda q: x >= q))).cast("int")).drop("q")
        cells, axis = cells * FAN, axis + 1
    return points


def _pack(d: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        blob = table["rep"].to_numpy().astype(np.int64).tobytes() + table["copies"].to_numpy().astype(np.int64).tobytes() + _matrix(table["v"]).astype(kind).tobytes()
        return pa.table({"cell": table["cell"][:1], "tile": table["tile"][:1], "n": pa.array([len(table)], pa.int32()), "blob": pa.array([blob], pa.binary())})

    return run


class _Tile:
    def __init__(self, blob: bytes, n: int, d: int, kind: str, axes: np.ndarray):
        self.rep, self.copies = np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.int64, n, 8 * n)
        self.v = _scaled(np.frombuffer(blob, kind, n * d, 16 * n).reshape(n, d).astype(np.float64))
        self.norm = np.linalg.norm(self.v, axis=1)
        self.p = (self.v / self.norm[:, None]) @ axes
        self.rest = {k: np.sqrt(np.maximum(0, (self.p[:, k:] ** 2).sum(axis=1))) for k in STEPS if k < d}


def _linked(a: _Tile, rows: slice, b: _Tile, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) with at least that cosine."""
    known, k = None, 0
    for step in a.rest:
        new = a.p[rows, k:step] @ b.p[:, k:step].T
        known = new if known is None else known + new
        k = step
        can = known + a.rest[step][rows, None] * b.rest[step][None, :] >= cosine - MARGIN
        if np.count_nonzero(can) < can.size // 20:
            i, j = np.nonzero(can)
            break
    else:
        close = a.p[rows] @ b.p.T >= cosine - MARGIN
        i, j = np.nonzero(close)
    i = i + rows.start
    keep = [np.zeros(0, bool)]
    for s in range(0, len(i), 1 << 16):
        x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        keep.append(np.einsum("ij,ij->i", a.v[x], b.v[y]) / (a.norm[x] * b.norm[y]) >= cosine)
    keep = np.concatenate(keep)
    return i[keep], j[keep]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a star for each component of the links (u, v)."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(names)))
    return names[child], names[label[child]]


def _compare(d: int, kind: str, axes: np.ndarray, cosine: float, boxes: dict[int, tuple[np.ndarray, np.ndarray]], reach: float):
    """Links between two stripes' tiles whose cells' boxes are within reach."""

    def tiles(table: pa.Table) -> Iterator[tuple[int, int, _Tile]]:
        for r in range(len(table)):
            cell, tile, n, blob = (table[c][r].as_py() for c in ("cell", "tile", "n", "blob"))
            yield cell, tile, _Tile(blob, n, d, kind, axes)

    def near(a: int, b: int) -> bool:
        (low_a, high_a), (low_b, high_b) = boxes[a], boxes[b]
        return float((np.maximum(0, np.maximum(low_b - high_a, low_a - high_b)) ** 2).sum()) <= reach

    def pairs(some: list, other: list | Iterator) -> Iterator[tuple[_Tile, _Tile]]:
        for cell_b, tile_b, b in other:
            for cell_a, tile_a, a in some:
                if near(cell_a, cell_b):
                    yield a, b

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([], _LINKS)
        some = list(tiles(left))
        if left["stripe"][0].as_py() == right["stripe"][0].as_py():
            todo = ((a, b) for k, x in enumerate(some) for a, b in pairs([x], some[k:]))
        else:
            todo = pairs(some, tiles(right))
        return pa.Table.from_batches([x for a, b in todo for x in _tile_links(a, b, cosine)], _LINKS)

    return run


def _tile_links(a: _Tile, b: _Tile, cosine: float) -> Iterator[pa.RecordBatch]:
    n1, n2 = len(a.rep), len(b.rep)
    links_a, links_b = np.zeros(n1, np.int64), np.zeros(n2, np.int64)
    us, vs = [], []
    for s in range(0, n1, BLOCK):
        i, j = _linked(a, slice(s, min(n1, s + BLOCK)), b, cosine)
        if a is b:
            i, j = i[i < j], j[i < j]
        if len(i):
            links_a += np.bincount(i, b.copies[j], n1).astype(np.int64)
            links_b += np.bincount(j, a.copies[i], n2).astype(np.int64)
            u, v = _forest(a.rep[i], b.rep[j])
            us.append(u)
            vs.append(v)
    for tile, links in ((a, links_a), (b, links_b)):
        some = links > 0
        yield _rows(0, tile.rep[some], links[some])
    if us:
        yield _rows(1, *_forest(np.concatenate(us), np.concatenate(vs)))


_LINKS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])


def _boxes(points: DataFrame, axes: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    ends = [f(F.col("p")[k]).alias(f"{s}{k}") for k in range(axes) for s, f in (("low", F.min), ("high", F.max))]
    rows = points.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect()
    return {r["cell"]: (r["n"], np.array([r[f"low{k}"] for k in range(axes)]), np.array([r[f"high{k}"] for k in range(axes)])) for r in rows}


def _gap(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Squared distance between box k and the boxes from k on."""
    return (np.maximum(0, np.maximum(low[k:] - high[k], low[k] - high[k:])) ** 2).sum(axis=1)


def _compared(scratch: Scratch, distinct: DataFrame, d: int, kind: str, cosine: float) -> DataFrame:
    """Rows (0, vector, links) and (1, vector, vector of its component) of distinct vectors of d components."""
    spark = distinct.sparkSession
    axes = _axes(distinct, d)
    n = min(8, d)
    kept = scratch.keep(distinct.mapInArrow(_leading(axes, n), f"rep long, copies long, v array<{'float' if kind == 'f4' else 'double'}>, p array<double>"), f"points-{d}")
    points = _cells(spark, kept, kept.count(), n)
    boxes = _boxes(points, n)
    reach = 2 - 2 * cosine + MARGIN  # squared distance of unit vectors at the threshold
    names = sorted(boxes)
    low, high = (np.array([boxes[c][k] for c in names]) for k in (1, 2))
    tiles = np.array([parts_for(boxes[c][0], TILE) for c in names])
    # cells in their order make stripes; those with a near pair of cells meet
    size = np.array([boxes[c][0] for c in names]) * (d * int(kind[1]) + 16)
    stripes = max(parts_for(int(size.sum()), STRIPE), min(STRIPES, int(tiles.sum())))
    ends = np.cumsum(size)
    first = (ends - size) * stripes // int(ends[-1])  # a cell of many tiles goes on into the stripes after it
    last = np.maximum(first, (ends - 1) * stripes // int(ends[-1]))
    meet = np.zeros((stripes, stripes), bool)
    for k in range(len(names)):
        near, own = k + np.flatnonzero(_gap(low, high, k) <= reach), slice(first[k], last[k] + 1)
        meet[own, first[near]] = True
        for x in near[last[near] > first[near]].tolist():
            meet[own, first[x] : last[x] + 1] = True
    meet = [tuple(p) for p in np.argwhere(np.triu(meet | meet.T)).tolist()]
    of_cell = spark.createDataFrame(list(zip(names, tiles.tolist(), first.tolist(), last.tolist())), "cell int, tiles int, first long, last long")
    packed = points.join(F.broadcast(of_cell), "cell").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    packed = packed.groupBy("cell", "tile").applyInArrow(_pack(d, kind), "cell int, tile int, n int, blob binary").join(F.broadcast(of_cell), "cell")
    packed = packed.select("cell", "tile", "n", "blob", F.expr("first + tile * (last - first + 1) div tiles").cast("int").alias("stripe"))
    packed = scratch.keep(packed, f"tiles-{d}")
    scratch.drop(f"points-{d}")
    # rounds of stripes whose shuffles keep to the limit
    each, room = int(size.sum()) / stripes, max(ROUND, 2 * int(size.sum()))
    rounds, moved = [[]], 0.0
    for i in sorted({p[0] for p in meet}):
        more = 2 * each * sum(p[0] == i for p in meet)
        if rounds[-1] and moved + more > room:
            rounds, moved = [*rounds, []], 0.0
        rounds[-1].append(i)
        moved += more
    box = {c: (low[k], high[k]) for k, c in enumerate(names)}
    compare = _compare(d, kind, axes, cosine, box, reach)
    found = None
    with freed_shuffles(spark):
        for r, some in enumerate(rounds):
            todo = spark.createDataFrame([p for p in meet if p[0] in set(some)], "i int, j int")
            side = lambda s: F.broadcast(todo).join(packed, F.col(s) == F.col("stripe")).select(*(F.col(c).alias(c) for c in ("i", "j", "stripe", "cell", "tile", "n", "blob"))).groupBy("i", "j")
            part = scratch.keep(side("i").cogroup(side("j")).applyInArrow(compare, "kind int, a long, b long"), f"links-{d}-{r}")
            found = part if found is None else found.unionByName(part)
    scratch.drop(f"tiles-{d}")
    return found


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding).

    A vector that is null, empty, zero or holds null or non-finite components links with
    nothing, and vectors of different lengths don't link. Repeated rows of a vec_id are
    vectors of their own, equal ones linked. A null vec_id is never a component's smallest;
    alone it is its own. An empty table gives an empty result; further columns are ignored."""
    scratch = Scratch(vectors.sparkSession)
    element = vectors.schema["embedding"].dataType.elementType
    kind, name = ("f4", "float") if isinstance(element, T.FloatType) else ("f8", "double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{name}>").alias("v"))
    sound = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    distinct = rows.where("sound and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    # rep numbers the distinct vectors; it is fixed by the table that is written
    distinct = scratch.keep(distinct.select(F.monotonically_increasing_id().alias("rep"), "vec_id", "copies", "v"), "distinct")
    found = None
    for r in distinct.groupBy(F.size("v").alias("d")).count().collect():
        part = _compared(scratch, distinct.where(F.size("v") == r["d"]).select("rep", "copies", "v"), r["d"], kind, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "kind int, a long, b long")
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    class_of = components(scratch, found.where("kind = 1").select("a", "b"))
    known = distinct.join(links, F.col("rep") == F.col("a"), "left").join(class_of, F.col("rep") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = known.groupBy("component").agg(F.min("vec_id").alias("smallest"))
    known = known.join(smallest, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "smallest", F.lit(True).alias("sound"))
    out = rows.join(known, ["v", "sound"], "left")
    mine = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), mine).alias("component_id"), F.coalesce(mine == F.col("vec_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id)::BIGINT AS n_links,
       least(e.vec_id, coalesce((SELECT min(other) FROM reach WHERE id = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id <= coalesce((SELECT min(other) FROM reach WHERE id = e.vec_id), e.vec_id) AS kept
FROM embeddings e
"""
