"""A stored, inverted vector index: coarse cells, exact re-ranking, inserts, deletes and rebuilds.

Unit vectors lie in the cell of their nearest centre. Centres are fitted on a bounded sample;
every vector is indexed. Files are sorted by cell, so that a search reads the row groups of the
cells that it probes. A vector's angle to its centre bounds what it can score: with the angle a
between a query and a centre and the largest angle r of a cell, no vector of the cell is nearer
than a - r. A search probes each query's nearest cells; an exact one then probes those cells
whose bound still beats the query's k-th hit, and no others.

Inserts and deletes add segments, of which the newest of an id holds. A reader sees the version
that is named last, whose files are all there. When dead rows times 5 exceed the live ones, the
index is built anew."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.asof import PLACES, TOP_K

SAMPLE, SAMPLE_BYTES = 50_000, 64 << 20  # most vectors that centres are fitted on, and most bytes of them
CELLS, CENTRE_BYTES = 4096, 32 << 20  # most cells, most bytes of centres
PROBES, ROUNDS = 8, 12  # cells that a search looks into, rounds of fitting
ROWS, ASKED = 8192, 1024  # rows and queries of a block
DEAD = 5  # the index is rebuilt when dead rows times this exceed the live ones

ROW = "session_id string, node_id string, version long, cell int, angle double, vector array<float>"
HITS = "query_id string, session_id string, node_id string, hit double"


def _unit(column) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centres of unit vectors by spherical k-means."""
    r = np.random.default_rng(seed)
    centres = sample[r.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0), centres)
    return centres


def _assign(centres: np.ndarray, version: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = _unit(batch.column("vector")) @ centres.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("session_id"), batch.column("node_id"), pa.array(np.full(len(cell), version)), pa.array(cell.astype(np.int32)), pa.array(angle), batch.column("vector").cast(pa.list_(pa.float32()))],
                    names=[c.split()[0] for c in ROW.split(", ")],
                )

    return run


def _probe(centres: np.ndarray, width: np.ndarray, probes: int):
    """Rows (query, cell) of each query's nearest cells, or with a floor of all cells that may hold a nearer vector and have not been probed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = _unit(batch.column("vector")) @ centres.T
            order = np.argsort(-near, axis=1, kind="stable")
            first = np.zeros(near.shape, bool)
            np.put_along_axis(first, order[:, :probes], True, axis=1)
            if "floor" in batch.schema.names:
                floor = np.asarray(batch.column("floor"), np.float64)[:, None]
                least = np.maximum(0.0, np.arccos(np.clip(near, -1.0, 1.0)) - width[None, :] - 1e-7)
                first = ~first & (width[None, :] >= 0) & (np.cos(least) >= floor)
            i, cell = np.nonzero(first)
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("query_id", "session_id", "vector")] + [pa.array(cell.astype(np.int32))], names=["query_id", "session_id", "vector", "cell"])

    return run


def _rank(k: int):
    """The k nearest rows of each query within a block of queries and a block of rows; equal hits by node_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                names, asked, nodes, held = (batch.column(c)[row].values for c in ("queries", "asked", "nodes", "held"))
                hits = np.clip(np.round(_unit(asked) @ _unit(held).T, PLACES), 0.0, 1.0)
                place = np.asarray(pc.rank(nodes, sort_keys="ascending", tiebreaker="dense"))
                order = np.lexsort((np.broadcast_to(place, hits.shape), -hits), axis=1)[:, :k]
                i = np.repeat(np.arange(len(hits)), order.shape[1])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array([batch.column("session_id")[row].as_py()] * len(i), pa.string()), nodes.take(pa.array(order.ravel())), pa.array(np.take_along_axis(hits, order, axis=1).ravel())], names=["query_id", "session_id", "node_id", "hit"])

    return run


class VectorIndex:
    """An index in a folder that driver and executors share. One writer at a time; readers see whole versions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions ----------------------------------------------------------------------

    def _state(self) -> dict | None:
        """Numbers of the newest version, or None: version, build, dim, cells, rows, dead."""
        if not self._fs.exists(self._path(f"{self.folder}/versions")):
            return None
        rows = self.spark.read.schema("version long, build long, dim int, rows long, dead long").parquet(f"{self.folder}/versions")
        found = rows.orderBy(F.desc("version")).first()
        return found.asDict() if found else None

    def _publish(self, **numbers) -> None:
        row = [tuple(numbers[n] for n in ("version", "build", "dim", "rows", "dead"))]
        self.spark.createDataFrame(row, "version long, build long, dim int, rows long, dead long").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")

    def _at(self, state: dict, what: str) -> str:
        return f"{self.folder}/build-{state['build']}/{what}"

    def _centres(self, state: dict) -> np.ndarray:
        rows = self.spark.read.parquet(self._at(state, "centres")).collect()
        return np.array([r["centre"] for r in sorted(rows, key=lambda r: r["cell"])], np.float64)

    def _read(self, state: dict, what: str, schema: str) -> DataFrame:
        if not self._fs.exists(self._path(self._at(state, what))):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at(state, what)).where(F.col("version") <= state["version"])

    # --- writing -----------------------------------------------------------------------

    @staticmethod
    def accepted(vectors: DataFrame, dim: int | None = None) -> DataFrame:
        """Rows with an id and a vector without null or NaN that has a length other than 0, and `dim` components (V4)."""
        ok = "coalesce(node_id, '') <> '' and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x)) and aggregate(embedding, 0D, (s, x) -> s + abs(x)) > 0"
        columns = [F.coalesce(F.col("session_id"), F.lit("")).alias("session_id") if "session_id" in vectors.columns else F.lit("").alias("session_id"), F.col("node_id").cast("string").alias("node_id"), F.col("embedding").cast("array<float>").alias("vector")]
        rows = vectors.where(ok).select(*columns)
        return rows.where(F.size("vector") == dim) if dim else rows

    def build(self, vectors: DataFrame, dim: int | None = None) -> "VectorIndex":
        """Replaces all by these vectors (session_id?, node_id, embedding); rows that aren't accepted are left out (V6). Of rows of one id, one is kept."""
        state = self._state()
        version = (state["version"] if state else 0) + 1
        if dim is None:
            dims = self.accepted(vectors).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
            dim = dims["d"] if dims else 1
        rows = self.accepted(vectors, dim).groupBy("session_id", "node_id").agg(F.min("vector").alias("vector"))
        new = {"version": version, "build": version, "dim": dim}
        rows.write.parquet(self._at(new, "given"))  # what is indexed is fixed, whatever a retry reads
        rows = self.spark.read.schema("session_id string, node_id string, vector array<float>").parquet(self._at(new, "given"))
        n = rows.count()
        cells = max(1, min(CELLS, CENTRE_BYTES // (8 * dim), math.isqrt(n)))
        sample = rows.select(F.xxhash64("session_id", "node_id").alias("h"), "vector").orderBy("h").limit(min(SAMPLE, SAMPLE_BYTES // (4 * dim))).toArrow() if n else None
        centres = fit(_unit(sample["vector"].combine_chunks()), cells) if n else np.zeros((1, dim))
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(self._at(new, "centres"))
        self._add(rows, centres, new)
        self._publish(**new, rows=n, dead=0)
        self._fs.delete(self._path(self._at(new, "given")), True)
        return self

    def _add(self, rows: DataFrame, centres: np.ndarray, state: dict) -> None:
        placed = rows.mapInArrow(_assign(centres, state["version"]), ROW)
        placed.repartitionByRange("cell", "session_id", F.xxhash64("node_id")).sortWithinPartitions("cell", "session_id").write.mode("append").parquet(self._at(state, "rows"))

    def _changed(self, state: dict) -> DataFrame:
        """(session_id, node_id, newest): ids changed after the build; at most a share of the index, by the rule of rebuilds, and joined by id."""
        added = self._read(state, "rows", ROW).where(F.col("version") > state["build"]).select("session_id", "node_id", "version")
        gone = self._read(state, "gone", "session_id string, node_id string, version long")
        return added.unionByName(gone).groupBy("session_id", "node_id").agg(F.max("version").alias("newest"))

    def live(self) -> DataFrame:
        """The rows that hold: the newest of each id, unless it is deleted."""
        state = self._state()
        if state is None:
            return self.spark.createDataFrame([], ROW)
        return self._live(state)

    def _live(self, state: dict) -> DataFrame:
        rows = self._read(state, "rows", ROW)
        return rows.join(self._changed(state), ["session_id", "node_id"], "left").where("newest is null or newest = version").drop("newest")

    def _settle(self, state: dict) -> None:
        """Publishes a version; builds anew when too many rows are dead."""
        all_rows = self._read(state, "rows", ROW).count()
        live = self._live(state).count()
        if (all_rows - live) * DEAD > live:
            old = self._live(state).select("session_id", "node_id", F.col("vector").alias("embedding"))
            self._publish(**state | {"rows": live, "dead": all_rows - live})
            self.build(old, state["dim"])
        else:
            self._publish(**state | {"rows": live, "dead": all_rows - live})

    def insert(self, vectors: DataFrame) -> "VectorIndex":
        """Adds vectors or replaces those of the same id, deleted ones among them (V4). Another number of components is not accepted."""
        state = self._state()
        if state is None:
            return self.build(vectors)
        state = {k: state[k] for k in ("version", "build", "dim")} | {"version": state["version"] + 1}
        rows = self.accepted(vectors, state["dim"]).groupBy("session_id", "node_id").agg(F.min("vector").alias("vector"))
        self._add(rows, self._centres(state), state)
        self._settle(state)
        return self

    def delete(self, ids: DataFrame) -> "VectorIndex":
        """Takes (session_id?, node_id) out (V5); ids that aren't there change nothing."""
        state = self._state()
        if state is None:
            return self
        state = {k: state[k] for k in ("version", "build", "dim")} | {"version": state["version"] + 1}
        session = F.coalesce("session_id", F.lit("")) if "session_id" in ids.columns else F.lit("")
        rows = ids.select(session.alias("session_id"), F.col("node_id").cast("string").alias("node_id"), F.lit(state["version"]).cast("long").alias("version")).distinct()
        rows.write.mode("append").parquet(self._at(state, "gone"))
        self._settle(state)
        return self

    def __len__(self) -> int:
        state = self._state()
        return state["rows"] if state else 0

    # --- search ------------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int = TOP_K, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """(query_id, session_id, node_id, hit, rank): the k nearest live vectors of the query's session (session_id?, query_id, vector).

        hit is the cosine, to PLACES places, held between 0 and 1. With `exact`, cells are added
        until no other can hold a nearer vector; else hits are those of `probes` cells. A query
        of another number of components raises an error, as does an empty one; an empty index
        has no hits. k below 1 means 10."""
        k = k if k > 0 else 10
        state = self._state()
        none = self.spark.createDataFrame([], f"{HITS}, rank int")
        session = F.coalesce("session_id", F.lit("")) if "session_id" in queries.columns else F.lit("")
        queries = queries.select(F.col("query_id").cast("string").alias("query_id"), session.alias("session_id"), F.col("vector").cast("array<double>").alias("vector"))
        if state is None or not state["rows"]:
            return none
        wrong = F.raise_error(F.concat(F.lit(f"a query has {state['dim']} components here, not "), F.coalesce(F.size("vector"), F.lit(-1)).cast("string")))
        queries = queries.withColumn("vector", F.when(F.size("vector") == state["dim"], F.col("vector")).otherwise(wrong.cast("array<double>")))
        centres, live = self._centres(state), self._live(state).select("session_id", "node_id", "cell", "angle", "vector")
        width = np.full(len(centres), -1.0)  # the largest angle of each cell, -1 for an empty one: one number a cell
        for r in live.groupBy("cell").agg(F.max("angle").alias("angle")).collect():
            width[r["cell"]] = r["angle"]
        schema = "query_id string, session_id string, vector array<double>, cell int"
        pairs = queries.mapInArrow(_probe(centres, width, probes), schema)
        found = self._ranked(pairs, live, k)
        if exact:
            worst = found.groupBy("query_id", "session_id").agg(F.when(F.count("*") >= k, F.min("hit")).alias("floor"))
            asked = queries.join(worst, ["query_id", "session_id"], "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - 1e-9)
            more = asked.select("query_id", "session_id", "vector", F.when(F.col("floor") <= 0, -2.0).otherwise(F.col("floor")).alias("floor")).mapInArrow(_probe(centres, width, probes), schema)
            found = self._ranked(more, live, k, found)
        return found

    def _ranked(self, pairs: DataFrame, live: DataFrame, k: int, known: DataFrame | None = None) -> DataFrame:
        listed = lambda *c: F.collect_list(F.struct(*c))
        place = lambda by, size: F.floor((F.row_number().over(Window.partitionBy("session_id", "cell").orderBy(by)) - 1) / size)
        asked = pairs.withColumn("block", place("query_id", ASKED)).groupBy("session_id", "cell", "block").agg(listed("query_id", "vector").alias("q")).drop("block")
        asked = asked.select("session_id", "cell", F.col("q.query_id").alias("queries"), F.col("q.vector").alias("asked"))
        held = live.withColumn("block", place("node_id", ROWS)).groupBy("session_id", "cell", "block").agg(listed("node_id", "vector").alias("n")).drop("block")
        held = held.select("session_id", "cell", F.col("n.node_id").alias("nodes"), F.col("n.vector").alias("held"))
        found = asked.join(held, ["session_id", "cell"]).mapInArrow(_rank(k), HITS)
        if known is not None:
            found = found.unionByName(known.drop("rank"))
        best = Window.partitionBy("query_id", "session_id").orderBy(F.desc("hit"), "node_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

