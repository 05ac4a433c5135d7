"""A stored table of current rows, upserted by batches and streams.

Rows lie in buckets by a hash of their key. An upsert rewrites the buckets that its keys fall in
as new files and then publishes a version, which names the files of each bucket; nothing that a
version names is ever changed. A reader takes the newest version and so sees all of a batch or
nothing of it. A version remembers the last batch of each stream, and a batch that comes again
changes nothing."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "bucket int, path string, stream string, batch long"


class StoredTable:
    """Current rows by key in a folder that driver and executors share. One writer at a time.

    schema: DDL of the rows. order: a column of which the largest value wins where a batch holds
    a key twice; rows of equal order are compared by all their columns."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], order: str | None = None, buckets: int = 64):
        self.spark, self.folder, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), keys, order, buckets
        self.schema = T.StructType.fromDDL(schema)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions ----------------------------------------------------------------------

    def _newest(self) -> int:
        root = self._path(f"{self.folder}/versions")
        if not self._fs.exists(root):
            return 0
        names = (s.getPath().getName() for s in self._fs.listStatus(root))
        return max((int(n[2:]) for n in names if re.fullmatch(r"v-\d+", n)), default=0)

    def _state(self) -> tuple[int, dict[int, str], dict[str, int]]:
        """Number of the newest version, the files of each bucket, the last batch of each stream: at most as many rows as buckets and streams."""
        n = self._newest()
        rows = self.spark.read.schema(VERSION).parquet(f"{self.folder}/versions/v-{n}").collect() if n else []
        return n, {r["bucket"]: r["path"] for r in rows if r["bucket"] is not None}, {r["stream"]: r["batch"] for r in rows if r["stream"] is not None}

    def _publish(self, n: int, paths: dict[int, str], batches: dict[str, int]) -> None:
        rows = [(b, p, None, None) for b, p in paths.items()] + [(None, None, s, b) for s, b in batches.items()]
        made = f"{self.folder}/versions/.made-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, VERSION).coalesce(1).write.parquet(made)
        target = self._path(f"{self.folder}/versions/v-{n}")
        if self._fs.exists(target) or not self._fs.rename(self._path(made), target):
            raise RuntimeError(f"another writer has published version {n}")

    def _bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self, paths) -> DataFrame:
        paths = sorted(set(paths))
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # --- writing -----------------------------------------------------------------------

    def upsert(self, rows: DataFrame, batch_id: int | None = None, stream: str = "") -> bool:
        """Replaces or adds rows by key (S7, S8). With batch_id, a batch of the stream that has been taken already changes nothing; tells whether it was taken now."""
        n, paths, batches = self._state()
        if batch_id is not None and batches.get(stream, -1) >= batch_id:
            return False
        made = f"{self.folder}/data/{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        # what a batch holds is fixed by these files, whatever a retry reads
        rows.select(*columns).withColumn("_bucket", self._bucket()).write.partitionBy("_bucket").parquet(f"{made}/batch")
        batch = self.spark.read.schema(T.StructType([*self.schema, T.StructField("_bucket", T.IntegerType())])).parquet(f"{made}/batch")
        touched = [r["_bucket"] for r in batch.select("_bucket").distinct().collect()]
        if touched:
            last = [F.col(self.order).desc_nulls_last()] if self.order else []
            ties = [F.to_json(F.struct(*self.schema.names)).desc()]
            best = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*last, *ties))
            new = batch.withColumn("_best", best).where("_best = 1").drop("_best")
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
            old = self._files(paths[b] for b in touched if b in paths).alias("o").join(new.select(*self.keys).alias("n"), same, "left_anti")
            both = new.unionByName(old.withColumn("_bucket", self._bucket()))
            both.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{made}/rows")
            paths = paths | {b: f"{made}/rows/_bucket={b}" for b in touched}
        self._publish(n + 1, paths, batches | ({stream: batch_id} if batch_id is not None else {}))
        self._fs.delete(self._path(f"{made}/batch"), True)
        return True

    def update(self, keys: DataFrame, **values: Column) -> bool:
        """Sets columns of the rows of these keys (S11, S12); keys that aren't there change nothing. Values may use the row's columns."""
        there = self.read().join(keys.select(*self.keys).distinct(), self.keys, "left_semi")
        return self.upsert(there.withColumns(values))

    def sink(self, stream: DataFrame, name: str):
        """A writer of a stream of rows; batches that Spark sends again after a failure are taken once."""
        return stream.writeStream.foreachBatch(lambda rows, batch_id: self.upsert(rows, batch_id, name) and None)

    def vacuum(self) -> None:
        """Deletes files and versions that the newest version doesn't name. No reader of an older version may be at work."""
        n, paths, _ = self._state()
        used = {p.split("/data/")[1].split("/")[0] for p in paths.values()}
        for root, keep in ((f"{self.folder}/data", used), (f"{self.folder}/versions", {f"v-{n}"})):
            if self._fs.exists(self._path(root)):
                for s in self._fs.listStatus(self._path(root)):
                    if s.getPath().getName() not in keep:
                        self._fs.delete(s.getPath(), True)

    # --- reading -----------------------------------------------------------------------

    def read(self) -> DataFrame:
        """All current rows, as of now."""
        return self._files(self._state()[1].values())

    def get(self, *key) -> DataFrame:
        """The row of one key: only its bucket's files are read."""
        typed = [F.lit(x).cast(self.schema[k].dataType).alias(k) for k, x in zip(self.keys, key)]
        bucket = self.spark.range(1).select(*typed).select(self._bucket()).first()[0]
        paths = self._state()[1]
        return self._files([paths[bucket]] if bucket in paths else []).where(_every([F.col(k).eqNullSafe(t) for k, t in zip(self.keys, typed)]))


def _every(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
