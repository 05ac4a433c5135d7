"""Exact order statistics of many groups at once by radix selection, and greedy choice in order as a stream.

No task holds a group's values: a round counts the leading bits of all values (counts are
summed before they are shuffled), finds for each wanted rank the cell that it falls in, and the
next round looks at the values of these cells only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.folders import Scratch

BITS = 16  # leading bits that a round adds: a group has at most 65,536 cells
FEW = 1 << 20  # values in the cells that are left, in all groups together, from which all their bits are taken at once


@F.pandas_udf(T.LongType())
def sort_key(x: pd.Series) -> pd.Series:
    """A whole number for each double, in the same order; -0 is 0, NaN comes last."""
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(np.isnan(x), np.iinfo(np.int64).max, bits ^ ((bits >> 63) & np.iinfo(np.int64).max)))


@F.pandas_udf(T.DoubleType())
def of_sort_key(key: pd.Series) -> pd.Series:
    bits = key.to_numpy(np.int64)
    return pd.Series((bits ^ ((bits >> 63) & np.iinfo(np.int64).max)).view(np.float64))


def order_statistics(rows: DataFrame, value: Column, wanted: DataFrame, by: list[str]) -> DataFrame:
    """wanted (by, rank) with the value of that rank, from 0, among the group's values that aren't null. Ranks beyond the group's size are left out."""
    scratch = Scratch(rows.sparkSession)
    keys = scratch.keep(rows.select(*by, value.cast("double").alias("v")).where("v is not null").select(*by, sort_key("v").alias("key")), "keys")
    same = lambda a, b, columns: _all([F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])
    targets, taken = wanted.select(*by, F.col("rank").cast("long").alias("rank"), F.lit(None).cast("long").alias("cell"), F.lit(0).cast("long").alias("before")).distinct(), 0
    while taken < 64:
        more = BITS
        if taken:
            left = targets.select(*by, "cell", "size").distinct().agg(F.sum("size")).first()[0] or 0
            more = 64 - taken if left <= FEW else BITS
        inside, taken = keys.withColumn("parent", F.shiftright("key", 64 - taken) if taken else F.lit(None).cast("long")), taken + more
        if taken > more:
            inside = inside.alias("k").join(targets.select(*by, F.col("cell").alias("parent")).distinct().alias("t"), same("k", "t", [*by, "parent"]), "left_semi")
        cells = inside.withColumn("cell", F.shiftright("key", 64 - taken)).groupBy(*by, "parent", "cell").agg(F.count("*").alias("size"))
        cells = cells.withColumn("under", F.sum("size").over(Window.partitionBy(*by, "parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["under"])
        found = targets.drop("size").withColumnRenamed("cell", "parent").alias("t").join(cells.alias("c"), same("t", "c", [*by, "parent"]))
        at = F.col("t.rank") - F.col("t.before") - F.col("c.under")
        targets = scratch.keep(found.where((at >= 0) & (at < F.col("c.size"))).select(*(f"t.{c}" for c in by), "t.rank", "c.cell", (F.col("t.before") + F.col("c.under")).alias("before"), "c.size"), f"cells-{taken}")
    return targets.select(*by, "rank", of_sort_key("cell").alias("value"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def exact_percentiles(rows: DataFrame, value: Column, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by, n and a column for each share: linear interpolation at (values - 1) * share; null for a group without values. n counts all rows."""
    size = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(value.cast("double")).alias("m"))
    size = Scratch(rows.sparkSession).keep(size, "size")
    at = lambda p: (F.col("m") - 1) * F.lit(p)
    ends = F.array(*(f(at(p)).cast("long") for p in shares.values() for f in (F.floor, F.ceil)))
    found = order_statistics(rows, value, size.where("m > 0").select(*by, F.explode(F.array_distinct(ends)).alias("rank")), by)
    held = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of")).alias("f")
    out = size.alias("s").join(held, _all([F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]), "left")
    value_at = lambda p, f: F.col("of")[f(at(p)).cast("long")]
    between = lambda p: value_at(p, F.floor) + (value_at(p, F.ceil) - value_at(p, F.floor)) * (at(p) - F.floor(at(p)))
    return out.select(*(f"s.{c}" for c in by), "n", *(F.when(F.col("m") > 0, between(p)).alias(name) for name, p in shares.items()))


def greedy_walk(rows: DataFrame, key: str, order: list[Column], cost: str, room: str, bucket: str | None = None) -> DataFrame:
    """rows with `kept`: in the given order a row is kept if its cost fits into what the kept ones before it leave of `room`, and is passed over otherwise (K4).

    With `bucket`, a bucket that is met with no room left is passed over whole, rows without
    cost too, and `met` tells the others. Rows of a key are sorted outside of memory and then
    seen one batch after the other; only sums are carried. room is the same in all rows of a key."""
    schema = rows.schema
    helpers = {"_cost": F.col(cost).cast("long"), "_room": F.col(room).cast("long"), "_bucket": F.col(bucket).cast("long") if bucket else F.lit(0).cast("long")}
    dealt = rows.withColumns(helpers).repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, at, open_ = (), 0, None, False
        for batch in batches:
            kept, met = np.zeros(len(batch), bool), np.zeros(len(batch), bool)
            for k, (who, c, r, b) in enumerate(zip(*(batch.column(x).to_pylist() for x in (key, "_cost", "_room", "_bucket")))):
                if (who,) != now:
                    now, used, at = (who,), 0, None
                if b != at:
                    at, open_ = b, used < r or not bucket
                met[k] = open_
                if open_ and used + c <= r:
                    kept[k] = True
                    used += c
            columns = [batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept), pa.array(met)], names=[*schema.names, "kept", "met"])

    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema) + "kept boolean, met boolean"
    return dealt.mapInArrow(run, out)
