"""Selection of items under a token budget: a fold over a sorted array, or a walk that streams.

The greedy walk skips what does not fit and goes on, so it is not a running sum; only the
strict window, which stops at the first misfit, is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.selection import greedy_walk


def greedy(items: Column, budget: Column, cost: str = "cost", key: str = "key") -> Column:
    """struct(used, kept keys, dropped keys) of items (array of structs, in order of choice) (K4)."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(0).cast("long").alias("used"), empty.alias("kept"), empty.alias("dropped"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x[cost] <= budget
        return F.struct(
            F.when(fits, s["used"] + x[cost]).otherwise(s["used"]).alias("used"),
            F.when(fits, F.concat(s["kept"], F.array(x[key].cast("string")))).otherwise(s["kept"]).alias("kept"),
            F.when(fits, s["dropped"]).otherwise(F.concat(s["dropped"], F.array(x[key].cast("string")))).alias("dropped"),
        )

    return F.aggregate(items, start, step)


def history_window(turns: DataFrame, budget: int, newest_first: bool, key: str = "session_id", order: str = "sequence", cost: str = "token_count") -> DataFrame:
    """Per session: which turns fit, walked oldest or newest first (K5, K6).

    included, used, original, reduction_pct, kept (turns in order of time). The walk streams over
    a session's turns; only those that are kept, which the budget bounds, are listed."""
    rows = turns.select(key, F.col(order).alias("at"), F.col(cost).cast("long").alias("cost"), F.lit(budget).cast("long").alias("room"))
    walked = greedy_walk(rows, key, [F.col("at").desc() if newest_first else F.col("at").asc()], "cost", "room")
    out = walked.groupBy(key).agg(F.count_if("kept").alias("included"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("cost"))), F.lit(0)).alias("used"), F.sum("cost").alias("original"), F.sort_array(F.collect_list(F.when(F.col("kept"), F.col("at")))).alias("kept"))
    saved = F.when(F.col("original") > 0, (F.col("original") - F.col("used")) * 100.0 / F.nullif(F.col("original"), F.lit(0))).otherwise(0.0)
    return out.select(key, "included", "used", "original", F.round(saved, 6).alias("reduction_pct"), F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


def strict_window(turns: DataFrame, budget: int, reserved: int = 0, framing: int = 8, key: str = "session_id", order: str = "sequence", cost: str = "token_count") -> DataFrame:
    """Turns of the newest-first window that ends at the first misfit; a turn costs its tokens and framing (K7)."""
    upto = F.sum(F.col(cost) + framing).over(Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("running", upto).where(F.col("running") <= max(0, budget - reserved)).select(key, order, F.col("running").cast("long").alias("running"))
