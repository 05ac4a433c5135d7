"""K-d tree partitioning into shards of near equal bytes, in DataFrame functions only.

Documents are points: log size, source and language (categories are placed by hash). A node
is split at the weighted median of its widest dimension, weights being bytes, until each
leaf has its share. Medians come from distributed histograms: 4096 bins between a node's
bounds, then 4096 within the bin that holds the median, until that bin weighs next to
nothing. Only one line a node is collected.

Equal texts are one unit, so copies stay together. A unit of more than `UNIT` of a shard's
bytes (there are at most shards / UNIT of these) is placed by itself, largest first, in the
shard with the most room left, and the medians then give each leaf the rest of its share. Only
where the copies of one text weigh more than a whole shard is each of their rows a unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.spark_util import Scratch, documents, parts_for

SHARDS, BINS, ROUNDS = 16, 4096, 5
TOLERANCE, UNIT = 0.0005, 0.005  # shares of a leaf's bytes: that a split may be off; that a unit may weigh and be placed by the medians
KEY = ("h", "size", "text_crc32")
SLOT_ROWS = 20_000
DIMENSIONS = ("size", "source", "lang", "spread")


def _points(docs: DataFrame, shards: int) -> tuple[DataFrame, list[float]]:
    """doc_id, size, text_crc32, own (the shard of a heavy unit) and the coordinates, each a whole number plus a fraction that the unit's hash gives; and the bytes of each shard that heavy units leave."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")))
    leaf = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    groups = rows.groupBy(*KEY).agg(F.sum("size").alias("weight"), *(f(c).alias(f"{k}_{c}") for c in ("source", "lang") for k, f in (("min", F.min), ("max", F.max))))
    # only units that are heavy or whose copies differ in their metadata need a join
    odd = groups.where((F.col("weight") > leaf * UNIT) | (F.col("min_source") < F.col("max_source")) | (F.col("min_lang") < F.col("max_lang"))).select(*KEY, "weight", "min_source", "min_lang")
    heavy = odd.where((F.col("weight") > leaf * UNIT) & (F.col("weight") <= leaf)).select(*KEY, "weight").collect()
    room, placed = [leaf] * shards, []
    for r in sorted(heavy, key=lambda r: (-r["weight"], r["h"])):
        k = room.index(max(room))
        room[k] -= r["weight"]
        placed.append((r["h"], r["size"], r["text_crc32"], k))
    rows = rows.join(odd, list(KEY), "left").join(F.broadcast(spark.createDataFrame(placed, "h long, size long, text_crc32 long, own int")), list(KEY), "left")
    unit = F.when(F.col("weight") > leaf, F.xxhash64("h", "doc_id")).otherwise(F.xxhash64("h"))
    rows = rows.withColumn("u", F.shiftrightunsigned(unit, 31) / F.lit(float(1 << 33)))
    place = lambda c: F.shiftrightunsigned(F.xxhash64(F.lit(c), F.coalesce(f"min_{c}", c)), 44)
    points = rows.select("doc_id", "size", "text_crc32", "own", (F.floor(F.log2("size") * 1024) + F.col("u")).alias("x_size"), (place("source") + F.col("u")).alias("x_source"), (place("lang") + F.col("u")).alias("x_lang"), F.col("u").alias("x_spread"))
    return points, [max(0.0, x) for x in room]


class _Node:
    def __init__(self, first: int, leaves: int):
        self.first, self.leaves, self.dimension, self.at = first, leaves, None, 0.0
        self.low = self.high = None


def _leaf(nodes: dict[int, _Node], node: int = 1) -> Column:
    """The number of the node (2n and 2n+1 are n's sides) that a point is in so far."""
    n = nodes.get(node)
    if n is None or n.dimension is None:
        return F.lit(node)
    return F.when(F.col(f"x_{n.dimension}") < n.at, _leaf(nodes, 2 * node)).otherwise(_leaf(nodes, 2 * node + 1))


def _split(points: DataFrame, nodes: dict[int, _Node], open_: dict[int, _Node], whole: dict[str, float], room: list[float]) -> None:
    """Gives each open node its dimension and place of the split."""
    at = points.withColumn("node", _leaf(nodes)).where(F.col("node").isin(list(open_)))
    bounds = {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("weight"), *(f(f"x_{d}").alias(f"{s}_{d}") for d in DIMENSIONS for s, f in (("min", F.min), ("max", F.max)))).collect()}
    state = {}
    for node, n in open_.items():
        if node not in bounds:  # no point: any split will do
            n.dimension, n.at = "spread", 0.5
            continue
        b = bounds[node]
        width = {d: (int(b[f"max_{d}"]) - int(b[f"min_{d}"])) / whole[d] if whole[d] else 0.0 for d in DIMENSIONS[:-1]}
        d = max(width, key=lambda k: (width[k], k))
        n.dimension = d if width[d] > 0 else "spread"
        low, high = b[f"min_{n.dimension}"], b[f"max_{n.dimension}"]
        state[node] = {"low": low, "high": high + max(1e-9, (high - low) * 1e-9), "below": 0.0, "goal": b["weight"] * sum(room[n.first : n.first + n.leaves // 2]) / max(1e-9, sum(room[n.first : n.first + n.leaves])), "near": b["weight"] / n.leaves * TOLERANCE}
    for _ in range(ROUNDS):
        going = {k: s for k, s in state.items() if "done" not in s}
        if not going:
            break
        x = low = high = F.lit(None).cast("double")
        for k, s in going.items():
            here = F.col("node") == k
            x, low, high = F.when(here, F.col(f"x_{open_[k].dimension}")).otherwise(x), F.when(here, F.lit(s["low"])).otherwise(low), F.when(here, F.lit(s["high"])).otherwise(high)
        cells = at.where(F.col("node").isin(list(going))).select("node", "size", x.alias("x"), low.alias("low"), high.alias("high")).where("x >= low and x < high")
        cells = cells.select("node", "size", F.least(F.lit(BINS - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).cast("int").alias("bin")).groupBy("node", "bin").agg(F.sum("size").alias("weight"))
        upto = F.sum("weight").over(Window.partitionBy("node").orderBy("bin"))
        goal = F.lit(0.0)
        for k, s in going.items():
            goal = F.when(F.col("node") == k, F.lit(float(s["goal"] - s["below"]))).otherwise(goal)
        crossing = cells.withColumn("upto", upto).where(F.col("upto") >= goal).groupBy("node").agg(F.min(F.struct("bin", "weight", "upto")).alias("c"))
        for r in crossing.collect():
            s, c = going[r["node"]], r["c"]
            step = (s["high"] - s["low"]) / BINS
            low = s["low"] + c["bin"] * step
            s["below"] += c["upto"] - c["weight"]
            s["low"], s["high"] = low, min(s["high"], low + step)
            if c["weight"] <= s["near"] or step < 1e-9:
                s["done"] = True
    for node, s in state.items():
        open_[node].at = s["low"]


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Null texts are empty (size 1), null source and lang are ''. Repeated rows and copies share
    a shard, unless a text's copies weigh more than a shard. slot counts
    from 0 in each shard: by hash bucket, then doc_id. An empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    points, room = _points(docs, shards)
    every = scratch.keep(points, "points")
    points = every.where("own is null")
    nodes: dict[int, _Node] = {1: _Node(0, shards)}
    ends = points.agg(F.count("*").alias("n"), *(f(f"x_{d}").alias(f"{s}_{d}") for d in DIMENSIONS for s, f in (("min", F.min), ("max", F.max)))).first()
    whole = {d: int(ends[f"max_{d}"]) - int(ends[f"min_{d}"]) if ends["n"] else 0 for d in DIMENSIONS}
    while open_ := {k: n for k, n in nodes.items() if n.leaves > 1 and n.dimension is None}:
        _split(points, nodes, open_, whole, room)
        for k, n in open_.items():
            nodes[2 * k] = _Node(n.first, n.leaves // 2)
            nodes[2 * k + 1] = _Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2)
    shard = F.lit(0)
    for k, n in nodes.items():
        if n.leaves == 1:
            shard = F.when(F.col("node") == k, F.lit(n.first)).otherwise(shard)
    buckets = parts_for(every.count(), SLOT_ROWS)
    rows = every.withColumn("node", _leaf(nodes)).select("doc_id", "size", "text_crc32", F.coalesce("own", shard.cast("int")).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"))
    before = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = before.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")))
    return rows.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
