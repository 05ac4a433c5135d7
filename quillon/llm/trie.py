"""Conversation prefix trie by leaf-peeling message passing.

A node is a distinct sequence of first turns. Its fingerprint is a sum of 128-bit digests of
(place, role, text), so that fingerprints of all prefixes are running sums. Nodes whose smallest
conversation is the same lie in one line, one depth after the other: such a path is held as one
record with a counter of the paths that still hang from it. Each round peels the paths whose
counter is zero: they send the totals of their subtrees to the paths they hang from, whose
counters go down by as many, until only the root's path has finished. A long conversation thus
takes no more rounds than a short one; rounds number the nesting of paths.

Places in a conversation and running sums come from slices and blocks with the sums of those
before them, so that no task holds a whole conversation. Equality of nodes is that of
fingerprints, which is not proven.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.spark_util import Scratch

SHARED, HEAD = 20, 4  # conversations that share their first turns, and the modulus of how many they share
BLOCK_BITS = 12  # places of a block, as a power of two
WORDS = r"[^\x20\x09-\x0D]+"
LANES, LOW = 4, 0xFFFFFFFF  # of 32 bits, so that sums of 2^31 turns fit
NODE = ["depth", "k1", "k2"]


def running(rows: DataFrame, keys: list[str], at: Column, sums: list[str]) -> DataFrame:
    """rows with `sums` replaced by their running sums in the order of `at`, a whole number, among rows of the same keys.

    A window covers one block of places; what the blocks before it hold is joined to it."""
    cut = rows.withColumn("_at", at).withColumn("_block", F.shiftright("_at", BLOCK_BITS))
    inside = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*keys, "_block").agg(*(F.sum(c).alias(c) for c in sums))
    blocks = blocks.select(*keys, "_block", *(F.sum(c).over(before).alias(f"_{c}") for c in sums)).where(F.col(f"_{sums[0]}").isNotNull())
    cut = cut.withColumns({c: F.sum(c).over(inside) for c in sums}).join(blocks, [*keys, "_block"], "left")
    return cut.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}).select(*rows.columns)


def _places(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """(part, conv_id, pos, digest, words) of each turn; pos counts from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")).where("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), "digest"]
    dealt = scratch.keep(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    slices = dealt.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    here = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order))
    placed = dealt.withColumn("here", here).join(slices, ["part", "conv_id"]).select("part", "conv_id", (F.col("here") + F.col("before")).alias("pos"), "digest", "words")
    placed = scratch.keep(placed, "placed")
    scratch.drop("turns")
    return placed


def rebuilt(scratch: Scratch, conversations: DataFrame, shared: int = SHARED, head: int = HEAD) -> DataFrame:
    """(conv_id, depth, digest, words) of the rebuilt conversations, and a row of depth 0 for each of them."""
    placed = _places(scratch, conversations)
    slices = placed.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    first = placed.where(F.col("pos") < head).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    convs = slices.select("conv_id").distinct().withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % shared)
    convs = convs.join(first.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("first", F.filter("first", lambda x: x["pos"] <= F.col("h")))
    convs = convs.withColumn("m", F.coalesce(F.size("first"), F.lit(0))).withColumn("m", F.greatest("m", F.lit(0)))
    start = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("words"))
    lent = convs.select("conv_id", F.explode("first").alias("x")).select("conv_id", F.col("x.pos").cast("long").alias("depth"), "x.digest", "x.words")
    own = placed.join(slices.select("part", "conv_id").join(convs.select("conv_id", "h", "m"), "conv_id"), ["part", "conv_id"]).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).cast("long").alias("depth"), "digest", "words")
    return start.unionByName(lent).unionByName(own)


def _prefixes(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words): fingerprints of the prefix that ends with each turn and of the one before it."""
    wide = turns.withColumn("d", F.sha2(F.concat("depth", F.lit(":"), "digest"), 256))
    lanes = [f"lane{k}" for k in range(LANES)]
    wide = wide.withColumns({c: F.coalesce(F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("long"), F.lit(0)) for k, c in enumerate(lanes)})
    wide = wide.withColumns({f"own{k}": F.col(c) for k, c in enumerate(lanes)})
    wide = running(wide, ["conv_id"], F.col("depth"), lanes)
    joined = lambda a, b: F.shiftleft(a.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(b.bitwiseAND(F.lit(LOW)))
    full = [F.col(c) for c in lanes]
    less = [F.col(c) - F.col(f"own{k}") for k, c in enumerate(lanes)]
    return scratch.keep(wide.select("conv_id", "depth", joined(*full[:2]).alias("k1"), joined(*full[2:]).alias("k2"), joined(*less[:2]).alias("p1"), joined(*less[2:]).alias("p2"), "words"), "prefixes")


def _blocks_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            *node, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.zeros(len(ids), bool)
            new[0] = True
            for x in node:
                new[1:] |= x[1:] != x[:-1]
            at = np.flatnonzero(new)
            blobs = [zlib.compress(np.diff(ids[a:b], prepend=np.int64(0)).tobytes(), 1) for a, b in zip(at, [*at[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in node), pa.array(ids[at]), pa.array(blobs, pa.binary())], names=[*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest of each node's ids. Blocks of a node come one after the other, so that only a hash is held."""
    names, node, sha = [*NODE, "sha"], None, None
    for batch in batches:
        out = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"])):
            text = ",".join(map(str, np.cumsum(np.frombuffer(zlib.decompress(ids), np.int64)).tolist())).encode()
            if key == node:
                sha.update(b"," + text)
            else:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(text)
        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sha", pa.string())]))
    if node:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*node, sha.hexdigest())))])


def _ends(prefixes: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at each node, in ascending order."""
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("x")).select("x.*", "conv_id")
    blocks = last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_blocks_of_ids, "depth long, k1 long, k2 long, first long, ids binary")
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, sha string")


def _peel(scratch: Scratch, paths: DataFrame) -> DataFrame:
    """(parent_conv_id, depth, n_hung, leaves, saved): what has been sent to each node that paths hang from."""
    waits = paths.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("waits"))
    at_end = paths.select(F.col("parent_conv_id").alias("conv_id"), (F.col("top") - 1).alias("bottom")).distinct().withColumn("more", F.lit(1))
    state = paths.join(waits, "conv_id", "left").join(at_end, ["conv_id", "bottom"], "left")
    state = state.select("conv_id", "parent_conv_id", "top", F.coalesce("waits", F.lit(0)).alias("waits"), F.when(F.col("more").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved")
    state, sent, k = scratch.keep(state, "state-0"), None, 0
    while True:
        done = state.where("waits = 0")
        sent = done if sent is None else sent.unionByName(done)
        left = state.where("waits > 0")
        if not left.take(1):
            break
        told = done.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        more = lambda c, x: F.col(c) + F.coalesce(x, F.lit(0))
        k += 1
        state = scratch.keep(left.join(told, "conv_id", "left").select("conv_id", "parent_conv_id", "top", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), more("leaves", "l").alias("leaves"), more("saved", "s").alias("saved")), f"state-{k}")
    return sent.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.count("*").alias("n_hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(conversations: DataFrame, shared: int = SHARED, head: int = HEAD) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (conv_id, turn, role, text).

    A conversation c is rebuilt from the first h = crc32(c) % `head` turns of conversation
    c - c % `shared` and its own turns after its first h. Columns: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null role or text is empty, a null turn comes first, rows of equal turn are ordered by a
    digest of role and text, repeated rows are turns of their own. Rows without a conv_id are
    in no conversation. An empty table has no node. Further columns are ignored."""
    scratch = Scratch(conversations.sparkSession)
    prefixes = _prefixes(scratch, rebuilt(scratch, conversations, shared, head))
    scratch.drop("placed")
    nodes = prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = scratch.keep(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).drop("words"), "nodes")
    paths = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("x"), F.max("depth").alias("bottom"), F.sum("own").alias("saved"))
    paths = paths.select("conv_id", F.col("x.depth").alias("top"), "x.p1", "x.p2", "bottom", "saved")
    above = nodes.select((F.col("depth") + 1).alias("top"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    paths = scratch.keep(paths.join(above, ["top", "p1", "p2"], "left").drop("p1", "p2"), "paths")
    hung = _peel(scratch, paths)
    nodes = nodes.join(paths.select("conv_id", "top", "bottom", "parent_conv_id"), "conv_id").join(hung, ["conv_id", "depth"], "left").join(_ends(prefixes), NODE, "left")
    n_hung = F.coalesce("n_hung", F.lit(0))
    leaf = F.when((n_hung == 0) & (F.col("depth") == F.col("bottom")), 1).otherwise(0)
    nodes = nodes.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        (n_hung + (F.col("depth") < F.col("bottom")).cast("int")).cast("long").alias("n_children"),
        (F.coalesce("leaves", F.lit(0)) + leaf).cast("long").alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + F.col("own")).alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    return running(nodes, ["conv_id"], -F.col("depth"), ["n_leaves", "saved_tokens"])


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord((conv_id::VARCHAR)[i])::BIGINT)),
           lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM c)),
m AS (SELECT i.*, (SELECT count(*) FROM c WHERE c.conv_id = i.base AND c.pos <= i.h) AS m FROM ids i),
turns AS (
  SELECT m.conv_id, c.pos AS depth, c.role, c.text FROM m JOIN c ON c.conv_id = m.base AND c.pos <= m.h
  UNION ALL SELECT m.conv_id, m.m + c.pos - m.h, c.role, c.text FROM m JOIN c ON c.conv_id = m.conv_id AND c.pos > m.h),
seqs AS (
  SELECT i.conv_id, coalesce(s.turns, []) AS turns FROM ids i LEFT JOIN (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY depth) AS turns FROM turns GROUP BY conv_id) s USING (conv_id)),
members AS (SELECT conv_id, len(turns) AS n, d AS depth, turns[1:d] AS prefix FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256,
         (count(*) - 1) * len(regexp_extract_all(coalesce(prefix[depth].text, ''), '[^\x20\x09-\x0D]+')) AS own
  FROM members GROUP BY prefix, depth),
kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
flat AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (prefix)),
under AS (
  SELECT prefix[1:a] AS top, a AS depth, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, own
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM flat)),
sums AS (SELECT top, depth, sum(leaf) AS n_leaves, sum(own) AS saved FROM under GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM flat f JOIN sums s ON s.top = f.prefix AND s.depth = f.depth
LEFT JOIN nodes p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.prefix = f.prefix[1:f.depth - 1]
"""
