"""Near-duplicate documents by order MinHash, verified by banded alignment.

A text's k-mers are its runs of five words, each labelled with its occurrence number. In each
of 16 rounds the three labelled k-mers of the smallest round hash are taken and kept in text
order; their hash is the round's key. Texts with one key in common are candidates.

Two texts link if the alignment of their labelled k-mers (equal k-mers in the same order,
no further apart than the threshold allows) has similarity aligned / (n1 + n2 - aligned) of
0.8 or more: the Jaccard similarity of five-word shingles, but for moved passages.

Search: equal word sequences are one text. In each bucket all texts are compared with the
smallest. In buckets whose other texts are of several classes then, every pair of different
classes that shares a second key is compared, within tasks that hold two blocks of the bucket
and return only links that join classes. Nothing is capped.

What is sent: keys first. K-mers go only to comparisons that lengths, keys and classes leave
open, and by rounds of a share of all texts' k-mers, whose shuffles are freed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.spark_util import Scratch, arrow_batches, components, documents, freed_shuffles, parts_for
from quillon.llm.text import U64, Words, chunks, cut_words, forget, mix, string_buffers, window_hash

K, ROUNDS, PICKED, SIMILARITY = 5, 16, 3, 0.8
_SEEDS = mix(np.arange(1, 2 * ROUNDS + 1, dtype=U64) * U64(0x9FB21C651E98DF25)).reshape(2, ROUNDS)
BLOCK, BLOCK_WORDS = 2048, 1 << 20  # texts of a bucket, and their words, that a block holds on average; a task compares two
ROUND_BYTES, ROUND_WORD = 64 << 20, 2  # a round sends the first, or the second for each word of all texts if that is more
BATCH_BYTES, PAIR_BYTES = 2 << 20, 1 << 20  # what goes to a Python worker at once, and k-mers (of the pairs' first texts) that it aligns at once
_EXPECTED = 24  # k-mers of a text that a round's threshold lets through on average


def labelled(words: Words, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers of all texts and n+1 offsets; a text of under k words is one k-mer."""
    n = np.diff(words.first)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(n)), size)
    at = words.first[doc] + np.arange(len(doc)) - first[doc]
    mers = window_hash(words.hashes, at, np.minimum(k, n[doc]))
    own = mix(mers + doc.astype(U64) * U64(0xD6E8FEB86659FD93))
    order = np.sort(own)
    repeats = order[1:][order[1:] == order[:-1]]
    if len(repeats):
        some = np.flatnonzero(np.isin(own, repeats))
        some = some[np.argsort(own[some], kind="stable")]
        head = np.concatenate([[True], own[some][1:] != own[some][:-1]])
        start = np.flatnonzero(head)
        count = np.arange(len(some)) - start[np.cumsum(head) - 1]
        mers[some] = mix(mers[some] + count.astype(U64) * U64(0x8CB92BA72F3D8DD7))
    return mers, first


def sketches(mers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Round keys of each text, a row per text."""
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    with np.errstate(divide="ignore"):
        share = np.where(size > 2 * _EXPECTED, _EXPECTED / np.maximum(size, 1), 1.0)
    limit = np.where(share >= 1, 2.0**64 - 2048, share * 2.0**64).astype(U64)[doc]
    out = np.zeros((len(size), ROUNDS), U64)
    for r in range(ROUNDS):
        value = mers * (_SEEDS[0, r] | U64(1)) + _SEEDS[1, r]
        at = np.flatnonzero(value <= limit)
        short = np.bincount(doc[at], minlength=len(size)) < np.minimum(size, PICKED)
        if short.any():  # too few under the threshold: all k-mers of the text
            at = np.flatnonzero((value <= limit) | short[doc])
        at = at[np.lexsort((value[at], doc[at]))]
        d = doc[at]
        rank = np.arange(len(at)) - np.searchsorted(d, np.arange(len(size)))[d]
        at = np.sort(at[rank < PICKED])  # text order
        d = doc[at]
        place = np.arange(len(at)) - np.searchsorted(d, np.arange(len(size)))[d]
        for k in range(PICKED):
            here = place == k
            out[d[here], r] = mix(out[d[here], r] * U64(0x2545F4914F6CDD1D) + mers[at[here]] + U64(k + 1))
        out[:, r] = mix(out[:, r] + U64(r))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for d, e, raw, offsets in chunks(batch.column(1)):
            words = cut_words(raw, offsets)
            keys = sketches(*labelled(words)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, ROUNDS), pa.int32()), pa.array(keys.ravel()))
            a, b = words.first[:-1], words.first[1:]
            whole = words.hashes.tobytes()
            h = np.array([(x >> 64, x & (1 << 64) - 1) for x in (xxhash.xxh3_128_intdigest(whole[8 * x : 8 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True))], U64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(d, e - d), pa.array(b - a, pa.int64()), *(pa.array(x.astype(np.int64)) for x in h), lists], names=["doc_id", "n_words", "h1", "h2", "keys"])


def _increasing(values: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(values) < 2 or (np.diff(values) > 0).all():
        return len(values)
    tails: list[int] = []
    for v in values.tolist():
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
    return len(tails)


def similarities(mers_a: np.ndarray, first_a: np.ndarray, mers_b: np.ndarray, first_b: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Similarity of text d of a and text d of b, given as labelled k-mers; it may be given too low where it is under least."""
    size_a, size_b = np.diff(first_a), np.diff(first_b)
    pair_a, pair_b = (np.repeat(np.arange(len(s)), s) for s in (size_a, size_b))
    key_a, key_b = (mix(m + p.astype(U64) * U64(0xD6E8FEB86659FD93)) for m, p in ((mers_a, pair_a), (mers_b, pair_b)))
    _, at_a, at_b = np.intersect1d(key_a, key_b, return_indices=True)
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    pair = pair_a[at_a]
    i, j = at_a - first_a[pair], at_b - first_b[pair]
    band = (size_a + size_b) * (1 - least) / (1 + least) + 1
    near = np.abs(i - j) <= band[pair]
    pair, j = pair[near], j[near]
    count = np.bincount(pair, minlength=len(size_a)).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(count)])
    back = np.flatnonzero((pair[1:] == pair[:-1]) & (j[1:] <= j[:-1]))
    for p in np.unique(pair[back]).tolist():
        if count[p] >= least * (size_a[p] + size_b[p] - count[p]):
            count[p] = _increasing(j[cuts[p] : cuts[p + 1]])
    return count / np.maximum(size_a + size_b - count, 1)


def _kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for d, e, raw, offsets in chunks(batch.column(1)):
            mers, first = labelled(cut_words(raw, offsets))
            data = mers.tobytes()
            blobs = [data[8 * x : 8 * y] for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(d, e - d), pa.array(blobs, pa.binary())], names=["rep", "mers"])


def _read_mers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = string_buffers(column)
    return np.frombuffer(raw.tobytes(), U64), offsets // 8


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, e, _, _ in chunks(batch.column(2), PAIR_BYTES):
            one, other = (_read_mers(batch.column(k).slice(d, e - d)) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(d, e - d), batch.column(1).slice(d, e - d), pa.array(similarities(*one, *other))], names=["a", "b", "similarity"])


def _verified(mers: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with their similarity."""
    wide = pairs.join(mers.select(F.col("rep").alias("b"), F.col("mers").alias("mers_b")), "b").join(mers.select(F.col("rep").alias("a"), F.col("mers").alias("mers_a")), "a")
    return wide.select("a", "b", "mers_a", "mers_b").mapInArrow(_verify, "a long, b long, similarity double")


def _partners(table: pa.Table, small: np.ndarray, large: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, later texts to compare it with, how many keys it shares with each) of a bucket's two blocks (or of one).

    A pair is compared in the bucket of the least key that both have, if they share a second
    key, are of different classes and have lengths (small to large k-mers) that allow the threshold."""
    key, low, high = (table[c][0].as_py() for c in ("key", "low", "high"))
    own, group = table["block"].to_numpy(), table["class"].to_numpy()
    lists = table["keys"].combine_chunks()
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    kinds, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    here = np.searchsorted(kinds, key)
    order = np.argsort(code, kind="stable")
    texts = np.repeat(np.arange(table.num_rows), np.diff(first))[order]
    cuts = np.searchsorted(code[order], np.arange(len(kinds) + 1))
    for i in range(table.num_rows - 1):
        mine = code[first[i] : first[i + 1]]
        shared = np.bincount(np.concatenate([texts[cuts[c] : cuts[c + 1]] for c in mine]), minlength=table.num_rows)
        for c in mine[mine < here]:
            shared[texts[cuts[c] : cuts[c + 1]]] = 0
        shared, rest = shared[i + 1 :], slice(i + 1, None)
        todo = (shared > 1) & (group[rest] != group[i]) & (large[rest] >= least * small[i]) & (large[i] >= least * small[rest])
        if low != high:
            todo &= own[rest] != own[i]
        at = np.flatnonzero(todo)
        if len(at):
            yield i, at + i + 1, shared[at]


def _open(least: float):
    """The rows of two blocks' texts that are to be compared with any other there."""

    def run(table: pa.Table) -> pa.Table:
        some = np.zeros(table.num_rows, bool)
        for i, at, _ in _partners(table, table["small"].to_numpy(), table["large"].to_numpy(), least):
            some[i] = some[at] = True
        return table.filter(pa.array(some))

    return run


def _within(least: float):
    """Links that join classes among the texts of a bucket's two blocks (or of one); pairs that are joined by then are not compared."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        rep = table["rep"].to_numpy()
        _, parent = np.unique(table["class"].to_numpy(), return_inverse=True)
        mers, first = _read_mers(table["mers"])
        size = np.diff(first)
        sets = [mers[x:y] for x, y in zip(first[:-1], first[1:], strict=True)]
        up = list(range(int(parent.max()) + 1))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        found = []
        for i, later, shared in _partners(table, size, size, least):
            for j in later[np.argsort(-shared, kind="stable")].tolist():
                a, b = root(parent[i]), root(parent[j])
                if a != b and _similar(sets[i], sets[j], least):
                    up[max(a, b)] = min(a, b)
                    found.append((int(rep[i]), int(rep[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the alignment of two texts' labelled k-mers has the similarity."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < least * (len(a) + len(b) - len(i)):
        return False
    j = j[np.argsort(i)]
    n = _increasing(j)
    return n >= least * (len(a) + len(b) - n)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), copy_of (smallest doc_id with the same words), n_words, kept (doc_id = class_id).

    Texts without words (null, empty, white space) are in no class but their own. Texts of
    one to four words link with equal ones only. Rows of one doc_id are one document: it has
    the links of each of its texts, and a row each. A null doc_id is returned with a null
    class and kept. An empty table gives an empty result; further columns are ignored."""
    with freed_shuffles(docs.sparkSession), arrow_batches(docs.sparkSession, BATCH_BYTES):
        return _near_duplicates(docs, similarity)


def _rounds(scratch: Scratch, rows: DataFrame, weight: Column, by: list[str], room: int, run: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """run(rows), where rows of equal `by` go together, as a table written by rounds that send about room bytes, by the weight of a row."""
    n = parts_for(rows.agg(F.sum(weight)).first()[0] or 0, room)
    return reduce(DataFrame.unionByName, [scratch.keep(run(rows.where(F.pmod(F.xxhash64(*by), F.lit(n)) == k) if n > 1 else rows), f"{name}-{k}") for k in range(n)])


def _near_duplicates(docs: DataFrame, similarity: float) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(docs.mapInArrow(_sketch, "doc_id long, n_words long, h1 long, h2 long, keys array<long>"), "sketches")
    full = rows.where("doc_id is not null and n_words > 0")
    texts = scratch.keep(full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "keys")).alias("s")).select("h1", "h2", F.col("s.doc_id").alias("rep"), F.col("s.keys").alias("keys")), "texts")
    n_mers = F.greatest(F.col("n_words") - (K - 1), F.lit(1))
    sizes = full.groupBy("doc_id").agg(F.min(n_mers).alias("small"), F.max(n_mers).alias("large"))
    room = max(ROUND_BYTES, ROUND_WORD * (full.agg(F.sum("n_words")).first()[0] or 0))
    keyed = texts.select("rep", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("key", "a")
    # the texts that share a key with a smaller one, which is its bucket's smallest
    shared = scratch.keep(keyed.join(leaders, "key").where("a <> rep").select("key", "a", F.col("rep").alias("b")), "shared")
    pairs = shared.select("a", "b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("doc_id").alias(end), F.col("small").alias(f"small_{end}"), F.col("large").alias(f"large_{end}")), end)
    pairs = scratch.keep(pairs.where((F.col("large_a") >= similarity * F.col("small_b")) & (F.col("large_b") >= similarity * F.col("small_a"))).select("a", "b", F.col("large_b").alias("large")), "pairs")
    # the k-mers of the texts that share a key with another; all comparisons read these
    members = shared.select(F.col("a").alias("doc_id")).unionByName(shared.select(F.col("b").alias("doc_id"))).distinct()
    mers = scratch.keep(docs.join(members, "doc_id", "left_semi").mapInArrow(_kmers, "rep long, mers binary"), "mers")
    tested = _rounds(scratch, pairs, 8 * F.col("large"), ["b"], room, lambda part: _verified(mers, part.select("a", "b")), "tested")
    links = tested.where(F.col("similarity") >= similarity).select("a", "b")
    class_of = scratch.keep(components(scratch, links, "c1"), "classes-1")
    # buckets whose other texts are of several classes still: every pair of different classes is compared there, in blocks
    placed = shared.select("key", F.col("b").alias("rep")).distinct().join(class_of, F.col("rep") == F.col("id"), "left").select("key", "rep", F.coalesce("component", "rep").alias("class"))
    mixed = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    several = placed.join(mixed, "key", "left_semi").groupBy("rep", "class").agg(F.collect_set("key").alias("keys")).where(F.size("keys") > 1)
    several = scratch.keep(several.join(sizes.withColumnRenamed("doc_id", "rep"), "rep"), "several")
    if not several.isEmpty():
        inside = several.withColumn("key", F.explode("keys"))
        blocks = inside.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n"), F.sum("large").alias("words")).where("low < high")
        blocks = blocks.select("key", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int").alias("blocks"))
        inside = inside.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        inside = inside.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "class", "keys", "small", "large")
        here = ["key", "low", "high"]
        left = _rounds(scratch, inside, 64 + 8 * F.size("keys"), here, room, lambda part: part.groupBy(*here).applyInArrow(_open(similarity), inside.schema), "open")
        more = _rounds(scratch, left, 8 * F.col("large"), here, room, lambda part: part.drop("small", "large").join(mers, "rep").groupBy(*here).applyInArrow(_within(similarity), "a long, b long"), "more")
        class_of = scratch.keep(components(scratch, links.unionByName(more), "c2"), "classes-2")
    scratch.drop("pairs", "shared", "several", "mers")
    classes = texts.join(class_of, F.col("rep") == F.col("id"), "left").select("h1", "h2", "rep", F.coalesce("component", "rep").alias("class_id"))
    out = rows.alias("r").join(classes.alias("c"), (F.col("r.h1") == F.col("c.h1")) & (F.col("r.h2") == F.col("c.h2")) & (F.col("r.n_words") > 0), "left")
    mine = F.when(F.col("r.doc_id").isNotNull(), F.coalesce("c.class_id", "r.doc_id"))
    return out.select("r.doc_id", mine.alias("class_id"), F.when(F.col("r.doc_id").isNotNull(), F.coalesce("c.rep", "r.doc_id")).alias("copy_of"), "r.n_words", F.coalesce(mine == F.col("r.doc_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
