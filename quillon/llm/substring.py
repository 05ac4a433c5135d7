"""Substring dedup by recompression.

A window is `width` consecutive words of one document. A word goes if a window that covers
it also starts in a document with a smaller id. Work is dealt in groups of documents:

1. Rounds (`recompress`): each group sends what it wants named to name buckets, each thing
   once: in round 0 its words and runs of a word, in a later round its pairs of names. A bucket
   compares them by their bytes, or by their two names, and numbers those that stand in two
   documents or more. Names are thus the same in all groups, and two names are equal only where
   the words are; what one document alone has gets no name and is not followed any further.
2. Each group looks for the windows whose words and certain symbols, of all rounds, have names.
   It sends their 32-bit prints, each once, and is told which of them another group has too: in
   large tables most windows have names, as short sequences of words repeat by chance, but few
   stand in two groups. Those are sent once, by their words' names and with their smallest
   document id, to window buckets. Windows that follow each other mostly share the five-word
   sequence of least hash, which decides on the bucket, and go there as one run. Buckets compare
   windows word by word, which is exact, and tell each group for which of its windows another
   group has a smaller document.
3. Each group removes the covered words.

A group contributes a name or window at most once, so a passage in a third of all documents is
no heavier for a bucket than one in a document of each group. What a round leaves is a table in
the shared folder; a repeated task gives equal names, as buckets number in sorted order.
"""

from __future__ import annotations

import hashlib
import struct
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.recompress import ROUNDS, living, pairs, rights, runs
from quillon.llm.spark_util import Scratch, freed_shuffles, parts_for
from quillon.llm.text import U64, distinct_spans, forget, mix, ragged, span_hash, string_buffers, window_hash, word_spans

WIDTH = 13
GRAM = 5  # words of the sequence that decides on a window's bucket
GROUP_BYTES = 5 << 20
BUCKET_BYTES = 8 << 20  # of text for each bucket
GROUP_GROWTH, BUCKET_GROWTH = 2, 4  # how many times as large they may be in large tables
_MESSAGE = "gid int, bucket int, kind int, blob binary"
_ARROW = pa.schema([("gid", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
STATE, ASK, REPLY = range(3)  # names of round k are of kind REPLY + k
PRINTS = REPLY + ROUNDS + 1  # a group's windows, and which of their prints other groups have
BITS = PRINTS + 1  # what a round keeps of the names before it: which stay or begin a pair, which are dead and which right
_PAIR_A, _PAIR_B = U64(0xD1342543DE82EF95), U64(0xAF251AF3B0F025B5)


_COMPRESS, _DECOMPRESS = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
_SHORT = 64  # arrays up to this length are sent as they are: with many buckets, most messages are small


def _compressed(raw: bytes) -> bytes:
    return _COMPRESS(raw)


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one blob: each as narrow as it can be, bytes of equal weight together; short ones (size 0) in 64 bits."""
    head, body = [len(arrays)], []
    for a in arrays:
        if len(a) <= _SHORT:
            head += (len(a), 0)
            body.append(a.astype("<i8").tobytes())
            continue
        least, most = int(a.min()), int(a.max())
        size = next(n for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= least and most < 1 << 8 * n - 1)
        raw = np.ascontiguousarray(a, f"<i{size}").view(np.uint8)
        head += (len(a), size)
        body += [raw[k::size].tobytes() for k in range(size)]
    return _compressed(b"".join([struct.pack(f"<{len(head)}q", *head), *body]))


def unpack(blob: bytes, wide: bool = True) -> list[np.ndarray]:
    """What was packed, in 64 bits or, if not wide, as narrow as it was sent."""
    raw = _DECOMPRESS(blob)
    (n,) = struct.unpack_from("<q", raw)
    head = struct.unpack_from(f"<{2 * n}q", raw, 8)
    at, out = 8 * (1 + 2 * n), []
    for length, size in zip(head[::2], head[1::2], strict=True):
        if not size:
            out.append(np.frombuffer(raw, "<i8", length, at).copy())
            at += 8 * length
            continue
        planes, a = np.frombuffer(raw, np.uint8, length * size, at).reshape(size, length), np.empty(length * size, np.uint8)
        for k in range(size):
            a[k::size] = planes[k]
        out.append(a.view(f"<i{size}").astype(np.int64) if wide else a.view(f"<i{size}"))
        at += length * size
    return out


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    """(gid, bucket, kind, blob) rows."""
    return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []], schema=_ARROW)


def _blobs(table: pa.Table, kind: int) -> list[bytes]:
    """Blobs of a kind, by bucket."""
    rows = [r for r in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True) if r[1] == kind]
    return [r[2] for r in sorted(rows, key=lambda r: r[0])]


def _answer(ranks: np.ndarray) -> bytes:
    """A bucket's answer: ranks of what it named, which ascend in the order asked; -1 for the rest."""
    named = ranks >= 0
    return pack(named, np.diff(ranks[named], prepend=0))


def _replies(table: pa.Table, level: int = 0, buckets: int = 1) -> np.ndarray:
    """Names in the order in which they were asked for: different ones for different ranks, buckets and rounds; 0 for what has none."""
    out = [np.zeros(0, np.int64)]
    for bucket, named, steps in sorted(((b, *unpack(x)) for b, k, x in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True) if k == REPLY + level), key=lambda x: x[0]):
        names = np.zeros(len(named), np.int64)
        names[named > 0] = (np.cumsum(steps) * buckets + bucket) * (ROUNDS + 1) + level + 1
        out.append(names)
    return np.concatenate(out)


def _starts(widths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)


class _Group:
    """The texts of a group, by (doc_id, text), and their words: raw[starts[k]:ends[k]], those of text d from first[d] on; solid: whether a byte is of a word."""

    def __init__(self, table: pa.Table):
        docs, text = table["doc_id"], table["text"].combine_chunks()
        self.null_id = np.asarray(docs.is_null())
        ids = docs.fill_null(0).to_numpy()
        raw, offsets = string_buffers(text)
        order = np.lexsort(([raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
        self.order, self.ids = order, ids[order]
        # texts are handled in their own order
        text = text.take(pa.array(order))
        self.raw, self.offsets = string_buffers(text)
        self.starts, self.ends, self.solid = word_spans(self.raw, self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)


def _many(index: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n things, seen as index[k] in document doc[k], stands in two documents; doc ascends."""
    least, most = np.zeros(n, doc.dtype), np.zeros(n, doc.dtype)
    least[index[::-1]] = doc[::-1]  # the last one written stays
    most[index] = doc
    return least < most


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by bucket, place of each in that order, cuts between buckets)."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place, _starts(np.bincount(bucket, minlength=buckets))


def _sorted_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a new pair begins there) of pairs of names, which are not negative."""
    most = int(b.max(initial=0)) + 1
    if int(a.max(initial=0)) < (1 << 63) // most - 1:
        key = a * most + b
        order = np.argsort(key)
        a = b = key[order]
    else:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _lines(keys: pa.Array, many: np.ndarray, order: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The keys in order, each after 1 if two documents have it or else 0, as lines; those of each bucket, from cuts[b] on, together."""
    flags = pa.array([b"0", b"1"], pa.binary()).take(pa.array(many[order].astype(np.int8)))
    lines = pc.binary_join_element_wise(flags, keys.take(pa.array(order)), pa.scalar(b"", pa.binary()))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), lines), pa.scalar(b"\n", pa.binary())).to_pylist()


def _read_lines(blobs: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(keys, whether two documents have them, number of keys by blob) of what `_lines` wrote."""
    texts = [_DECOMPRESS(b) for b in blobs]
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero(raw == 0x0A)  # no word has one
    starts = np.append(0, ends + 1)[:-1]
    solid = raw != 0x0A
    solid[starts] = False
    keys = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(_starts(ends - starts - 1).astype(np.int32)), pa.py_buffer(raw[solid])])
    return keys, raw[starts] == 0x31, np.diff(np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts])), prepend=0)


def _step_runs(buckets: int):
    """Round 0: asks for names of words and runs, and keeps the runs."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        gid, group = table["gid"][0].as_py(), _Group(table)
        vocabulary, word = distinct_spans(group.raw[group.solid], _starts(group.ends - group.starts))
        starts = runs(word, group.first[:-1])
        kind, count = word[starts[:-1]].astype(np.int64), np.diff(starts)
        doc = np.repeat(np.arange(len(group.ids)), np.diff(group.first))[starts[:-1]]
        long = np.flatnonzero(count > 1)
        longer, back = np.unique(np.stack([kind[long], count[long]], axis=1), axis=0, return_inverse=True) if len(long) else (np.zeros((0, 2), np.int64), long)
        more = [vocabulary[k].as_py() + b" %d" % c for k, c in longer.tolist()]  # a word has no space
        keys = pa.concat_arrays([vocabulary, pa.array(more, pa.binary())])
        symbol = kind.copy()
        symbol[long] = len(vocabulary) + back.ravel()
        many = np.concatenate([_many(kind, doc, len(vocabulary)), _many(back.ravel(), doc[long], len(more))])
        head, own = span_hash(keys)
        by_head = np.argsort(head, kind="stable")
        order, rank, cuts = _by_bucket((own % U64(buckets)).astype(np.int64)[by_head], buckets)
        place = np.empty(len(keys), np.int64)
        place[by_head] = rank
        out = [(gid, b, ASK, _compressed(lines)) for b, lines in enumerate(_lines(keys, many, by_head[order], cuts)) if lines]
        out.append((gid, 0, STATE, pack(place[symbol], count, group.first, group.ids, place[kind] - place[symbol])))
        return _rows(out)

    return run


def _name_words():
    def run(table: pa.Table) -> pa.Table:
        bucket, gids = table["bucket"][0].as_py(), table["gid"].to_pylist()
        keys, many, counts = _read_lines(table["blob"].to_pylist())
        coded = keys.dictionary_encode()
        index = coded.indices.to_numpy()
        shared = np.flatnonzero(np.bincount(index, 1 + many, len(coded.dictionary)) > 1)
        head, own = span_hash(coded.dictionary)
        order = np.lexsort((own[shared], head[shared]))
        if len(order) and ((np.diff(own[shared][order]) == 0) & (np.diff(head[shared][order]) == 0)).any():  # an order that any rows give
            words = coded.dictionary.take(pa.array(shared)).to_pylist()
            order = np.array(sorted(range(len(words)), key=words.__getitem__))
        ranks = np.full(len(head), -1)
        ranks[shared[order]] = np.arange(len(order))
        return _rows([(gid, bucket, REPLY, _answer(part)) for gid, part in zip(gids, np.split(ranks[index], np.cumsum(counts)[:-1]), strict=True)])

    return run


def _name_pairs(level: int):
    def run(table: pa.Table) -> pa.Table:
        bucket, gids = table["bucket"][0].as_py(), table["gid"].to_pylist()
        asked = [unpack(b) for b in table["blob"].to_pylist()]
        a = np.concatenate([np.cumsum(x[0]) for x in asked])
        b, many = (np.concatenate([x[k] for x in asked]) for k in (1, 2))
        order, new = _sorted_pairs(a, b)
        group = np.cumsum(new) - 1
        shared = np.bincount(group, 1 + many[order]) > 1
        of = np.where(shared, np.cumsum(shared) - 1, -1)
        names = np.empty(len(a), np.int64)
        names[order] = of[group]
        parts = np.split(names, np.cumsum([len(x[0]) for x in asked])[:-1])
        return _rows([(gid, bucket, REPLY + level, _answer(part)) for gid, part in zip(gids, parts, strict=True)])

    return run


def _words(states: pa.Table, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text, ids, names of the words) from what round 0 left and was answered."""
    symbols, widths, first, ids, word = unpack(_blobs(states, STATE)[0])
    return first, ids, np.repeat(_replies(replies, 0, buckets)[symbols + word], widths)


def _bits(*flags: np.ndarray) -> bytes:
    return pack(*map(np.packbits, flags))


def _current(states: pa.Table, replies: pa.Table, level: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, first symbol of each text) after a round of pairs."""
    joined, names, first = unpack(_blobs(states, STATE)[-1])
    at = np.flatnonzero(np.unpackbits(joined.astype(np.uint8), count=len(names)))
    names[at] = _replies(replies, level, buckets)[names[at]]
    return names, first


def _apart(dead: np.ndarray, widths: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Whether a run of a word lies in no window of named words alone: between dead ones and ends of texts are fewer than `width` words."""
    cut = np.zeros(len(widths) + 1, bool)
    cut[:-1] = dead
    cut[1:] |= dead
    cut[first] = True
    cut[0] = True
    heads = np.flatnonzero(cut[:-1])
    if not len(heads):
        return dead
    words = np.add.reduceat(widths, heads)
    return np.repeat((words < width) | dead[heads], np.diff(heads, append=len(widths)))


def _step_pairs(buckets: int, level: int, width: int):
    """A later round: the names of the round before, pairs of them, and what to ask for."""

    def run(states: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(states):
            return _ARROW.empty_table()
        gid = states["gid"][0].as_py()
        if level == 1:
            symbols, widths, first, _, word = unpack(_blobs(states, STATE)[0])
            named = _replies(replies, 0, buckets)
            first = np.searchsorted(_starts(widths), first)
            names = named[symbols]
            names[_apart(named[symbols + word] == 0, widths, first, width)] = 0
        else:
            names, first = _current(states, replies, level - 1, buckets)
        right = rights(names, level)
        keep, joined = pairs(names, np.arange(len(names) + 1), first, level, right)
        at = keep[joined]
        a, b = names[at], names[at + 1]
        order, new = _sorted_pairs(a, b)
        index = np.empty(len(a), np.int64)
        index[order] = np.cumsum(new) - 1
        heads = order[new]
        many = _many(index, np.repeat(np.arange(len(first) - 1), np.diff(first))[at], len(heads))
        a, b = a[heads], b[heads]
        order, place, cuts = _by_bucket((mix(a.astype(U64) * _PAIR_A + b.astype(U64) * _PAIR_B) % U64(buckets)).astype(np.int64), buckets)
        asked = [x[order] for x in (a, b, many)]
        asked = [[x[cuts[k] : cuts[k + 1]] for x in asked] for k in range(buckets)]
        out = [(gid, k, ASK, pack(np.diff(x, prepend=0), y, z)) for k, (x, y, z) in enumerate(asked) if len(x)]
        stays = np.zeros(len(names), bool)
        stays[keep] = True
        out.append((gid, level, BITS, _bits(stays, names == 0, right)))
        names = names[keep]
        names[joined] = place[index]
        out.append((gid, level, STATE, pack(np.packbits(joined), names, _starts(stays)[first])))
        return _rows(out)

    return run


def _columns(words: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], ranges: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray, width: int) -> list[np.ndarray]:
    """Windows, a column for each of their words: the name of the highest certain symbol that begins there, 0 where one goes on, the word's name where there is none."""
    columns = [words[at + k] for k in range(width)]
    for (names, starts), (low, high) in zip(levels, ranges, strict=True):
        begins = np.zeros(len(words), np.int64)
        begins[starts[:-1]] = names
        for k, column in enumerate(columns):
            held = (at + k >= low) & (at + k < high)
            column[held] = begins[at[held] + k]
    return columns


def _equal_runs(key: np.ndarray, column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a new value begins there): equal values stand together. Values are equal where all their columns are; key is a hash of them."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    new = ~same
    for k in range(width):
        c = column(k, order)
        new |= c[1:] != c[:-1]
    if (new & same).any():  # different values of one hash: sort by the values themselves
        everything = np.arange(len(key))
        columns = [column(k, everything) for k in range(width)]
        order = np.lexsort([*columns, key])
        new = np.zeros(max(len(key) - 1, 0), bool)
        for c in columns:
            new |= c[order][1:] != c[order][:-1]
    return order, np.concatenate([np.ones(min(1, len(key)), bool), new])


def _flags(flags: np.ndarray) -> bytes:
    return pack(np.packbits(flags), np.array([len(flags)]))


def _read_flags(blobs: list[bytes]) -> np.ndarray:
    """The flags of all blobs, one after the other."""
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(x.astype(np.uint8), count=int(n[0])) > 0 for x, n in map(unpack, blobs))])


def _step_prints(width: int, buckets: int):
    """Asks which windows' prints stand in other groups, and keeps the windows."""

    def run(states: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(states):
            return _ARROW.empty_table()
        forget()
        gid = states["gid"][0].as_py()
        symbols, widths, first, ids, word = unpack(_blobs(states, STATE)[0])
        words = np.repeat(_replies(replies, 0, buckets)[symbols + word], widths)
        starts, levels = _starts(widths), []
        for blob in _blobs(states, BITS):
            stays, dead, right = (np.unpackbits(x.astype(np.uint8), count=len(starts) - 1) > 0 for x in unpack(blob))
            levels.append((starts, dead, right))
            starts = np.append(starts[:-1][stays], starts[-1])
        levels.append((starts, _current(states, replies, ROUNDS, buckets)[0] == 0, None))
        n = len(words)
        at = np.zeros(0, np.int64)
        if n >= width:
            doc = np.repeat(np.arange(len(ids)), np.diff(first))
            dead = _starts(words == 0)
            at = np.flatnonzero((doc[: n - width + 1] == doc[width - 1 :]) & (dead[width:] == dead[: n - width + 1]))
        at = living(levels, at, width)
        key = window_hash(words.astype(U64), at, width)
        order, new = _equal_runs(key, lambda k, some: words[at[some] + k], width)
        index = np.empty(len(at), np.int64)
        index[order] = np.cumsum(new) - 1
        heads = order[new]
        doc = ids[np.searchsorted(first, at, "right") - 1] if len(at) else at
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(heads) else doc
        inside = least[index] < doc
        bucket, prints = (key[heads] % U64(buckets)).astype(np.int64), (key[heads] >> U64(32)).astype(np.int64)
        by = np.argsort((bucket.astype(U64) << U64(32)) | prints.astype(U64))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        bucket, prints = bucket[by], prints[by]
        new = np.ones(len(by), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (prints[1:] != prints[:-1])
        asked, cuts = prints[new], np.searchsorted(bucket[new], np.arange(buckets + 1))
        out = [(gid, b, ASK, pack(np.diff(asked[cuts[b] : cuts[b + 1]], prepend=0))) for b in range(buckets) if cuts[b + 1] > cuts[b]]
        out.append((gid, 0, PRINTS, pack(np.diff(at, prepend=0), place[index], inside, new)))
        return _rows(out)

    return run


def _shared_prints():
    """Which prints of each group another group has too; a group sends each once."""

    def run(table: pa.Table) -> pa.Table:
        bucket, gids = table["bucket"][0].as_py(), table["gid"].to_pylist()
        asked = [np.cumsum(unpack(b)[0]) for b in table["blob"].to_pylist()]
        cuts = np.cumsum([len(x) for x in asked])[:-1]
        asked = np.concatenate(asked)
        order = np.argsort(asked, kind="stable")
        same = asked[order][1:] == asked[order][:-1]
        shared = np.empty(len(asked), bool)
        shared[order] = np.append(same, False) | np.append(False, same)
        return _rows([(gid, bucket, PRINTS, _flags(part)) for gid, part in zip(gids, np.split(shared, cuts), strict=True)])

    return run


def _step_windows(width: int, buckets: int):
    """Asks for the windows whose print another group has, in runs, and keeps these and those repeated inside the group."""

    def run(states: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(states):
            return _ARROW.empty_table()
        forget()
        gid = states["gid"][0].as_py()
        steps, place, inside, new = unpack(_blobs(states, PRINTS)[0])
        at = np.cumsum(steps)
        shared = _read_flags(_blobs(replies, PRINTS))[np.cumsum(new) - 1]  # by head
        sent = shared[place]
        keep = np.flatnonzero(sent | (inside > 0))
        at, sent, inside = at[keep], sent[keep], inside[keep]
        head = (np.cumsum(shared) - 1)[place[keep][sent]]
        first, ids, words = _words(states, replies, buckets)
        count = int(shared.sum())
        heads, least = np.full(count, len(words)), np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(heads, head, at[sent])
        np.minimum.at(least, head, ids[np.searchsorted(first, at[sent], "right") - 1])
        # runs of windows in order of place, and from here on runs in order of bucket
        order = np.argsort(heads)
        heads, least = heads[order], least[order]
        low, doc = _least_grams(words, heads, width), np.searchsorted(first, heads, "right") - 1
        new = np.ones(count, bool)
        new[1:] = (heads[1:] != heads[:-1] + 1) | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(new)
        lengths = np.diff(starts, append=count)
        by, _, cuts = _by_bucket((mix(low[starts]) % U64(buckets)).astype(np.int64), buckets)
        starts, lengths = starts[by], lengths[by]
        listed = ragged(starts, lengths)
        place = np.empty(count, np.int64)
        place[order[listed]] = np.arange(count)
        own, ends = ids[doc[starts]], _starts(lengths)
        deltas = least[listed] - np.repeat(own, lengths)
        out = []
        for b in range(buckets):
            x, y = int(cuts[b]), int(cuts[b + 1])
            if y > x:
                out.append((gid, b, ASK, pack(lengths[x:y], own[x:y], deltas[ends[x] : ends[y]], words[ragged(heads[starts[x:y]], lengths[x:y] + width - 1)])))
        asked = np.zeros(len(at), np.int64)  # 0 for what was not sent
        asked[sent] = place[head] + 1
        out.append((gid, 0, STATE, pack(np.diff(at, prepend=0), asked, inside)))
        return _rows(out)

    return run


def _least_grams(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The least hash of a sequence of GRAM words in each window."""
    n = min(GRAM, width)
    hashes = window_hash(words.astype(U64), np.arange(max(0, len(words) - n + 1)), n)
    low = hashes[at]
    for k in range(1, width - n + 1):
        low = np.minimum(low, hashes[at + k])
    return low


def _judge_windows(width: int):
    def run(table: pa.Table) -> pa.Table:
        bucket, gids = table["bucket"][0].as_py(), table["gid"].to_pylist()
        asked = [unpack(b, wide=False) for b in table["blob"].to_pylist()]
        cuts = np.cumsum([int(x[0].sum()) for x in asked])[:-1]
        lengths, own, least, words = (np.concatenate([x.pop(0) for x in asked]) for _ in range(4))
        lengths = lengths.astype(np.int64)
        least = np.repeat(own.astype(np.int64), lengths) + least
        at = ragged(_starts(lengths + width - 1)[:-1], lengths)
        key = window_hash(words.astype(U64), at, width)
        order, new = _equal_runs(key, lambda k, some: words[at[some] + k], width)
        smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        smaller = np.empty(len(key), bool)
        smaller[order] = smallest < least[order]
        return _rows([(gid, bucket, REPLY, _flags(part)) for gid, part in zip(gids, np.split(smaller, cuts), strict=True)])

    return run


def _kept(group: _Group, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, edges) of what stays of each text: its words but for the removed ones, joined by one space."""
    stays = group.solid.copy()
    stays[ragged(group.starts[removed], (group.ends - group.starts)[removed])] = False
    words = np.flatnonzero(~removed)
    text = np.repeat(np.arange(len(group.ids)), np.diff(group.first))[words]
    joints = group.ends[words[:-1][text[1:] == text[:-1]]]  # the white space after a word that another of its text follows
    stays[joints] = True
    raw = group.raw.copy()
    raw[joints] = 0x20
    return raw[stays], _starts(stays)[group.offsets]


def _step_remove(width: int, with_text: bool, fields: pa.Schema):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(docs):
            return fields.empty_table()
        forget()
        group = _Group(docs)
        gone = np.zeros(len(group.starts) + 1, np.int64)
        steps, asked, inside = unpack(_blobs(marks, STATE)[0])
        outside = np.append(False, _read_flags(_blobs(marks, REPLY)))
        hit = np.cumsum(steps)[(inside > 0) | outside[asked]]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + width, -1)
        removed = np.cumsum(gone)[:-1] > 0
        n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[group.first])
        raw, edges = _kept(group, removed)
        kept = pa.Array.from_buffers(pa.string(), len(group.ids), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw)])
        view, edges = memoryview(raw), edges.tolist()
        digests = [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(edges[:-1], edges[1:], strict=True)]
        columns = {"doc_id": pa.array(group.ids, pa.int64(), mask=group.null_id[group.order]), "n_words": pa.array(np.diff(group.first), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            columns["kept_text"] = kept
        back = pa.array(group.order)
        arrays = [columns[f.name] if f.name in columns else docs[f.name].combine_chunks().take(back) for f in fields]
        return pa.Table.from_arrays(arrays, schema=fields)

    return run


def _written(scratch: Scratch, df: DataFrame, name: str) -> DataFrame:
    """Messages as a table with a folder for each kind, so that what is used up can go."""
    path = f"{scratch.root}/{name}"
    df.write.partitionBy("kind").parquet(path)
    return scratch.spark.read.schema("gid int, bucket int, blob binary, kind int").parquet(path).select("gid", "bucket", "kind", "blob")


def _dealt(total: int, group_bytes: int, bucket_bytes: int) -> tuple[int, int]:
    """Numbers of groups and buckets. Messages number as their product: from 256 groups and 128 buckets on, these become larger first and then more."""
    each = lambda least, growth, parts: min(max(least, total // parts), least * growth)
    return parts_for(total, each(group_bytes, GROUP_GROWTH, 256)), parts_for(total, each(bucket_bytes, BUCKET_GROWTH, 128))


def substring_dedup(docs: DataFrame, width: int = WIDTH, with_text: bool = True, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text (kept words joined by one space).

    Null and empty texts have no words (kept_sha256 of the empty string). Repeated rows of a
    doc_id are judged alike: a window that stands only in rows of the same id stays. A null
    doc_id counts as id 0. Fewer than `width` words: nothing goes. An empty table gives an
    empty result; further columns are ignored. With text, text_key is the input text's
    xxhash64: rows of one id and text_key have equal results."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    total = docs.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    n, m = _dealt(total, group_bytes, bucket_bytes)
    dealt = docs.withColumn("gid", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(n)).cast("int"))  # also deals out the rows of one id
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, text_key long" * with_text
    kinds = {"kept_sha256": pa.string(), "kept_text": pa.string()}
    fields = pa.schema([(c, kinds.get(c, pa.int64())) for c in ("doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text", "text_key"] * with_text)])
    scratch = Scratch(docs.sparkSession)
    together = lambda states, names: reduce(DataFrame.unionByName, states).groupBy("gid").cogroup(reduce(DataFrame.unionByName, names).groupBy("gid"))
    with freed_shuffles(docs.sparkSession):
        last = _written(scratch, dealt.groupBy("gid").applyInArrow(_step_runs(m), _MESSAGE), "round-0")
        states, names, bits = [], [], []
        for level in range(ROUNDS + 1):
            name = _name_pairs(level) if level else _name_words()
            names.append(scratch.keep(last.where(F.col("kind") == ASK).groupBy("bucket").applyInArrow(name, _MESSAGE), f"names-{level}"))
            scratch.drop(f"round-{level}/kind={ASK}")
            states.append(last.where(F.col("kind") == STATE))
            if level:
                bits.append(last.where(F.col("kind") == BITS))
            if level < ROUNDS:  # a round reads what the one before it left, and nothing older
                last = _written(scratch, together(states[-1:], names[-1:]).applyInArrow(_step_pairs(m, level + 1, width), _MESSAGE), f"round-{level + 1}")
            if level and level < ROUNDS:
                scratch.drop(f"names-{level}", f"round-{level}/kind={STATE}")
        last = _written(scratch, together([states[0], states[-1], *bits], [names[0], names[-1]]).applyInArrow(_step_prints(width, m), _MESSAGE), "prints")
        scratch.drop(f"names-{ROUNDS}", *(f"round-{k}" for k in range(1, ROUNDS + 1)))
        shared = scratch.keep(last.where(F.col("kind") == ASK).groupBy("bucket").applyInArrow(_shared_prints(), _MESSAGE), "shared")
        scratch.drop(f"prints/kind={ASK}")
        known = together([states[0], last.where(F.col("kind") == PRINTS)], [names[0], shared])
        last = _written(scratch, known.applyInArrow(_step_windows(width, m), _MESSAGE), "windows")
        scratch.drop("prints", "shared", "round-0", "names-0")
        replies = scratch.keep(last.where(F.col("kind") == ASK).groupBy("bucket").applyInArrow(_judge_windows(width), _MESSAGE), "judged")
        scratch.drop(f"windows/kind={ASK}")
    marks = last.where(F.col("kind") == STATE).unionByName(replies)
    return dealt.groupBy("gid").cogroup(marks.groupBy("gid")).applyInArrow(_step_remove(width, with_text, fields), schema)


def query(spark, sf_dir: str) -> DataFrame:
    from quillon.llm.spark_util import documents

    return substring_dedup(documents(spark, sf_dir), with_text=False)
