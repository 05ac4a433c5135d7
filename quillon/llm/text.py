"""Vectorised word handling on Arrow string batches (numpy over the raw UTF-8 bytes).

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; nulls count as empty
texts. Equal spans are found by their bytes (Arrow's dictionary encoding); words then get a
64-bit content hash that is the same on every executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15)
SECOND = U64(0xC2B2AE3D27D4EB4F)  # another base, for keys of more than 64 bits
_KEY = 0x51F15EED
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)  # the first n bytes of eight
_MOST = 64  # bytes that are hashed for many spans at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the public splitmix64 step)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct_spans(raw: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct ones among the spans raw[edges[k]:edges[k+1]] by their bytes, in order of appearance, and each span's place among them."""
    spans = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = spans.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def distinct(raw: np.ndarray, edges: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """As distinct_spans, with the distinct ones as a list."""
    spans, place = distinct_spans(raw, edges)
    return spans.to_numpy(zero_copy_only=False).tolist(), place


def digest64(texts: list[bytes]) -> np.ndarray:
    """64-bit content hash of each text (keyed xxh3), the same on every executor."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t, _KEY) for t in texts), U64, len(texts))


def span_hash(spans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first eight bytes as a number in their order, 64-bit hash) of each of the binary values, the same on every executor."""
    _, edges, data = spans.buffers()
    edges = np.frombuffer(edges, np.int32, len(spans) + 1, spans.offset * 4).astype(np.int64) if len(spans) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[: edges[-1]] if edges[-1] else np.zeros(0, np.uint8)
    eights = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))  # those from each byte on
    starts, lengths = edges[:-1], np.diff(edges)
    out, head = mix(lengths.astype(U64)), np.zeros(len(spans), U64)
    some = np.arange(len(spans))
    for k in range(0, _MOST, 8):
        left = lengths[some] - k
        part = eights[starts[some] + k] & _TAIL[np.minimum(left, 8)]
        if not k:
            head = part.byteswap()
        out[some] = mix(out[some] * _BASE + part)
        some = some[left > 8]
    if len(some):
        out[some] = digest64(spans.take(pa.array(some)).to_pylist())
    return head, out


def window_hash(values: np.ndarray, at: np.ndarray, lengths: np.ndarray | int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of values[a:a+n] for each short window; values are uint64 hashes themselves."""
    same = isinstance(lengths, int)
    most = lengths if same else int(lengths.max(initial=0))
    out = np.zeros(len(at), U64) + np.asarray(lengths).astype(U64)
    for k in range(most):
        if same:
            out = out * base + values[at + k]
        else:
            some = lengths > k
            out[some] = out[some] * base + values[at[some] + k]
    return mix(out)


@dataclass
class Words:
    """Words of a run of texts: byte spans in raw, and first[d]:first[d+1] of each text.

    kind has each word's place in vocabulary, the distinct words, whose hashes are in own."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    kind: np.ndarray
    vocabulary: list[bytes]
    own: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.own[self.kind]

    def text(self, d: int) -> bytes:
        return self.raw[self.offsets[d] : self.offsets[d + 1]].tobytes()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, whether a byte is of a word) of the words of the texts raw[offsets[d]:offsets[d+1]]."""
    n = len(raw)
    solid = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[raw], out=solid[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    return starts, ends, solid[1:-1]


def cut_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts raw[offsets[d]:offsets[d+1]]."""
    if lower:
        raw = _LOWER[raw]
    starts, ends, solid = word_spans(raw, offsets)
    vocabulary, kind = distinct(raw[solid], np.concatenate([[0], np.cumsum(ends - starts)]))
    return Words(raw, starts, ends, kind, vocabulary, digest64(vocabulary), np.searchsorted(starts, offsets), offsets)


def chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text, bytes, offsets) of runs of whole texts of about most_bytes; a longer text is a run of its own."""
    raw, offsets = string_buffers(column)
    d, n = 0, len(offsets) - 1
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + most_bytes, "right")) - 1)
        yield d, e, raw[offsets[d] : offsets[e]], offsets[d : e + 1] - offsets[d]
        d = e


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each span, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    heads = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[heads] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)


class HashIndex:
    """Place of each uint64 key in a list of distinct keys, for arrays of keys at a time; -1 where there is none."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.place = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.place[at] < 0
            self.place[at[free]] = left[free]  # one of those that want the slot gets it
            won = free & (self.place[at] == left)
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.place[at].astype(np.int64)
        off = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[off]
        while len(off):
            at = (at + 1) & self.mask
            got = self.place[at]
            out[off] = got
            more = (got >= 0) & (self.keys[at] != keys[off])
            off, at = off[more], at[more]
        return out


_HELD: list = [None, None]


def held(key: tuple, make: Callable):
    """What make() gives, kept by the worker until another key is asked for: one operator's caches at a time."""
    if _HELD[0] != key:
        forget()
        _HELD[:] = [key, make()]
    return _HELD[1]


def forget() -> None:
    """Frees what `held` keeps, for operators that need the memory themselves."""
    _HELD[:] = [None, None]
