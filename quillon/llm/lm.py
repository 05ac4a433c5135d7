"""Gated recurrent language model scores of whole documents, beside a unigram base.

Counts: every training document's words and ends are counted; counts are pre-aggregated by
batch and shuffled. The base of a token is (c + 0.5) / (N + 0.5 (V + 1)).

Model: symbols are the most frequent words, the end, and buckets that hold all other words by
a hash of their last bytes. A gated recurrent unit reads symbols; the next symbol's
probability is its class's times its own within the class. A word in a bucket has the
bucket's probability times its share of the bucket's base mass, so that the model's
probabilities of words sum to one. State starts at zero with each document and is carried
through its windows to its end.

Training: truncated backpropagation in numpy, started from the unigram distribution. In each
round, tasks train on their documents of the round from the same parameters, which are then
averaged by tokens in Spark. Rounds are dealt by hash; every training document is in one.

Scoring: one pass, documents side by side; long ones of a task wait for each other, so that
a step serves many. Counts of frequent words (at most `HEAD` of them) go to the
tasks, all other words meet their counts in a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.spark_util import Scratch, documents
from quillon.llm.text import U64, HashIndex, Words, chunks, cut_words, forget, mix

FOLDS, HELD_OUT = 5, 1
HEAD = 1 << 18
CLASSES, MEMBERS, BUCKETS = 32, 32, 64
SYMBOLS = CLASSES * MEMBERS
EMBED, HIDDEN, WINDOW, LANES = 16, 16, 32, 512
TRAIN_ROUNDS = 4  # each takes one in TRAIN_ROUNDS of the training documents
TRAIN_LANES, SEGMENT = 128, 512  # documents that are trained on side by side; a longer one is trained on in segments
RUN = 8  # chunks of text that are trained on or scored together
LONG, LATE = 1024, 1 << 21  # longer documents wait until so many of their tokens can be scored side by side
RATE = 0.01
END = U64(0x5851F42D4C957F2D)  # hash that stands for a document's end
LOG10 = float(np.log(10))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def buckets(vocabulary: list[bytes]) -> np.ndarray:
    """Bucket of each word, by its last three bytes."""
    tails = b"".join([w[-3:].rjust(3, b"\0") for w in vocabulary])
    value = np.frombuffer(tails, np.uint8).reshape(-1, 3).astype(U64) @ np.array([65536, 256, 1], U64)
    return (mix(value + U64(1)) % U64(BUCKETS)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for _, e, raw, offsets in chunks(batch.column(0)):
            w = cut_words(raw, offsets, lower=True)
            parts.append((w.own, buckets(w.vocabulary), np.bincount(w.kind, minlength=len(w.own))))
        if not parts:
            continue
        h, b, c = (np.concatenate([p[k] for p in parts]) for k in range(3))
        h, first, at = np.unique(h, return_index=True, return_inverse=True)
        c = np.bincount(at, c).astype(np.int64) if len(h) else c
        yield pa.RecordBatch.from_arrays([pa.array(np.append(h, END).astype(np.int64)), pa.array(np.append(b[first], -1), pa.int32()), pa.array(np.append(c, len(batch)), pa.int64())], names=["h", "bucket", "c"])


class Statistics:
    """What tasks know of the counts: totals, frequent words, the model's symbols and their base masses."""

    def __init__(self, total: int, distinct: int, ends: int, head: list[tuple[int, int, int]], mass: dict[int, float]):
        self.total, self.distinct = total, distinct
        self.below = total + 0.5 * (distinct + 1)
        rows = sorted(head, key=lambda r: (-r[2], r[0]))
        self.head = np.array([r[0] for r in rows], U64)
        self.count = np.array([r[2] for r in rows], np.int64)
        words = min(len(rows), SYMBOLS - BUCKETS - 1)
        mass = dict(mass)
        for _, b, c in rows[:words]:
            mass[b] = mass.get(b, 0.0) - (c + 0.5)
        weights = np.concatenate([self.count[:words] + 0.5, [ends + 0.5], [max(0.0, mass.get(b, 0.0)) + 0.5 for b in range(BUCKETS)]])
        weights = np.concatenate([weights, np.full(SYMBOLS - len(weights), 1e-6)])
        order = np.argsort(-weights, kind="stable")
        symbol = np.empty(SYMBOLS, np.int64)
        symbol[order] = np.arange(SYMBOLS)
        self.word_symbol, self.end_symbol, self.bucket_symbol = symbol[:words], int(symbol[words]), symbol[words + 1 : words + 1 + BUCKETS]
        self.bucket_log = np.log10(weights[words + 1 : words + 1 + BUCKETS] / self.below)
        self.weights = weights[order] / weights.sum()
        self.base = np.log10((self.count + 0.5) / self.below)
        self.end_base = float(np.log10((ends + 0.5) / self.below))
        self._index: HashIndex | None = None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if self._index is None:
            self._index = HashIndex(self.head)
        return self._index.find(hashes)

    def symbols(self, words: Words, place: np.ndarray) -> np.ndarray:
        """Symbol of each distinct word; place: its place in the head."""
        known = (place >= 0) & (place < len(self.word_symbol))
        out = self.bucket_symbol[buckets(words.vocabulary)]
        out[known] = self.word_symbol[place[known]]
        return out

    def __getstate__(self):
        return self.__dict__ | {"_index": None}


def initial(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters whose output is the unigram distribution whatever the state."""
    r = np.random.default_rng(7)
    by_class = weights.reshape(CLASSES, MEMBERS)
    return {
        "embed": (r.standard_normal((SYMBOLS, EMBED)) * 0.3).astype(np.float32),
        "input": (r.standard_normal((EMBED, 3 * HIDDEN)) / np.sqrt(EMBED)).astype(np.float32),
        "state": (r.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32),
        "gates": np.concatenate([np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32),
        "class": np.zeros((HIDDEN, CLASSES), np.float32),
        "class_bias": np.log(by_class.sum(axis=1)).astype(np.float32),
        "word": np.zeros((CLASSES, HIDDEN, MEMBERS), np.float32),
        "word_bias": np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32),
    }


class Lanes:
    """Documents side by side: each lane reads whole documents one after the other."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, end: int, most: int = LANES):
        size = np.diff(first)  # with the end
        lanes = int(np.clip(len(symbols) // max(256, int(size.max())), 1, most))
        heap = [(0, k) for k in range(lanes)]
        lane, start = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for d in np.argsort(-size, kind="stable").tolist():
            used, k = heapq.heappop(heap)
            lane[d], start[d] = k, used
            heapq.heappush(heap, (used + int(size[d]), k))
        doc = np.repeat(np.arange(len(size)), size)
        self.flat = (start[doc] + np.arange(len(symbols)) - first[doc]) * lanes + lane[doc]
        steps = max(u for u, _ in heap)
        self.shape = (steps, lanes)
        self.target = np.full(steps * lanes, -1, np.int32)
        self.target[self.flat] = symbols
        self.target = self.target.reshape(self.shape)
        self.input = np.full(self.shape, end, np.int32)
        self.input[1:] = np.maximum(self.target[:-1], 0)
        self.begin = np.zeros(steps * lanes, bool)
        self.begin[self.flat[first[:-1]]] = True
        self.begin = self.begin.reshape(self.shape)
        self.input[self.begin] = end


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict[str, np.ndarray], table: np.ndarray, inputs: np.ndarray, begin: np.ndarray, h: np.ndarray, keep: bool):
    """States after each step of a window; with keep, what backpropagation needs."""
    steps, lanes = inputs.shape
    out = np.empty((steps, lanes, HIDDEN), np.float32)
    kept = np.empty((5, *out.shape), np.float32) if keep else None
    for t in range(steps):
        if begin[t].any():
            h = np.where(begin[t][:, None], np.float32(0), h)
        x, u = table[inputs[t]], h @ p["state"]
        g = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        if keep:
            for k, v in enumerate((h, z, r, n, u[:, 2 * HIDDEN :])):
                kept[k, t] = v
        out[t] = h = new
    return out, h, kept


def _chosen(x: np.ndarray, at: np.ndarray, grads: bool) -> np.ndarray:
    """Log softmax over rows of x (a column per target) at one row each; with grads, x becomes its negative gradient."""
    columns = np.arange(len(at))
    x -= x.max(axis=0)
    log = x[at, columns]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    log -= np.log(total)
    if grads:
        x /= total
        x[at, columns] -= 1
    return log


def output(p: dict[str, np.ndarray], states: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None, scale: float = 1.0):
    """Natural log probability of each target; with grads, adds to them and returns the states' gradient too."""
    kind, member = (target // MEMBERS).astype(np.int16), target % MEMBERS
    order = np.argsort(kind, kind="stable")
    cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
    s, kind, member = states[order], kind[order], member[order]
    d = p["class"].T @ s.T + p["class_bias"][:, None]
    sorted_log, back = _chosen(d, kind, grads is not None), None
    if grads is not None:
        d *= scale
        grads["class"] += (d @ s).T
        grads["class_bias"] += d.sum(axis=1)
        back = d.T @ p["class"].T
    for k in range(CLASSES):
        at = slice(cuts[k], cuts[k + 1])
        if cuts[k] < cuts[k + 1]:
            d = p["word"][k].T @ s[at].T + p["word_bias"][k][:, None]
            sorted_log[at] += _chosen(d, member[at], grads is not None)
            if grads is not None:
                d *= scale
                grads["word"][k] += (d @ s[at]).T
                grads["word_bias"][k] += d.sum(axis=1)
                back[at] += d.T @ p["word"][k].T
    log = np.empty_like(sorted_log)
    log[order] = sorted_log
    if grads is not None:
        by_target = np.empty_like(back)
        by_target[order] = back
        back = by_target
    return log, back


def log_probabilities(p: dict[str, np.ndarray], symbols: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """log10 probability of every symbol; symbols[first[d]:first[d+1]] is document d with its end."""
    lanes = Lanes(symbols, first, end)
    table = p["embed"] @ p["input"] + p["gates"]
    out = np.zeros(lanes.shape, np.float32)
    h = np.zeros((lanes.shape[1], HIDDEN), np.float32)
    for t in range(0, lanes.shape[0], WINDOW):
        part = slice(t, t + WINDOW)
        states, h, _ = forward(p, table, lanes.input[part], lanes.begin[part], h, False)
        some = lanes.target[part] >= 0
        out[part][some] = output(p, states[some], lanes.target[part][some])[0]
    return out.ravel()[lanes.flat].astype(np.float64) / LOG10


def train(p: dict[str, np.ndarray], symbols: np.ndarray, first: np.ndarray, end: int, rate: float = RATE, moments: dict | None = None) -> dict[str, np.ndarray]:
    """One pass of truncated backpropagation over the documents, by Adam, whose state is in moments between calls.

    Documents of over SEGMENT symbols are read in segments, each from a state of zero on but
    with the symbol before it as its first input."""
    p = {k: v.copy() for k, v in p.items()}
    first = np.unique(np.concatenate([first, *(np.arange(a, b, SEGMENT) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if b - a > SEGMENT)]))
    lanes = Lanes(symbols, first, end, TRAIN_LANES)
    lanes.input.ravel()[lanes.flat[first[1:-1]]] = symbols[first[1:-1] - 1]  # a document's last symbol is the end
    moments = {} if moments is None else moments
    one, two = (moments.setdefault(x, {k: np.zeros_like(v) for k, v in p.items()}) for x in ("one", "two"))
    h = np.zeros((lanes.shape[1], HIDDEN), np.float32)
    for t in range(0, lanes.shape[0], WINDOW):
        step = moments["step"] = moments.get("step", 0) + 1
        part = slice(t, t + WINDOW)
        inputs, begin, target = lanes.input[part], lanes.begin[part], lanes.target[part]
        table = p["embed"] @ p["input"] + p["gates"]
        states, h, (before, z, r, n, u) = forward(p, table, inputs, begin, h, True)
        some = target >= 0
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        back = np.zeros_like(states)
        back[some] = output(p, states[some], target[some], grads, np.float32(1 / some.sum()))[1]
        flow = np.zeros_like(h)
        of_n, of_z, of_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), u * r * (1 - r)
        gate, on = (np.empty((*inputs.shape, 3 * HIDDEN), np.float32) for _ in range(2))
        back_state = np.ascontiguousarray(p["state"].T)
        for s in range(len(inputs) - 1, -1, -1):
            d = back[s] + flow
            dn = d * of_n[s]
            on[s, :, :HIDDEN] = d * of_z[s]
            on[s, :, HIDDEN : 2 * HIDDEN] = dn * of_r[s]
            on[s, :, 2 * HIDDEN :] = dn * r[s]
            gate[s, :, 2 * HIDDEN :] = dn
            flow = d * z[s] + on[s] @ back_state
            if begin[s].any():
                flow = np.where(begin[s][:, None], np.float32(0), flow)
        gate[:, :, : 2 * HIDDEN] = on[:, :, : 2 * HIDDEN]
        grads["state"] += before.reshape(-1, HIDDEN).T @ on.reshape(-1, 3 * HIDDEN)
        g = gate.reshape(-1, 3 * HIDDEN)
        x = inputs.ravel().astype(np.int16)
        grads["gates"] += g.sum(axis=0)
        order = np.argsort(x, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]]))
        used, by_symbol = x[order][heads], np.add.reduceat(g[order], heads, axis=0)
        grads["input"] += p["embed"][used].T @ by_symbol
        grads["embed"][used] += by_symbol @ p["input"].T
        norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        for k, v in grads.items():
            v *= clip
            one[k] += 0.1 * (v - one[k])
            two[k] += 0.01 * (v * v - two[k])
            p[k] -= rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-6)
    return p


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def _read(column: pa.Array, stats: Statistics) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols with ends, cuts, words' hashes, words' place in the head) of runs of texts."""
    for _, _, raw, offsets in chunks(column):
        w = cut_words(raw, offsets, lower=True)
        place = stats.find(w.own)
        yield np.insert(stats.symbols(w, place)[w.kind], w.first[1:], stats.end_symbol).astype(np.int16), w.first, w.hashes, place[w.kind]


def _runs(column: pa.Array, stats: Statistics) -> Iterator[list]:
    """What _read gives, RUN at a time, so that memory doesn't grow with the batch."""
    parts = _read(column, stats)
    while run := list(islice(parts, RUN)):
        yield run


def _train(p: dict[str, np.ndarray], stats: Statistics):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        now, tokens, moments = p, 0, {}
        for batch in batches:
            for parts in _runs(batch.column(0), stats):
                symbols = np.concatenate([x[0] for x in parts]).astype(np.int64)
                sizes = np.concatenate([np.diff(x[1]) + 1 for x in parts])
                now = train(now, symbols, np.concatenate([[0], np.cumsum(sizes)]), stats.end_symbol, moments=moments)
                tokens += len(symbols)
        if tokens:
            flat = _flat(now).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * tokens), pa.array(np.full(len(flat), tokens), pa.int64())], names=["i", "v", "w"])

    return run


def _base_sums(parts: list, stats: Statistics) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each text: known tokens among the frequent; base of these, of the model's words, and bucket masses; hashes of rare words."""
    size = sum(len(x[1]) - 1 for x in parts)
    known, sums, rare, d = np.zeros(size, np.int64), np.zeros((3, size)), [], 0
    of_symbol = np.zeros(SYMBOLS)
    of_symbol[stats.bucket_symbol] = stats.bucket_log
    for symbols, cuts, hashes, place in parts:
        n = len(cuts) - 1
        doc = np.repeat(np.arange(n), np.diff(cuts))
        head, own = place >= 0, (place >= 0) & (place < len(stats.word_symbol))
        sums[0, d : d + n] = np.bincount(doc[head], stats.base[place[head]], n) + stats.end_base
        sums[1, d : d + n] = np.bincount(doc[own], stats.base[place[own]], n) + stats.end_base
        words = np.delete(symbols, cuts[1:] + np.arange(n))
        sums[2, d : d + n] = np.bincount(doc[~own], of_symbol[words[~own]], n)
        known[d : d + n] = np.bincount(doc[head], minlength=n) + 1
        rare += np.split(hashes[~head].astype(np.int64), np.cumsum(np.bincount(doc[~head], minlength=n))[:-1]) if n else []
        d += n
    return known, sums, rare


def _score(p: dict[str, np.ndarray], stats: Statistics):
    def scored(rows: list[tuple]) -> pa.RecordBatch:
        """rows: symbols, then the columns but for the model's; of one run, or of long documents of many."""
        first = np.cumsum([0, *(len(r[0]) for r in rows)])
        log = log_probabilities(p, np.concatenate([r[0] for r in rows]).astype(np.int64), first, stats.end_symbol)
        model = np.add.reduceat(log, first[:-1])
        _, row, doc_id, n, known, base, minus, rare = zip(*rows, strict=True)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), pa.array(np.concatenate(rare)))
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(model - np.array(minus)), lists], names=["row", "doc_id", "n_tokens", "known", "base", "beyond", "rare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        row, late, waiting = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), 0
            for parts in _runs(batch.column(1), stats):
                known, sums, rare = _base_sums(parts, stats)
                symbols = [x for part in parts for x in np.split(part[0], (part[1][1:] + np.arange(1, len(part[1])))[:-1])]
                rows = list(zip(symbols, range(row, row + len(known)), ids[done : done + len(known)], map(len, symbols), known.tolist(), sums[0].tolist(), (sums[1] + sums[2]).tolist(), rare, strict=True))
                row, done = row + len(rows), done + len(rows)
                long = [r for r in rows if len(r[0]) > LONG]
                if len(long) < len(rows):
                    yield scored([r for r in rows if len(r[0]) <= LONG])
                late += [(r[0].copy(), *r[1:-1], r[-1].copy()) for r in long]
                waiting += sum(len(r[0]) for r in long)
                if waiting > LATE:
                    yield scored(late)
                    late, waiting = [], 0
        if late:
            yield scored(late)

    return run


def _cut(rows: DataFrame, column: str, most: int, bits: int) -> tuple[int, int] | None:
    """The largest value that not all rows of can be among the `most` of largest column, and how many are above it; None if all rows fit.

    By counts of the leading bits, then of the next ones within the class that is cut."""
    above, within, shift = 0, F.lit(True), max(0, bits - 14)
    while True:
        found = {r["v"]: r["n"] for r in rows.where(within).groupBy(F.shiftright(column, shift).alias("v")).agg(F.count("*").alias("n")).collect()}
        for v in sorted(found, reverse=True):
            if above + found[v] > most:
                break
            above += found[v]
        else:
            return None
        if not shift:
            return v, above
        within, shift = F.shiftright(column, shift) == v, max(0, shift - 14)


def _most_frequent(words: DataFrame, most: int, total: int) -> DataFrame:
    """The `most` words of largest count; of equal counts, those of largest hash."""
    cut = _cut(words, "c", most, total.bit_length())
    if cut is None:
        return words
    count, above = cut
    ties = words.where(F.col("c") == count)
    least = _cut(ties, "h", most - above, 64)  # never None: the ties don't all fit
    return words.where((F.col("c") > count) | ((F.col("c") == count) & (F.col("h") > least[0])))


def lm_scores(docs: DataFrame, rounds: int = TRAIN_ROUNDS, share: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    A null or empty text is the end alone. A null doc_id belongs to the fold of the empty
    string. Repeated rows count and are scored each. With no training document all counts
    are zero and the model is uniform over its symbols. An empty table gives an empty result.
    A round trains on one in `share` of the training documents; without it the rounds take all."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = docs.where(~held_out(F.col("doc_id")))
    counts = training.select("text").mapInArrow(_count, "h long, bucket int, c long")
    counts = scratch.keep(counts.groupBy("h").agg(F.min("bucket").alias("bucket"), F.sum("c").alias("c")), "counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("bucket") < 0, F.col("c"))), F.lit(0))).first()
    words = counts.where("bucket >= 0")
    head = [tuple(r) for r in _most_frequent(words, HEAD, int(totals[0])).select("h", "bucket", "c").collect()]
    mass = {r["bucket"]: r["m"] for r in words.groupBy("bucket").agg((F.sum("c") + 0.5 * F.count("*")).alias("m")).collect()}
    stats = Statistics(totals[0], totals[1], totals[2], [(int(np.int64(h).astype(U64)), b, c) for h, b, c in head], mass)
    del head
    p = initial(stats.weights)
    for r in range(rounds):
        chosen = training.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(share or rounds)) == r).select("text")
        mean = chosen.mapInArrow(_train(p, stats), "i int, v double, w long").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).toPandas()
        if len(mean):
            p = _shaped(mean.sort_values("i")["v"].to_numpy(), p)
    rows = docs.mapInArrow(_score(p, stats), "row long, doc_id long, n_tokens long, known long, base double, beyond double, rare array<long>")
    rows = scratch.keep(rows, "scored")
    rare = rows.select("row", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.log10((c + 0.5) / F.lit(stats.below))).alias("rare_base"), F.sum((c > 0).cast("long")).alias("rare_known"))
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    return rows.join(rare, "row", "left").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.when(F.lit(totals[2] > 0), F.col("known")).otherwise(F.col("known") - 1) + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(totals[0])).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("beyond") + base).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
