"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Evidence of a window is its compressed length with a dictionary of ordinary text less that
with one of toxic text. Windows are lowered and joined by one space; they have two scales.

* `WINDOW` running words, the next window beginning `STRIDE` words on, so that any four words
  that follow each other stand in one (of fewer bytes, a compressor stores short words as they
  are). A dictionary ends in what its kind of text repeats: the running words that
  sequences of `GRAM` words cover that stand in several documents of the kind and, as shares of
  documents, in few of the other. Before it stands the same ordinary running text on both sides,
  in which all common words are: a window saves bytes only where words follow each other as they
  do in toxic text. From that, the saving of the same words alone (below) is taken.
* Single words, by `FOLDS_K` pairs of dictionaries of the words of toxic and of ordinary
  documents, each pair from other documents; evidence is the mean over all pairs, so that
  chance finds of one document's words weigh little.

A document's features are its `TOP` best windows of each scale and its length; a logistic
curve, fitted to labelled documents by dictionaries that don't hold them, gives the score.
Windows are scored by dictionaries of all folds; the curve is fitted to each fold by those of
the others.

Learning is bounded: at most `SAMPLE` labelled documents of each kind from the training folds
(by hash) and `SAMPLE_BYTES` of their text. Scoring covers every window of every text; equal
words are compressed once by a worker.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.spark_util import documents
from quillon.llm.text import chunks, cut_words, digest64, forget, mix, ragged

FOLDS, HELD_OUT = 3, 1
SAMPLE = {1: 4000, 0: 8000}  # labelled documents that are read to learn from: toxic, ordinary
SAMPLE_BYTES = {1: 6 << 20, 0: 10 << 20}  # and bytes of their texts; a longer text than what is left of these isn't learned from
WINDOW, STRIDE, FOLDS_K, TOP = 8, 5, 3, 3
FEATURES = 2 * TOP + 2
KEEP = 1 << 20  # distinct words held by a worker before it starts anew
GRAM, LEAST, LEAST_SHARE, TIMES = 3, 3, 0.01, 4.0  # words of a sequence; documents, and share of them, that must have it; times the other kind's share
RUN_BYTES, BACKGROUND_BYTES = 128 << 10, 700 << 10
ORDINARY_BYTES, TOXIC_BYTES = 1000 << 10, 300 << 10  # of words, in a dictionary of a pair
THRESHOLD = 0.7
WRONG = 3.0  # how much worse a marked clean document is than a missed toxic one, as shares of their kinds
MOST, MOST_WINDOW = 6.0, 12.0  # bytes of evidence that count of a word, and of a window
CHUNK = 1 << 20
_END = b" " + bytes(8)  # after a text's last word
_TAIL = b"~0Qz7#kV9@xJ4^mW2&yB8*hG5%tR1=cD3+pL6_nS!fK?wZaEoU"  # after a single word; all dictionaries of words hold it


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _compressor(content: bytes, **search):
    import zstandard as z

    parameters = z.ZstdCompressionParameters.from_level(3, window_log=21, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0, **search)
    return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=parameters)


def _of_windows(content: bytes):
    import zstandard as z

    return _compressor(content, strategy=z.STRATEGY_GREEDY, search_log=3, hash_log=18, chain_log=18)


def _of_words(content: bytes):
    import zstandard as z

    return _compressor(content, strategy=z.STRATEGY_LAZY2, search_log=6, hash_log=19, chain_log=19)


def _lengths(compressor, data: bytes, segments: np.ndarray) -> np.ndarray:
    """Compressed length of each segment (offset, length) of data."""
    import zstandard as z

    out = compressor.multi_compress_to_buffer(z.BufferWithSegments(data, segments.astype("<u8").tobytes()), threads=1)
    return np.fromiter(map(len, out), np.float64, len(segments))


class _Sequences:
    """The words of texts, numbered, their texts and the hash of the sequence that begins at each, 0 where a text ends before it does."""

    def __init__(self, texts: list[bytes]):
        numbers: dict[bytes, int] = {}
        self.word = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t.split()), np.int32)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t.split()) for t in texts])
        self.names, self.grams = list(numbers), np.zeros(len(self.word), np.uint64)
        n = len(self.word) - GRAM + 1
        if n > 0:
            digest = digest64(self.names)[self.word]
            mixed = digest[:n].copy()
            for k in range(1, GRAM):
                mixed = mix(mixed * np.uint64(31) + digest[k : n + k])
            whole = self.text[GRAM - 1 :] == self.text[:n]
            self.grams[:n][whole] = np.maximum(mixed[whole], np.uint64(1))

    def but(self, fold: int | None) -> np.ndarray:
        """Which words are of texts of other folds."""
        return np.ones(len(self.text), bool) if fold is None else self.text % FOLDS_K != fold

    def spread(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Sequences of some texts, in how many of these they stand, and how many texts there are."""
        some = some & (self.grams > 0)
        grams, text = self.grams[some], self.text[some]
        order = np.lexsort((text, grams))
        grams, text = grams[order], text[order]
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
        return *np.unique(grams[first], return_counts=True), max(1, len(np.unique(text)))


def _repeated(own: _Sequences, other: _Sequences, fold: int | None) -> bytes:
    """What texts of one kind repeat and those of the other don't, as distinct running words, the most widespread last."""
    some = own.but(fold)
    (found, many, n), (there, often, m) = own.spread(some), other.spread(other.but(fold))
    at = np.minimum(np.searchsorted(there, found), max(0, len(there) - 1))
    elsewhere = np.where(there[at] == found, often[at], 0) if len(there) else np.zeros(len(found), np.int64)
    telling = (many >= max(LEAST, LEAST_SHARE * n)) & (many * m >= TIMES * (elsewhere + 1) * n)
    found, many = found[telling], many[telling]
    if not len(found):
        return b""
    at = np.minimum(np.searchsorted(found, own.grams), len(found) - 1)
    weight = np.where((found[at] == own.grams) & some, many[at], 0)
    covered = np.zeros(len(weight), np.int64)
    for k in range(GRAM):
        covered[k:] = np.maximum(covered[k:], weight[: len(weight) - k])
    edge = np.ones(len(weight) + 1, bool)
    edge[1:-1] = (own.text[1:] != own.text[:-1]) | ((covered[1:] > 0) != (covered[:-1] > 0))
    cuts = np.flatnonzero(edge)
    runs: dict[bytes, int] = {}
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if covered[a]:
            run = b" ".join(own.names[w] for w in own.word[a:b].tolist())
            runs[run] = max(runs.get(run, 0), int(covered[a:b].max()))
    return b" ".join(sorted(runs, key=lambda r: (runs[r], r)))[-RUN_BYTES:]


def _dictionaries(ordinary: _Sequences, toxic: _Sequences, background: bytes, fold: int | None = None) -> tuple[bytes, bytes]:
    """Dictionaries of windows, ordinary and toxic, of the texts of all folds but one."""
    return tuple(background + b" " + _repeated(*x, fold) + b" " for x in ((ordinary, toxic), (toxic, ordinary)))


def _content(texts: list[bytes], size: int, seed: int) -> bytes:
    """The distinct words of texts, the most widespread last, cut to size; then the fixed tail."""
    spread: Counter = Counter()
    for t in texts:
        spread.update(set(t.split()))
    words = sorted(spread)
    random.Random(seed).shuffle(words)
    words.sort(key=spread.__getitem__)
    return b" ".join(words)[-size:] + b" " + _TAIL


class Model:
    """Dictionaries of windows (ordinary, toxic), pairs of them for words, and the weights of the logistic curve."""

    def __init__(self, windows: tuple[bytes, bytes], pairs: list[tuple[bytes, bytes]]):
        self.windows, self.pairs, self.weights = windows, pairs, np.zeros(FEATURES)
        self._clear()

    def _clear(self) -> None:
        self._tools: tuple | None = None
        self._seen: dict[bytes, float] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_tools", "_seen")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._clear()

    def _compressors(self) -> tuple:
        if self._tools is None:
            self._tools = tuple(map(_of_windows, self.windows)), [tuple(map(_of_words, pair)) for pair in self.pairs]
        return self._tools

    def evidence(self, data: bytes, segments: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves of each window, a segment (offset, length) of data."""
        ordinary, toxic = self._compressors()[0]
        return np.clip(_lengths(ordinary, data, segments) - _lengths(toxic, data, segments), 0, MOST_WINDOW)

    def words(self, vocabulary: list[bytes], without: int = -1, seen: dict[bytes, float] | None = None) -> np.ndarray:
        """Mean bytes that the toxic dictionaries of all pairs (but one) save of each word; seen: those known already."""
        seen = self._seen if seen is None else seen
        if len(seen) + len(vocabulary) > KEEP:
            seen.clear()
        if new := [w for w in vocabulary if w not in seen]:
            cuts = np.cumsum([0, *(len(w) + 2 + len(_TAIL) for w in new)])
            data, segments = b"".join([b" " + w + b" " + _TAIL for w in new]), np.stack([cuts[:-1], np.diff(cuts)], axis=1)
            saved = [np.clip(_lengths(ordinary, data, segments) - _lengths(toxic, data, segments), -2, MOST) for k, (ordinary, toxic) in enumerate(self._compressors()[1]) if k != without]
            seen.update(zip(new, np.maximum(0, sum(saved) / len(saved)).tolist(), strict=True))
        return np.fromiter(map(seen.__getitem__, vocabulary), np.float64, len(vocabulary))

    def features(self, raw: np.ndarray, offsets: np.ndarray, without: int = -1, seen: dict[bytes, float] | None = None) -> np.ndarray:
        """A row per text: best windows' evidence, log of words, 1."""
        w = cut_words(raw, offsets, lower=True)
        n = np.diff(w.first)
        out = np.zeros((len(n), FEATURES))
        out[:, -2], out[:, -1] = np.log1p(n), 1
        if not len(w.kind):
            return out
        # words with a space before each, and the end mark after each text's last
        last = np.zeros(len(w.kind), bool)
        last[w.first[1:][n > 0] - 1] = True
        size = w.ends - w.starts + 1
        after = np.cumsum(size + last * len(_END))
        begin = after - size - last * len(_END)
        plain = np.zeros(int(after[-1]), np.uint8)
        plain[begin] = 0x20
        plain[ragged(begin + 1, size - 1)] = w.raw[ragged(w.starts, size - 1)]
        plain[(after[last] - len(_END))[:, None] + np.arange(len(_END))] = np.frombuffer(_END, np.uint8)
        windows = np.where(n > 0, 1 + -(-np.maximum(n - WINDOW, 0) // STRIDE), 0)
        doc = np.repeat(np.arange(len(n)), windows)
        heads = w.first[doc] + STRIDE * (np.arange(len(doc)) - np.concatenate([[0], np.cumsum(windows)])[doc])
        tails = np.minimum(heads + WINDOW, w.first[doc + 1]) - 1
        value = self.evidence(plain.tobytes(), np.stack([begin[heads], after[tails] - begin[heads]], axis=1))
        word = self.words(w.vocabulary, without, seen)[w.kind]
        upto = np.concatenate([[0.0], np.cumsum(word)])
        value = value - (upto[tails + 1] - upto[heads])  # what follows from the words alone is the other scale's
        for k, (doc, value) in enumerate(((doc, value), (np.repeat(np.arange(len(n)), n), word))):
            some = np.flatnonzero(value > 0)
            some = some[np.lexsort((-value[some], doc[some]))]
            d = doc[some]
            rank = np.arange(len(some)) - np.searchsorted(d, np.arange(len(n)))[d]
            best = rank < TOP
            out[d[best], k * TOP + rank[best]] = value[some][best]
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -60, 60)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, decay: float = 1e-1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)), x.T @ (y - p) - decay * w)
        w += np.clip(step, -5, 5)
    return w


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def _features_of(model: Model, texts: list[bytes], fold: int) -> np.ndarray:
    """Features of texts of a fold, a few at a time: the driver holds no more."""
    found, seen, part, size = [], {}, [], 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size > CHUNK // 4 or k == len(texts) - 1:
            found.append(model.features(*_joined(part), fold, seen))
            part, size = [], 0
    return np.concatenate(found)


def _sample(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of the labelled documents that are learned from, by hash, within SAMPLE and SAMPLE_BYTES.

    Only ids and lengths of at most SAMPLE documents are collected to choose them."""
    chosen = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(n) for k, n in SAMPLE.items()]
    held = rows.join(chosen[0].unionByName(chosen[1]), "doc_id")
    sizes = held.groupBy("doc_id", "toxic").agg(F.sum(F.octet_length("text")).alias("n"), F.xxhash64(F.lit("toxicity"), "doc_id").alias("h")).collect()
    left, ids = dict(SAMPLE_BYTES), []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["n"]
            ids.append((r["doc_id"],))
    return held.join(F.broadcast(rows.sparkSession.createDataFrame(ids, "doc_id long")), "doc_id").select("doc_id", "toxic", "text")


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from labelled documents of the training folds; None if a label is missing there."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = {(r["toxic"], r["text"].encode()): r["doc_id"] for r in _sample(rows, marked).collect()}
    found = sorted(found.items(), key=lambda x: (x[1], x[0]))
    texts = {k: [t.lower() for (label, t), _ in found if label == k] for k in (0, 1)}
    if min(map(len, texts.values())) < FOLDS_K:
        return None
    folds = {k: [texts[k][f::FOLDS_K] for f in range(FOLDS_K)] for k in texts}
    pairs = [(_content(folds[0][f], ORDINARY_BYTES, f), _content(folds[1][f], TOXIC_BYTES, f)) for f in range(FOLDS_K)]
    kinds = [_Sequences(texts[k]) for k in (0, 1)]
    x, y = [], []
    for f in range(FOLDS_K):
        background = b" ".join(t for g in range(FOLDS_K) if g != f for t in folds[0][g])[-BACKGROUND_BYTES:]
        model = Model(_dictionaries(*kinds, background, f), pairs)
        for k in (0, 1):
            part = _features_of(model, folds[k][f], f)
            x.append(part)
            y.append(np.full(len(part), float(k)))
    model = Model(_dictionaries(*kinds, b" ".join(texts[0])[-BACKGROUND_BYTES:]), pairs)
    x, y = np.concatenate(x), np.concatenate(y)
    model.weights = _logistic(x, y)
    # calibration: the curve passes THRESHOLD where missed and wrongly marked documents, as shares of their kinds, are fewest
    z = x @ model.weights
    cuts = np.unique(z)
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    missed = np.searchsorted(np.sort(z[y == 1]), cuts) / (y == 1).sum()
    marked = 1 - np.searchsorted(np.sort(z[y == 0]), cuts) / (y == 0).sum()
    model.weights[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cuts[np.argmin(missed + WRONG * marked)]
    return model


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = held.value
        for batch in batches:
            for d, e, raw, offsets in chunks(batch.column(1), CHUNK):
                score = model.scores(model.features(raw, offsets)) if model is not None else np.zeros(e - d)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(d, e - d), batch.column(2).slice(d, e - d), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    Null and empty texts have no evidence and score by length alone. Repeated rows are
    scored each; a null doc_id counts as the empty string in choosing folds. With no
    labelled document of either kind to learn from, scores are 0. Of several labels of a
    document the toxic one counts. An empty table gives an empty result."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(learn(docs, labels))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(_score(held), "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
