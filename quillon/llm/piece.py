"""SentencePiece BPE by a table of the last token of each prefix, and its decoding.

Every prefix of a text has one last token: the token that matches at its end and either is
the whole prefix or goes with the last token of what is before it. Two tokens go together
if no merge across their border comes before the merges that build them (`Vocabulary.together`).
The table is filled from left to right with the matches of a trie automaton, then the ids
are read backwards from the end.

Texts are cut where no piece holds the two characters on either side, so that no merge can
cross the cut; each distinct cut is encoded once. The tables are filled for all new cuts at
a time, with numpy. Runs of white space pieces, which share one score, and very long cuts
are merged step by step instead.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.spark_util import documents
from quillon.llm.text import U64, HashIndex, chunks, distinct, held

SPACE = "▁"
LONGEST = 200  # characters of a cut that the table is filled for with others at a time
KEEP = 400_000  # distinct cuts held by a worker before it starts anew
NEVER = 1 << 30


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.id_of = {m.id_to_piece(i): i for i in plain}
        self.score = {p: m.get_score(i) for p, i in self.id_of.items()}
        self.end = m.eos_id()
        self.bytes = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.surface = [b""] * size
        for p, i in self.id_of.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes.tolist()):
            self.surface[i] = bytes([b])
        self.number = [str(i).encode() for i in range(size)]

        # order of merges; single characters come first
        single = [p for p in self.id_of if len(p) == 1]
        longer = sorted((p for p in self.id_of if len(p) > 1 and SPACE * 2 not in p), key=lambda p: -self.score[p])
        assert len({self.score[p] for p in longer}) == len(longer), "pieces share a score"
        halves = {p: self._halves(p) for p in longer}
        built = [p for p in longer if halves[p]]
        pieces = [*single, *built]
        rank = {p: k for k, p in enumerate(pieces)}
        n = len(pieces)
        self.piece_id = np.array([self.id_of[p] for p in pieces] + [-1], np.int64)
        self.other = n  # a character of no piece
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        for p in built:
            self.left[rank[p]], self.right[rank[p]] = (rank[x] for x in halves[p])
        self.singles = len(single)
        pairs = np.array([[rank[x] for x in halves[p]] for p in built], np.int64).reshape(-1, 2)
        self.pairs = HashIndex(self._pair(pairs[:, 0], pairs[:, 1]))

        # trie: a state for each prefix of a piece
        states: dict[str, int] = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                states.setdefault(p[:k], len(states))
        codes = {s: (states[s[:-1]] << 21) | ord(s[-1]) for s in states if s}
        ordered = sorted(codes, key=states.__getitem__)
        self.edges = HashIndex(np.array([codes[s] for s in ordered], U64))  # place k leads to state k + 1
        self.token_at = np.full(len(states), -1, np.int64)
        for p, k in rank.items():
            self.token_at[states[p]] = k

        # byte pairs that stand side by side in no piece
        side = np.ones((256, 256), bool)
        side[:128, :128] = False
        for p in self.id_of:
            text = p.replace(SPACE, " ")
            for a, b in zip(text, text[1:], strict=False):
                if ord(a) < 128 and ord(b) < 128:
                    side[ord(a), ord(b)] = True
        self.apart = ~side.ravel()
        self.words_end = not any(a != SPACE and b == SPACE for p in self.id_of for a, b in zip(p, p[1:], strict=False))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(U64) << U64(20)) | b.astype(U64)

    def merge(self, text: str) -> list[str]:
        """Pieces of a text by merging the best-scored pair, the leftmost of equals, again and again."""
        part = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (s := self.score.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-s, a, part[a] + part[b]))

        for k in range(len(part) - 1):
            offer(k, k + 1)
        while heap:
            _, a, whole = heapq.heappop(heap)
            b = after[a]
            if not part[a] or b >= len(part) or part[a] + part[b] != whole:
                continue
            part[a], part[b] = whole, ""
            after[a] = after[b]
            if after[a] < len(part):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes the piece last; None if merging its characters doesn't make it."""
        score = self.score.pop(piece)
        parts = self.merge(piece)
        self.score[piece] = score
        return (parts[0], parts[1]) if len(parts) == 2 and all(x in self.id_of for x in parts) and all(len(x) == 1 or self.score[x] > score for x in parts) else None

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens stay as they are side by side.

        From the finished tokens backwards in merge order: the later built of the two border
        parts is taken apart; a pair of border parts that merges before either is built
        further parts the two tokens. Of equal merges the left one comes first."""
        good = np.ones(len(a), bool)
        on = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(on):
            c = self.pairs.find(self._pair(x, y))
            c = np.where(c >= 0, c + self.singles, NEVER)
            bad = (c < until_x) & (c <= until_y) & (c < NEVER)
            good[on[bad]] = False
            go = ~bad & ((x >= self.singles) & (x < self.other) | (y >= self.singles) & (y < self.other))
            on, x, y, until_x, until_y = on[go], x[go], y[go], until_x[go], until_y[go]
            rank_x, rank_y = np.where(x == self.other, -1, x), np.where(y == self.other, -1, y)
            right = (rank_y >= rank_x) & (rank_y >= self.singles)
            until_y = np.where(right, y, until_y)
            until_x = np.where(right, until_x, x)
            y, x = np.where(right, self.left[y], y), np.where(right, x, self.right[x])
        return good

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts (with SPACE for spaces) by the prefix table."""
        out: list[list[int] | None] = [None] * len(texts)
        slow = [k for k, t in enumerate(texts) if len(t) > LONGEST or SPACE * 2 in t]
        for k in slow:
            out[k] = [i for p in self.merge(texts[k]) for i in ([self.id_of[p]] if p in self.id_of else self.bytes[list(p.encode())].tolist())]
        fast = [k for k, t in enumerate(texts) if out[k] is None and t]
        if fast:
            for k, ids in zip(fast, self._table([texts[k] for k in fast]), strict=True):
                out[k] = ids
        return [x if x is not None else [] for x in out]

    def _table(self, texts: list[str]) -> list[list[int]]:
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(U64)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(size)
        first = end - size
        text = np.repeat(np.arange(len(texts)), size)
        stop = end[text]
        # matches: (start, length, token)
        at, state, length = np.arange(len(code)), np.zeros(len(code), np.int64), 0
        starts, lengths, tokens = [], [], []
        while len(at):
            nxt = self.edges.find((state.astype(U64) << U64(21)) | code[at + length]) + 1
            alive = nxt > 0
            if length == 0 and not alive.all():
                starts.append(at[~alive])
                tokens.append(np.full((~alive).sum(), self.other))
                lengths.append(np.ones((~alive).sum(), np.int64))
            at, state = at[alive], nxt[alive]
            length += 1
            token = self.token_at[state]
            hit = token >= 0
            starts.append(at[hit])
            tokens.append(token[hit])
            lengths.append(np.full(hit.sum(), length))
            more = at + length < stop[at]
            at, state = at[more], state[more]
        starts, lengths, tokens = map(np.concatenate, (starts, lengths, tokens))
        reach = starts + lengths - first[text[starts]]  # length of the prefix that a match ends
        order = np.argsort(reach, kind="stable")
        starts, lengths, tokens, reach = starts[order], lengths[order], tokens[order], reach[order]
        cuts = np.searchsorted(reach, np.arange(1, int(size.max()) + 2))
        last, width = np.full(len(code), -1, np.int64), np.zeros(len(code), np.int64)
        for k in range(len(cuts) - 1):
            s, w, t = starts[cuts[k] : cuts[k + 1]], lengths[cuts[k] : cuts[k + 1]], tokens[cuts[k] : cuts[k + 1]]
            whole = s == first[text[s]]
            good = whole.copy()
            inner = np.flatnonzero(~whole)
            good[inner] = self.together(last[s[inner] - 1], t[inner])
            here = (s + w - 1)[good]
            last[here], width[here] = t[good], w[good]
        # ids backwards
        cur, who, found = end - 1, np.arange(len(texts)), []
        while len(cur):
            found.append((who, cur))
            cur = cur - width[cur]
            on = cur >= first[who]
            cur, who = cur[on], who[on]
        who, cur = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.lexsort((cur, who))
        who, cur = who[order], cur[order]
        ids = self.piece_id[last[cur]]
        bounds = np.searchsorted(who, np.arange(len(texts) + 1)).tolist()
        out, flat = [], ids.tolist()
        for k in range(len(texts)):
            out.append(flat[bounds[k] : bounds[k + 1]])
        for k in np.unique(who[ids < 0]).tolist():  # characters of no piece become bytes
            a, b = bounds[k], bounds[k + 1]
            out[k] = [x for i, c in zip(flat[a:b], cur[a:b].tolist(), strict=True) for x in ([i] if i >= 0 else self.bytes[list(chr(int(code[c])).encode())].tolist())]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.surface[i] for i in ids])


class Encoder:
    """Digests of the ids and of the decoded text of whole texts."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids: list[bytes] = []
        self.text: list[bytes] = []
        self.count = np.zeros(1 << 16, np.int64)

    def _add(self, texts: list[bytes]) -> None:
        v = self.vocabulary
        found = v.encode([t.decode().replace(" ", SPACE) for t in texts])
        n = len(self.index)
        while n + len(found) > len(self.count):
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.count[n : n + len(found)] = np.fromiter(map(len, found), np.int64, len(found))
        self.ids += [b" ".join([v.number[i] for i in one]) for one in found]
        self.text += [v.decode(one) for one in found]
        self.index.update(zip(texts, range(n, n + len(found)), strict=True))

    def run(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """(ids with the end id, decimal ids joined by a space, decoded text) of each text."""
        v = self.vocabulary
        filled = np.flatnonzero(np.diff(offsets) > 0)
        raw = np.insert(raw, offsets[filled], 0x20)  # the prefix that a text with characters gets
        offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        n = len(raw)
        cut = np.zeros(n + 1, bool)
        if n > 1:
            cut[1:n] = v.apart[raw[:-1].astype(np.int32) * 256 + raw[1:]]
            if v.words_end:  # no piece goes on after a word's end
                wide = (raw[:-1] >= 0x80) & (raw[1:] == 0x20)
                wide[1:] &= ~((raw[1:-1] == 0x81) & (raw[:-2] == 0x96))  # SPACE itself
                cut[1:n] |= wide
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts = edges[:-1]
        if len(starts):
            keys, inverse = distinct(raw, edges)
            if len(self.index) + len(keys) > KEEP:
                self._clear()
            new = [t for t in keys if t not in self.index]
            for k in range(0, len(new), 1 << 16):
                self._add(new[k : k + (1 << 16)])
            at = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[inverse]
        else:
            at = np.zeros(0, np.int64)
        bounds = np.searchsorted(starts, offsets)
        total = np.concatenate([[0], np.cumsum(self.count[at])])
        end = v.number[v.end]
        ids, text = self.ids, self.text
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = at[a:b].tolist()
            yield int(total[b] - total[a]) + 1, b" ".join([ids[k] for k in own] + [end]), b"".join([text[k] for k in own])[1:]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = held(("pieces", path), lambda: Encoder(path))
        for batch in batches:
            for d, e, raw, offsets in chunks(batch.column(1)):
                rows = [(n, hashlib.sha256(i).hexdigest(), hashlib.sha256(t).hexdigest()) for n, i, t in tool.run(raw, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(d, e - d), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, as the sentencepiece library encodes and decodes.

    A null or empty text is the end id alone. Repeated rows and null ids are kept as they
    are. An empty table gives an empty result; further columns are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
