"""Token ids of whole texts by a public tokenizer file, with each distinct piece of text encoded once.

Both byte-level vocabularies split a text before any merge: no token spans the step from a
visible character to a space or newline, nor one between a letter and a punctuation mark
other than the apostrophe. Texts are cut only at such steps (between characters of ASCII and
Latin-1 whose class is sure), each distinct cut is encoded by the `tokenizers` library once
and the ids are put together by index. Texts that hold the name of a special token are
given to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from quillon.llm.text import _LOWER, chunks, distinct, held, ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
KEEP = 1 << 19  # distinct cuts held by a worker before it starts anew
RUN = 256  # words that are encoded as one text
_SPACED = "Ġ"  # fixed value: how byte-level vocabularies write a leading space
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
_LATIN = np.zeros(256, bool)  # second bytes of the Latin-1 letters after 0xC3
_LATIN[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower = '"Lowercase"' in str(self.tokenizer.normalizer) or "Lowercase" in repr(self.tokenizer.normalizer)
        vocabulary = self.tokenizer.get_vocab()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.word_ends = bool(suffix)
        self.border = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word, or begin one that follows a space
        self.border[[i for t, i in vocabulary.items() if (t.endswith(suffix) if suffix else t.startswith(_SPACED))]] = True
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.place, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths

    def _plain_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _encoded, for words of ASCII letters after a space, RUN of them at a time as one text.

        Such words are split from each other before any merge, and their border ids tell where each begins or ends."""
        flat, _ = self._encoded([b"".join(texts[k : k + RUN]) for k in range(0, len(texts), RUN)])
        at = np.flatnonzero(self.border[flat])
        if len(at) != len(texts):
            return self._encoded(texts)
        return flat, np.diff(at, prepend=-1) if self.word_ends else np.diff(at, append=len(flat))

    def _add(self, texts: list[bytes]) -> None:
        plain = [t for t in texts if t[:1] == b" " and t[1:].isalpha()]
        other = [t for t in texts if not (t[:1] == b" " and t[1:].isalpha())]
        for encode, some in ((self._plain_words, plain), (self._encoded, other)):
            if not some:
                continue
            flat, lengths = encode(some)
            n = len(self.index)
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(some) > len(self.place):
                self.place, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.place, self.size))
            self.flat[self.used : self.used + len(flat)] = flat
            self.size[n : n + len(some)] = lengths
            self.place[n : n + len(some)] = self.used + np.cumsum(lengths) - lengths
            self.used += len(flat)
            self.index.update(zip(some, range(n, n + len(some)), strict=True))

    def run(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts raw[offsets[d]:offsets[d+1]], one after the other, and n+1 offsets."""
        n = len(raw)
        whole = raw.tobytes()
        special = any(s in whole for s in self.special)
        if self.lower and not special:  # the normaliser lowers all letters; ASCII ones now, so that more cuts are alike
            raw = _LOWER[raw]
            whole = raw.tobytes()
        cut = np.zeros(n + 1, bool)
        if n > 1:
            letter, mark = _LETTER[raw], _MARK[raw]
            latin = np.zeros(n, bool)  # the last byte of a Latin-1 letter
            latin[1:] = (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
            letter |= latin
            first = letter.copy()  # the first byte of a letter
            first[:-1] |= latin[1:]
            first[latin] = False
            before = raw[:-1]
            sure = (before > 0x20) & (before < 0x7F)
            sure[1:] |= (before[1:] >= 0x80) & (raw[:-2] >= 0xC3) & (raw[:-2] <= 0xDF)
            cut[1:n] = sure & ((raw[1:] == 0x20) | (raw[1:] == 0x0A)) | letter[:-1] & mark[1:] | mark[:-1] & first[1:]
        if special:
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                if any(s in whole[a:b] for s in self.special):
                    cut[a:b] = False
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts = edges[:-1]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        keys, inverse = distinct(raw, edges)
        if len(self.index) + len(keys) > KEEP:
            self._clear()
        if new := [t for t in keys if t not in self.index]:
            self._add(new)
        at = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[inverse]
        sizes = self.size[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[ragged(self.place[at], sizes)], total[np.searchsorted(starts, offsets)]


def encoded(column: pa.Array, path: str, end: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text, ids, offsets) of runs of whole texts, each text closed by the id end."""
    tool = held(("tokens", path), lambda: Encoder(path))
    for d, e, raw, offsets in chunks(column):
        ids, cuts = tool.run(raw, offsets)
        if end is not None:
            ids = np.insert(ids, cuts[1:], end).astype(np.int32)
            cuts = cuts + np.arange(len(cuts))
        yield d, e, ids, cuts
