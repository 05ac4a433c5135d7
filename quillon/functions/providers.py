"""Extension points that call Python: embedding providers and real token counters (V9, 2.14)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import token_count


class Provider(Protocol):
    """Vectors of texts, in order. Raises TransientError where a second try may help."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Completion(NamedTuple):
    text: str
    prompt_tokens: int
    completion_tokens: int


class Completer(Protocol):
    """Answers to prompts, in order. Raises TransientError where a second try may help."""

    def complete(self, prompts: list[str]) -> list[Completion]: ...


class TransientError(Exception):
    """A failure of the network or of the server."""


class MockProvider:
    """The offline default: the same vectors as `vectors.mock_embedding`."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        counts = [0.0] * self.dim
        for word in filter(None, re.split(r"[ \n\t.,:;!?]", text)):
            h = 2166136261
            for byte in word.encode():
                h = (h ^ byte) * 16777619 & 0xFFFFFFFF
            counts[h % self.dim] += 1.0
        norm = math.sqrt(sum(c * c for c in counts))
        return [c / norm for c in counts] if norm else [1.0] + [0.0] * (self.dim - 1)


def embedding(text: Column, make: Callable[[], Provider], batch: int = 64) -> Column:
    """Vectors by a provider that each task makes once; null for null and empty texts (V9).

    At most `batch` texts go in one call. A transient failure is tried once more, then the task
    fails and Spark tries it again."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for part in parts:
            asked = [k for k, t in enumerate(part) if t]
            out: list = [None] * len(part)
            for start in range(0, len(asked), batch):
                some = asked[start : start + batch]
                for k, vector in zip(some, _twice(provider.embed, [part.iloc[k] for k in some]), strict=True):
                    out[k] = vector
            yield pd.Series(out, dtype=object)

    return run(text)


def _twice(call: Callable[[list[str]], list], texts: list[str]) -> list:
    try:
        return call(texts)
    except TransientError:
        return call(texts)


def completion(prompt: Column, make: Callable[[], Completer], batch: int = 16) -> Column:
    """struct(text, prompt_tokens, completion_tokens) of a completer that each task makes once; at most `batch` prompts go in one call, a transient failure is tried once more."""

    @F.pandas_udf("text string, prompt_tokens long, completion_tokens long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        completer = make()
        for part in parts:
            out = []
            for start in range(0, len(part), batch):
                out += _twice(completer.complete, part.iloc[start : start + batch].tolist())
            yield pd.DataFrame(out, columns=Completion._fields)

    return run(prompt)


def counter(path: str | None = None) -> Callable[[Column], Column]:
    """A token counter: by the tokenizers file at path, which executors must have, or else bytes over four."""
    if path is None:
        return token_count

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for part in parts:
            yield pd.Series([len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in part], dtype="int64")

    return run
