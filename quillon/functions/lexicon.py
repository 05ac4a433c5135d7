"""Names of a large lexicon in texts, by one automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import lexicon_refs
from quillon.schemas import LEXICON, STANDALONE

FEW = 32  # up to so many names, one search for each is the faster way
MOST_BYTES = 64 << 20  # of names: all workers hold them


def references(payload: Column, lexicon: Sequence[str] = LEXICON, standalone: Sequence[str] = STANDALONE) -> Column:
    """The names that a text holds, whatever the case, in the order and spelling of the lexicon, then the first standalone occurrence of each token, as written.

    One pass over a text finds all names at once. Names are compared in lower case. A null text
    has none. More than MOST_BYTES of names are refused: join words with a table of names then."""
    names = list(dict.fromkeys(n for n in lexicon if n))
    if len(names) <= FEW:
        return F.when(payload.isNotNull(), lexicon_refs(payload, tuple(names), tuple(standalone))).otherwise(F.array().cast("array<string>"))
    if sum(len(n.encode()) for n in names) > MOST_BYTES:
        raise ValueError(f"the lexicon holds more than {MOST_BYTES} bytes")
    tokens = [re.compile(f"(?i)(?<![A-Za-z0-9_]){re.escape(t)}(?![A-Za-z0-9_])") for t in standalone]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton, spelled = ahocorasick.Automaton(), {}
        for place, name in enumerate(names):
            spelled.setdefault(name.lower(), []).append(place)
        for low, places in spelled.items():
            automaton.add_word(low, tuple(places))
        automaton.make_automaton()

        def one(text: str | None) -> list[str]:
            if not text:
                return []
            found = {place for _, places in automaton.iter(text.lower()) for place in places}
            return [names[k] for k in sorted(found)] + [m[0] for t in tokens if (m := t.search(text))]

        for part in parts:
            yield part.map(one, na_action=None)

    return run(payload)
