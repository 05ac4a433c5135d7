"""Vector expressions (JVM-side) and the offline embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is null or empty, or a norm is zero (V1)."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok, F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where lengths differ or a norm is zero (V2)."""
    return F.lit(1.0) - cosine(a, b)


def hit_score(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - distance(a, b)))


def fnv1a(word: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(word), F.lit("([0-9A-F]{2})"), F.lit(1))
    codes = F.transform(pairs, lambda c: F.conv(c, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def mock_embedding(text: Column, dim: int = 32) -> Column:
    """Word counts by hash, of length one; the first axis for a text without words (V8)."""
    slots = F.transform(F.filter(F.split(text, r"[ \n\t.,:;!?]"), lambda w: w != ""), lambda w: F.pmod(fnv1a(w), F.lit(dim)))
    axes = F.sequence(F.lit(0), F.lit(dim - 1))
    first = F.transform(axes, lambda i: F.when(i == 0, 1.0).otherwise(0.0))

    def unit(own: Column) -> Column:
        counts = F.transform(axes, lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double"))
        scaled = F.transform(F.array(counts), lambda c: F.transform(c, lambda x: F.try_divide(x, F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, y: t + y * y)))))
        return F.when(F.size(own) == 0, first).otherwise(scaled[0])

    return F.transform(F.array(slots), unit)[0]  # an array of one binds the slots, so that they are made once
