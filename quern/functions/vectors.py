"""Vector kernels as Columns (higher-order functions, all in double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; lengths must agree (else null elements make it null)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """L2-normalised vector; a zero vector stays zero (its divisor is one)."""

    def scaled(v: Column) -> Column:
        return let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))

    return let(a, scaled)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def truncate(a: Column, k: int) -> Column:
    """First ``k`` dimensions, renormalised (Matryoshka)."""
    return unit(F.slice(a, 1, k))


def weighted(fields: list[tuple[Column, float]]) -> Column:
    """Weighted sum of unit fields, renormalised; weights are divided by their sum, which must be positive."""
    total = sum(w for _, w in fields)
    if not fields or total <= 0:
        raise ValueError("weights must have a positive sum")

    def scaled(v: Column, share: float) -> Column:
        return F.transform(unit(v), lambda x: x * F.lit(share))

    out = None
    for v, w in fields:
        part = scaled(v, w / total)
        out = part if out is None else F.zip_with(out, part, lambda x, y: x + y)
    return unit(out)
