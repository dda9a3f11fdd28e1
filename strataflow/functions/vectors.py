"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_literal(a: Column, query) -> Column:
    """Dot product with a given vector, as a sum of element products: no lambda, so it is compiled."""
    terms = [F.get(a, F.lit(i)).cast("double") * F.lit(float(q)) for i, q in enumerate(query)]
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def score01(cos: Column) -> Column:
    """Cosine on the scale from 0 to 1."""
    return (cos + 1.0) / 2.0
