"""Expressions over factor vectors held as arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str, size: int | None = None) -> Column:
    """Dot product in double precision.

    With ``size`` the products are written out, which keeps the expression inside generated code;
    without it the arrays are zipped and folded.
    """
    x = F.col(a) if isinstance(a, str) else a
    y = F.col(b) if isinstance(b, str) else b
    if size is not None:
        terms = [x[i].cast("double") * y[i].cast("double") for i in range(size)]
        return reduce(lambda s, t: s + t, terms)
    products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def vector_sum(c: Column | str) -> Column:
    """Aggregate: element-wise sum of arrays, partially aggregated before the shuffle."""
    values = F.col(c) if isinstance(c, str) else c
    return vector_to_array(Summarizer.sum(array_to_vector(values.cast("array<double>"))))


def hash_uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends only on the values, so that reruns and retries agree."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def hash_vector(key: Column | str, size: int, scale: float = 1.0, seed: int = 0) -> Column:
    """Array of ``size`` repeatable numbers in [0, scale) per key."""
    return F.array(*[hash_uniform(key, F.lit(i), seed=seed) * F.lit(scale) for i in range(size)])
