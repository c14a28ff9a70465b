"""Vector functions as columns: dot product, norm, cosine, dimension reduction, character embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, zero: float = 0.0) -> Column:
    """A vector of norm 0 scores ``zero``; vectors of different length score null."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, F.lit(zero)).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0))))


def unit(a: Column) -> Column:
    return let(norm(a), lambda n: F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def mrl_reduce(v: Column, dim: int, full: int) -> Column:
    """Means of ``dim`` blocks of a vector of ``full`` numbers, normalised; an unreduced vector is normalised only.

    With ``dim`` of the vector's length or more the vector is cut to ``dim``, not normalised.
    """
    if dim == full:
        return unit(v)
    if dim > full:
        return F.slice(v, 1, dim)

    def block(i: Column) -> Column:
        start = F.floor(i * F.lit(full) / F.lit(dim)).cast("int")
        stop = F.floor((i + 1) * F.lit(full) / F.lit(dim)).cast("int")
        mean = F.aggregate(F.slice(v, start + 1, stop - start), F.lit(0.0), lambda s, x: s + x) / F.nullif(stop - start, F.lit(0))
        return F.coalesce(mean, F.get(v, F.least(start, F.lit(full - 1))))

    return let(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), block), unit)


def char_embed(text: Column, dim: int = 128) -> Column:
    """Character codes added up by place modulo ``dim``, normalised: a deterministic embedding for tests and offline use. Null gives null."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double"))

    def by_place(cs: Column) -> Column:
        places = lambda j: F.when(j < F.size(cs), F.sequence(j, F.greatest(F.size(cs) - 1, j), F.lit(dim))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.aggregate(places(j), F.lit(0.0), lambda s, i: s + F.get(cs, i)))

    return let(let(codes, by_place), unit)


def float64_bytes(v):
    """Little-endian doubles, for interchange with stores that keep vectors as blobs."""

    @F.pandas_udf("binary")
    def run(s):
        import numpy as np

        return s.map(lambda x: None if x is None else np.asarray(x, "<f8").tobytes())

    return run(v)


def from_float64_bytes(b):
    @F.pandas_udf("array<double>")
    def run(s):
        import numpy as np

        return s.map(lambda x: None if x is None else np.frombuffer(x, "<f8"))

    return run(b)
