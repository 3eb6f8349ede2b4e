"""Vector arithmetic on array columns, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(col: Column) -> Column:
    return col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length."""
    products = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def _bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(vector: Column) -> Column:
    """The vector scaled to length one, as floats; the zero vector stays as it is."""

    def scaled(v: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)
        length = F.when(squares > 0, F.sqrt(squares)).otherwise(1.0)
        return _bound(length, lambda n: F.transform(v, lambda x: x / n))

    return _bound(_double(vector), scaled).cast("array<float>")


def literal(values) -> Column:
    """A Python vector as an array column."""
    return F.array(*[F.lit(float(v)) for v in values])
