"""Text to vectors. An encoder adds a vector column to a table and encodes one question."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keywords as kw
from ..functions.vectors import _bound

DIMENSIONS = 256


def term_dimensions(text: Column, dimensions: int) -> Column:
    """The dimension of every term of a text, repeats included: the first 32 bits of its MD5 digest, modulo."""
    terms = F.filter(F.split(kw.normalize(text), " "), lambda w: w != "")
    digest = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint")
    return F.transform(terms, lambda w: F.pmod(digest(w), F.lit(dimensions)).cast("int"))


class FunctionEncoder:
    """Encoder over a Python function from texts to vectors, run in Arrow batches."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[float]]]):
        self.encode = encode

    def transform(self, rows: DataFrame, text: str = "message", out: str = "vector") -> DataFrame:
        encode = self.encode

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            return pd.Series([list(map(float, v)) for v in encode(texts.tolist())])

        return rows.withColumn(out, vectors(text))

    def question(self, spark: SparkSession, text: str) -> list[float]:
        return [float(x) for x in self.encode([text])[0]]


class HashingEncoder:
    """Offline default: hashed term frequencies weighted by inverse document frequency, as column expressions.

    A term falls into the dimension that its MD5 digest names, so other tools can restate the vectors. ``fit`` reads the
    messages once; the model has one weight per dimension, log((n + 1) / (df + 1)) for n messages of which df hold
    a term of that dimension. A text without terms is the zero vector, and so is null.
    """

    def __init__(self, weights: Sequence[float]):
        self.weights = [float(w) for w in weights]

    @classmethod
    def fit(
        cls, rows: DataFrame, text: str = "message", dimensions: int = DIMENSIONS
    ) -> HashingEncoder:
        held = F.array_distinct(term_dimensions(F.col(text), dimensions))
        # -1 counts the messages themselves, so one job of at most dimensions + 1 rows does
        counted = (
            rows.select(F.explode(F.concat(F.array(F.lit(-1)), F.coalesce(held, F.array().cast("array<int>")))).alias("d"))
            .groupBy("d")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        found = {r.d: r.n for r in counted.collect()}
        total = found.get(-1, 0)
        return cls([math.log((total + 1) / (found.get(d, 0) + 1)) for d in range(dimensions)])

    def transform(self, rows: DataFrame, text: str = "message", out: str = "vector") -> DataFrame:
        dimensions = len(self.weights)
        weights = F.array(*map(F.lit, self.weights))

        def dense(counts: Column) -> Column:
            each = F.transform(weights, lambda w, d: F.coalesce(F.element_at(counts, d), F.lit(0)) * w)
            return each.cast("array<float>")

        def counted(terms: Column) -> Column:
            times = F.transform(
                F.array_distinct(terms),
                lambda d: F.struct(d, F.size(F.filter(terms, lambda t: t == d)).alias("n")),
            )
            return _bound(F.map_from_entries(times), dense)

        terms = F.coalesce(term_dimensions(F.col(text), dimensions), F.array().cast("array<int>"))
        return rows.withColumn(out, _bound(terms, counted))

    def question(self, spark: SparkSession, text: str) -> list[float]:
        row = spark.range(1).select(F.lit(text).alias("message"))
        return list(self.transform(row).first()["vector"])
