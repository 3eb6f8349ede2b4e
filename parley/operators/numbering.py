"""Dense row numbers inside a key that may hold most of the table.

``row_number()`` over a chat would sort the whole chat in one task. Here every chat is cut into
ordered slices of bounded size: rows are numbered inside their slice, and the number a slice
starts with is a running sum of slice counts. One task sees one slice of rows, or one count per
slice, however large the chat is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize

# Message ids per slice; ids are dense, so this bounds the rows of a slice.
SLICE_IDS = 500_000


def slice_starts(
    counts: DataFrame, key: str, slice_col: str, *sizes: str, keep: list[str] | None = None
) -> DataFrame:
    """(key, slice, <size>_start ...): what lies before each slice of a key, per size column."""
    ahead = (
        Window.partitionBy(key)
        .orderBy(slice_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = [F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}_start") for n in sizes]
    return counts.select(key, slice_col, *(keep or []), *starts)


def number_rows(
    rows: DataFrame, key: str, order: list[str], slice_of: Column, out: str, first: int = 1
) -> DataFrame:
    """Add a dense number ``first, first + 1, ...`` per key in the given order.

    ``slice_of`` must never decrease along ``order``.
    """
    counts = (
        rows.select(key, slice_of.alias("_slice"))
        .groupBy(key, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    starts = slice_starts(counts, key, "_slice", "_n")
    in_slice = Window.partitionBy(key, "_slice").orderBy(*order)
    number = F.col("_n_start") + F.col("_rn") + F.lit(first - 1)
    return (
        rows.withColumn("_slice", slice_of)
        .withColumn("_rn", F.row_number().over(in_slice))
        .join(starts, [key, "_slice"])
        .withColumn(out, number.cast("bigint"))
        .drop("_slice", "_rn", "_n_start")
    )


def number_by_id(rows: DataFrame, out: str, first: int = 1) -> DataFrame:
    """Dense numbers per chat for a subset of its messages, in order of the message id."""
    slices = F.floor(F.col("message_id") / F.lit(SLICE_IDS))
    return number_rows(rows, "chat_id", ["message_id"], slices, out, first)


def place_rows(rows: DataFrame, key: str, order: list, out: str, first: int = 1) -> DataFrame:
    """Dense numbers ``first, first + 1, ...`` per key in any order, whatever number of rows a key has.

    Rows are dealt out by ranges of (key, order), sorted in their range and stored at once with their place in it.
    What lies ahead in the key is then a running sum over the ranges, of which one key has few. Rows that are equal
    in the order get numbers in no particular order.
    """
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    stored = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()))
    # the upper bits of that number are the range
    stored = stored.withColumn("_range", F.shiftright("_at", 33))
    counts = stored.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    starts = slice_starts(counts, key, "_range", "_n", keep=["_first"])
    number = F.col("_n_start") + F.col("_at") - F.col("_first") + F.lit(first)
    # a null key meets itself
    joined = stored.alias("r").join(
        starts.alias("s"), F.col(f"r.{key}").eqNullSafe(F.col(f"s.{key}")) & (F.col("r._range") == F.col("s._range"))
    )
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], number.cast("bigint").alias(out))
