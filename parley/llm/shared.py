"""Folders, stored tables and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as one Arrow batch, but for a single longer text.
BATCH_BYTES = 16 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where the setting is unset, a session of one machine gets a temporary folder; on a cluster an
    error is raised, because executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Setting by which Spark removes the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(rows: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, with no lineage.

    Shuffle files of the write go when it has ended, since nothing reads them again.
    """
    spark = rows.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)


def unused(name: str, columns: Iterable[str]) -> str:
    """A column name that is not among the given ones, which Spark compares without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def numbered(rows: DataFrame, name: str, column: str = "_row") -> DataFrame:
    """The rows stored with a number each in a new column, the same in every later read.

    Numbers made at each read would change with the file splits when executors come or go.
    """
    return stored(rows.withColumn(column, F.monotonically_increasing_id()), name, compression="zstd")


def bounded(
    batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``most`` bytes at most, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(False)
        group = np.cumsum(sizes.astype("i8")) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            yield batch.slice(start, stop - start)


def part_number(file_name):
    """Number of the task that wrote a file, in the order of the written partitions."""
    return F.regexp_extract(file_name, r"part-(\d+)", 1).cast("long")


def ids_crc32(ids):
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("long")
    def checksum(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: zlib.crc32(np.ascontiguousarray(x, "<i4")))

    return checksum(ids)


def crc32_in_place_of(rows: DataFrame, ids: str, name: str = "ids_crc32") -> DataFrame:
    """The rows with the checksum of ``ids_crc32`` as a last column, and without the ids.

    Ids reach the task as Arrow lists and are never Python objects; rows do not wait in a queue beside them.
    """
    kept = [c for c in rows.columns if c != ids]
    schema = rows.select(*kept, F.lit(0).cast("long").alias(name)).schema

    def checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            bounds = (lists.offsets.to_numpy().astype("i8") * 4).tolist()
            sums = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(bounds, bounds[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sums], names=[*kept, name])

    return rows.mapInArrow(checksums, schema)
