"""Token-ID output: Parquet files of token lists in document order, and reads of parts of them.

A row is (doc_id, n_tokens, ids). Rows are ordered by doc_id over all files. Ids are
dictionary-encoded, doc_id and n_tokens delta-encoded; row groups and pages are small enough for
the page index to find a range of documents, and the metadata columns are read without the ids.

Null text counts as empty and gives the end id only; repeated rows are all written, rows of one
doc_id next to each other; null doc_ids come first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.shared import bounded, ids_crc32, part_number
from parley.llm.tokens import encoder

SCHEMA = "doc_id long, n_tokens int, ids array<int>"
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode whole texts and write them in ascending doc_id order.

    Texts are sorted before they are encoded, so that the sort samples keys without encoding
    twice. The keys after doc_id spread a doc_id that fills many rows over several files.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            offsets, ids = encoder(tokenizer).encode(batch.column("text"), end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets).astype("i4")),
                    pa.ListArray.from_arrays(offsets.astype("i4"), ids.view("i4")),
                ],
                names=["doc_id", "n_tokens", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.orderBy("doc_id", F.xxhash64("text"), F.monotonically_increasing_id())
    ordered.mapInArrow(encode, SCHEMA).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """Token rows of a range of doc_ids; row groups and pages outside it are skipped."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows that come straight from token files.

    start counts the ids of all documents ahead: sums by file are summed over files, and within a
    file rows are summed in written order. Ids themselves are not shuffled.
    """
    placed = rows.select(
        "doc_id",
        F.col("n_tokens").cast("long"),
        "ids",
        part_number(F.col("_metadata.file_name")).alias("part"),
        F.col("_metadata.row_index").alias("place"),
    )
    files = placed.groupBy("part").agg(F.sum("n_tokens").alias("in_file"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("base"))
    small = placed.select("doc_id", "n_tokens", ids_crc32("ids").alias("ids_crc32"), "part", "place")
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = small.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return summed.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
