"""Packing: documents cut into pieces of power-of-two length, bucketed by length.

Each sequence is one piece of one document, so no sequence crosses documents and none is padded.
A document of n ids gives n // 2048 pieces of 2048 and one piece for each binary digit of the
rest, longest first. Buckets are folders ``length=2048`` to ``length=1`` of the written table, so a
trainer reads batches of equal length. No row is shuffled: pieces are made where texts are read, and numbered
where they are read back.

Null text counts as empty and gives one piece that holds the end id only; repeated rows are packed
as often as they occur; a null doc_id is carried along; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.shared import bounded, shared_folder
from parley.llm.tokens import encoder

LONGEST = 2048
PIECE = "doc_id long, start long, length int, doc_tokens long, ids array<int>"


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths that add up to n: as many of the longest as fit, then powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [
        1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1
    ]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, longest: int = LONGEST) -> DataFrame:
    """One row per piece with its ids; doc_tokens counts the document's ids with the end id."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            offsets, ids = encoder(tokenizer).encode(batch.column("text"), end_id)
            sizes = np.diff(offsets)
            by_doc = [piece_lengths(n, longest) for n in sizes.tolist()]
            doc = np.repeat(np.arange(len(sizes)), [len(x) for x in by_doc])
            length = np.asarray([n for x in by_doc for n in x], "i8")
            bounds = np.concatenate([[0], np.cumsum(length)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(bounds[:-1] - offsets[doc]),
                    pa.array(length.astype("i4")),
                    pa.array(sizes[doc].astype("i8")),
                    pa.ListArray.from_arrays(bounds.astype("i4"), ids.view("i4")),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, PIECE)


def write_sequences(rows: DataFrame, path: str) -> DataFrame:
    """Write pieces into a folder per length and number them as sequences.

    Sequences are numbered without gaps, longer ones first, by written file and place in it; only
    counts by file are summed over. They go to the rows as a broadcast, one line a file, so that no ids are shuffled
    or sorted to meet them.
    """
    rows.write.partitionBy("length").option("compression", "zstd").parquet(path)
    written = (
        rows.sparkSession.read.schema(rows.schema)
        .parquet(path)
        .select(
            "*",
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.row_index").alias("place"),
        )
    )
    ahead = Window.orderBy(F.desc("length"), "file").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = written.groupBy("length", "file").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select(
        "length", "file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")
    )
    return written.join(F.broadcast(bases), ["length", "file"]).select(
        "doc_id",
        "start",
        F.col("length").cast("long"),
        "doc_tokens",
        (F.col("base") + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        "ids",
    )


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = LONGEST) -> DataFrame:
    """Sequences of the documents with their ids, from the written buckets."""
    path = shared_folder(docs.sparkSession, "sequences")
    return write_sequences(pieces(docs, tokenizer, end_id, longest), path)
