"""Export files as they arrive.

Parsing whole exports keeps no state between files, so the batch plan runs unchanged on a file
stream, and so do the row-local steps behind it (scores, calendar, link counts). Context windows
and duplicates need the finished chat and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.exports import parse_texts


def stream_exports(
    spark: SparkSession, path: str, pivot_year: int | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """Messages of every export file that appears under a directory."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    files = reader.text(path, wholetext=True)
    texts = files.select(
        F.col("_metadata.file_path").alias("chat_id"), F.col("value").alias("text")
    )
    return parse_texts(texts, pivot_year)
