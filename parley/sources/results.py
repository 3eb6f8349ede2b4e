"""Results tables as CSV files, readable by and from other tools; parquet is better at scale.

Texts in quoted fields may hold line ends, so a line end alone does not tell where a record ends. Two readers
give the same rows: ``read_results_csv`` lets one task read each file, and ``read_results_csv_split`` reads
every file in as many splits as Spark cuts it into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.numbering import slice_starts
from ..schema import AI_RESULTS
from ..storage import deal_by, store_by

# Quotes doubled inside quoted fields; an empty field is null, as spreadsheets write it.
_FORMAT = {"header": True, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}
_EXACT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_results_csv(
    spark: SparkSession, path: str, schema: T.StructType = AI_RESULTS
) -> DataFrame:
    """Read a results CSV with a header; texts may hold line ends. No type inference."""
    return (
        spark.read.schema(schema)
        .options(**_FORMAT, multiLine=True, ignoreLeadingWhiteSpace=False)
        .csv(path)
    )


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, pos, value): lines of all files, each read by the task whose split it starts in."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        # grows along a split, which one task reads in order
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, split, number, record) of CSV lines; ``number`` counts the records of a file from 1.

    A line end ends a record if an even number of quotes stands before it in the file; doubled quotes
    inside a field keep that number even. Each split is read once and told how many quotes stand before each of its
    lines in the split. The quotes of all splits before, one number per split, decide which of its lines open
    records. Lines ahead of a split's first record belong to the last record before the split.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    of_split = Window.partitionBy("file", "split")
    ahead = of_split.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    odd = (F.coalesce(F.sum(quotes).over(ahead), F.lit(0)) % 2).cast("int")
    keys = ["file", "split"]
    counted = deal_by(lines, keys).select(
        "file", "split", "pos", "value", F.col("value").endswith("\r").alias("cr"),
        quotes.cast("bigint").alias("quotes"), odd.alias("odd"),
    )
    local = store_by(counted, keys, [*keys, "pos"], dealt=True)

    def either(value: Column) -> Column:
        """A value of the lines that open records where the split starts outside (0) or inside (1) quotes."""
        return F.when(F.col("inside") == 0, value[0]).otherwise(value[1])

    def of(figure) -> list[Column]:
        return F.array(*[figure(F.col("odd") == side) for side in (0, 1)])

    splits = local.groupBy("file", "split").agg(
        F.sum("quotes").alias("quotes"),
        of(F.count_if).alias("opened"),
        of(lambda opens: F.min(F.when(opens, F.col("pos")))).alias("first"),
        F.min_by("cr", "pos").alias("cr"),
    )
    # a file whose first line ends with a carriage return has it at all its line ends
    of_file = Window.partitionBy("file").orderBy("split")
    splits = splits.withColumn("crlf", F.first("cr").over(of_file))
    splits = slice_starts(splits, "file", "split", "quotes", keep=["opened", "first", "crlf"])
    splits = splits.withColumn("inside", (F.col("quotes_start") % 2).cast("int"))
    splits = splits.select(
        "file", "split", "inside", "crlf",
        either(F.col("opened")).alias("records"),
        either(F.col("first")).alias("first"),
    )
    splits = slice_starts(splits, "file", "split", "records", keep=["inside", "crlf", "records", "first"])
    splits = splits.withColumn("last", F.col("records_start") + F.col("records"))

    value = F.when(F.col("crlf") & F.col("cr"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    is_ahead = F.col("first").isNull() | (F.col("pos") < F.col("first"))
    rests = (
        local.join(splits.withColumnRenamed("records_start", "owner"), ["file", "split"])
        .where(is_ahead & (F.col("owner") > 0))
        .groupBy("file", F.col("owner").alias("last"))
        .agg(F.array_sort(F.collect_list(F.struct("split", "pos", value.alias("value")))).alias("rest"))
        .withColumn("rest", F.transform("rest", lambda r: r.value))
    )
    placed = splits.where("records > 0").join(rests, ["file", "last"], "left").select(
        "file", "split", "inside", "crlf", "records_start", "first", "last", "rest"
    )
    opens = (F.col("odd") == F.col("inside")).cast("bigint")
    nth = F.sum(opens).over(of_split.orderBy("pos"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("value")))), lambda r: r.value)
    return (
        local.join(placed, ["file", "split"])
        .where(F.col("pos") >= F.col("first"))
        .withColumn("number", F.col("records_start") + nth)
        .groupBy("file", "split", "number")
        .agg(
            own.alias("own"),
            F.any_value(F.when(F.col("number") == F.col("last"), F.col("rest"))).alias("rest"),
        )
        .select(
            "file",
            "split",
            "number",
            F.array_join(F.concat("own", F.coalesce("rest", F.array().cast("array<string>"))), "\n").alias("record"),
        )
    )


def read_results_csv_split(
    spark: SparkSession, path: str, schema: T.StructType = AI_RESULTS
) -> DataFrame:
    """Like ``read_results_csv``, with each file read by many tasks; the result does not depend on the splits.

    Reading runs at once. Quotes must be balanced, that is, fields that hold one are quoted.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {k: str(v).lower() for k, v in {**_FORMAT, **_EXACT, "header": False}.items()}
    record = F.col("record")
    rows = csv_records(scan_lines(spark, path)).where((F.col("number") > 1) & (F.trim(record) != ""))
    return rows.select(F.from_csv(record, fields, options).alias("row")).select("row.*")


#: Tells spreadsheets that a file is UTF-8; it stands ahead of the header in each file.
BYTE_ORDER_MARK = "\ufeff"


def write_results_csv(
    results: DataFrame, path: str, mode: str = "errorifexists", byte_order_mark: bool = True
) -> None:
    """Write a results table as CSV parts with a header each, marked as UTF-8 for spreadsheets.

    The mark is written as the first character of the header, so Spark's own writer and its commit
    protocol make the files, on any file system.
    """
    if byte_order_mark and results.columns:
        results = results.withColumnRenamed(results.columns[0], BYTE_ORDER_MARK + results.columns[0])
    results.write.mode(mode).options(**_FORMAT, **_EXACT).csv(path)
