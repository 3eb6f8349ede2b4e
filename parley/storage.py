"""Where intermediate tables are kept: the shared checkpoint folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where none is named, a session of one machine gets a temporary folder; on a cluster an error
    is raised, because executors would not see each other's files.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
    return folder


def materialize(rows: DataFrame) -> DataFrame:
    """Compute a table now and cut its lineage by a reliable checkpoint."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint()


def deal_by(rows: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Rows dealt out over tasks by some columns as ``store_by`` deals them into buckets.

    Windows and aggregations by these columns then need no further exchange, and neither does storing their result.
    """
    return rows.repartition(buckets or bucket_count(rows.sparkSession), *keys)


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a stored table: the session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store_by(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    path: str | None = None,
    buckets: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Write a table in buckets by some columns, each sorted, and read it back as such.

    Joins and aggregations by exactly these columns then need no exchange on its side. ``dealt`` tells that the
    rows come from ``deal_by`` with the same columns and buckets; ``open_by`` reads the folder again.
    """
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/buckets-{uuid.uuid4().hex}"
    buckets = buckets or bucket_count(spark)
    name = f"stored_{uuid.uuid4().hex}"
    # dealt out like the buckets, so that every task writes its own bucket as one file
    parts = rows if dealt else deal_by(rows, keys, buckets)
    parts.write.format("parquet").bucketBy(buckets, *keys).sortBy(*order).option("path", path).saveAsTable(name)
    return spark.table(name)


def open_by(spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """A folder written by ``store_by``, in another session; `schema` is its DDL."""
    name = f"stored_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(keys)}) "
        f"SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
