"""Exact nearest rows for many questions, through clusters that can be skipped.

Rows are assigned to the nearest of some pivots and stored by cluster. Each cell, a cluster of one chat, keeps its number of
rows, its radius around the pivot and the least and largest length of its vectors. From these, the inner
product of a question with any row of a cell lies between two bounds: by the triangle inequality on
distances, and by |q . x - q . p| <= |q| |x - p|. Cells with high lower bounds that hold k rows together give a
score that the k-th best row reaches at least; cells whose upper bound lies below it are not read. What is read meets the questions
block by block in matrix products. Results equal a full scan.

Questions are a table. They meet the cells in groups through an equi-join, which Spark broadcasts or shuffles by
its size, so their number is not limited by memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vectors as vec
from ..storage import shared_dir

CLUSTERS = 64
MOST_CLUSTERS = 1024
#: Pivots are fitted to a bounded sample of distinct vectors, those of the smallest hashes.
SAMPLE, MOST_SAMPLED, ROUNDS = 32, 1 << 14, 5
QUESTIONS_AT_ONCE = 64
#: Rows of a cell and questions that meet as one pair.
BLOCK, QUESTIONS_IN_GROUP = 1 << 13, 1 << 9
#: What rounding of sums in double precision may add to a bound.
SLACK = 1e-9


@dataclass
class ClusteredIndex:
    """`rows` with columns cluster and to_pivot, in folders by cluster; `cells` with one row per chat and cluster."""

    rows: DataFrame
    cells: DataFrame
    by: str
    vector: str


def _length(vector: Column) -> Column:
    return F.sqrt(vec.dot(vector, vector))


def _squares(matrix: np.ndarray, points: np.ndarray) -> np.ndarray:
    return (matrix**2).sum(1)[:, None] - 2 * matrix @ points.T + (points**2).sum(1)


def _pivots(rows: DataFrame, vector: str, clusters: int) -> np.ndarray:
    """Pivots fitted to a sample: points far from each other first, then a few rounds of their means."""
    vectors = rows.select(F.col(vector).cast("array<double>").alias("v")).distinct()
    sample = vectors.orderBy(F.xxhash64("v"), "v").limit(min(SAMPLE * clusters, MOST_SAMPLED)).toArrow()
    column = sample.column("v").combine_chunks()
    if not len(column):
        return np.zeros((1, 1))
    matrix = column.flatten().to_numpy().reshape(len(column), -1)
    chosen, apart = [0], _squares(matrix, matrix[:1])[:, 0]
    while len(chosen) < min(clusters, len(matrix)):
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, _squares(matrix, matrix[chosen[-1:]])[:, 0])
    points = matrix[chosen]
    for _ in range(ROUNDS):
        nearest = _squares(matrix, points).argmin(1)
        for i in np.unique(nearest):
            points[i] = matrix[nearest == i].mean(0)
    return points


def _assigned(vector: Column, pivots: np.ndarray) -> Column:
    """struct(cluster, to_pivot, length) of a vector column."""

    @F.pandas_udf("cluster int, to_pivot double, length double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        matrix = np.array(vectors.tolist(), "f8").reshape(len(vectors), pivots.shape[1])
        cluster = _squares(matrix, pivots).argmin(1)
        to_pivot = np.sqrt(((matrix - pivots[cluster]) ** 2).sum(1))
        length = np.sqrt((matrix**2).sum(1))
        return pd.DataFrame({"cluster": cluster.astype("i4"), "to_pivot": to_pivot, "length": length})

    return nearest(vector.cast("array<double>"))


def cluster_index(
    index: DataFrame, by: str = "chat_id", vector: str = "vector", clusters: int = CLUSTERS, path: str | None = None
) -> ClusteredIndex:
    """Store an index by cluster; runs at once. All vectors have the same number of components.

    Pivots travel as a constant, so their number is limited to MOST_CLUSTERS.
    """
    if not 1 <= clusters <= MOST_CLUSTERS:
        raise ValueError(f"between 1 and {MOST_CLUSTERS} clusters")
    spark = index.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/clusters-{uuid.uuid4().hex}"
    pivots = _pivots(index, vector, clusters)
    rows = index.withColumn("_place", _assigned(F.col(vector), pivots)).select(*index.columns, "_place.*")
    # ranges of hashes inside a cluster: a large cluster is written by several tasks
    dealt = rows.repartitionByRange("cluster", F.xxhash64(by, vector))
    dealt.write.partitionBy("cluster").parquet(f"{path}/rows")
    return open_index(spark, path, rows.schema, by, vector, pivots)


def open_index(spark: SparkSession, path: str, schema, by: str, vector: str, pivots: np.ndarray) -> ClusteredIndex:
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    points = F.array(*[vec.literal(p) for p in pivots.tolist()])
    cells = (
        rows.groupBy(by, "cluster")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("to_pivot").alias("radius"),
            F.min("length").alias("shortest"),
            F.max("length").alias("longest"),
        )
        .withColumn("pivot", F.get(points, F.col("cluster")))
    )
    cells.write.parquet(f"{path}/cells")
    return ClusteredIndex(rows, spark.read.schema(cells.schema).parquet(f"{path}/cells"), by, vector)


def _reach(near: Column, far: Column, length: Column, shortest: Column, longest: Column, product: Column, radius: Column):
    """Lower and upper bound of q . x for |x - p| <= radius and lengths in a range.

    `near` and `far` are the least and largest distance of q and x, `product` is q . p.
    """
    by_distance = lambda size, gap: (length * length + size * size - gap * gap) / 2
    upper = F.least(by_distance(longest, near), product + length * radius)
    lower = F.greatest(by_distance(shortest, far), product - length * radius)
    return lower - SLACK, upper + SLACK


def bounds(index: ClusteredIndex, questions: DataFrame, k: int, key: str = "question_id") -> DataFrame:
    """(key, by, cluster, n, q, length, product, to_q, floor, wanted): each question against each cell.

    `floor` is a score that the k-th best row of the chat reaches; cells not `wanted` hold none of the k best.
    """
    asked = questions.select(F.col(key), F.col("vector").cast("array<double>").alias("q"))
    groups = questions.count() // QUESTIONS_AT_ONCE + 1
    asked = asked.withColumn("length", _length(F.col("q"))).withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)))
    spread = index.cells.withColumn(
        "_group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))
    )
    met = spread.join(asked, "_group").withColumn("product", vec.dot(F.col("q"), F.col("pivot")))
    gap = F.zip_with("q", "pivot", lambda a, b: a - b)
    met = met.withColumn("to_q", _length(gap))
    near = F.greatest(F.col("to_q") - F.col("radius"), F.lit(0.0))
    lower, upper = _reach(
        near, F.col("to_q") + F.col("radius"), F.col("length"), F.col("shortest"), F.col("longest"),
        F.col("product"), F.col("radius"),
    )
    best = Window.partitionBy(key, index.by).orderBy(F.desc("lower"), "cluster")
    chat = Window.partitionBy(key, index.by)
    met = met.withColumns({"lower": lower, "upper": upper}).withColumn("_ahead", F.sum("n").over(best))
    floor = F.max(F.when(F.col("_ahead") >= k, F.col("lower"))).over(chat)
    return met.withColumn("floor", F.coalesce(floor, F.lit(float("-inf")))).select(
        key, index.by, "cluster", "n", "q", "length", "product", "to_q", "floor",
        (F.col("upper") >= F.col("floor")).alias("wanted"),
    )


def _block_best(batch: pa.RecordBatch, i: int, vector: str, k: int, tie: str):
    """(question places, row places, scores) of pair i: the k best rows of its block for each of its questions.

    A matrix product, rounded otherwise than ``vec.dot``, only tells which rows may be among the k best. Their scores are then
    summed component by component as ``vec.dot`` sums them. NaN comes first and null last, as Spark orders scores.
    """
    rows, asked = batch.column("rows")[i].values, batch.column("asked")[i].values
    places = pc.sort_indices(rows.field(tie), null_placement="at_start").to_numpy()
    lists, questions = rows.field(vector).take(pa.array(places)), asked.field("q")
    flat, flat_q = lists.flatten(), questions.flatten()
    x = flat.to_numpy(False).astype("f8").reshape(len(lists), -1)
    q = flat_q.to_numpy(False).astype("f8").reshape(len(questions), -1)
    null_x = flat.is_null().to_numpy(False).reshape(x.shape).any(1)
    null_q = flat_q.is_null().to_numpy(False).reshape(q.shape).any(1)
    # of equal vectors only the first k by tie can be wanted
    if len(x) > k and x.shape[1]:
        _, same = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)
        order = np.lexsort((np.arange(len(x)), null_x, same))
        group = same[order] * 2 + null_x[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        nth = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
        kept = np.sort(order[nth < k])
        x, null_x, places = x[kept], null_x[kept], places[kept]
    if np.isfinite(x).all() and np.isfinite(q).all():
        near = q @ x.T
        gap = SLACK + 1e-12 * np.abs(q).sum(1) * (np.abs(x).max() if x.size else 0.0)
        least = asked.field("floor").to_numpy(False) - gap
        if len(x) > k:
            least = np.maximum(least, np.partition(near, len(x) - k, axis=1)[:, len(x) - k] - gap)
        one, row = np.nonzero(near >= least[:, None])
    else:
        one, row = (each.ravel() for each in np.indices((len(q), len(x))))
    scores = np.zeros(len(one))
    for d in range(x.shape[1]):
        scores += q[one, d] * x[row, d]
    kind = np.where(null_q[one] | null_x[row], 2, np.where(np.isnan(scores), 0, 1))
    order = np.lexsort((row, np.where(kind == 1, -scores, 0.0), kind, one))
    one, row, scores, kind = one[order], row[order], scores[order], kind[order]
    starts = np.flatnonzero(np.diff(one, prepend=-1))
    nth = np.arange(len(one)) - np.repeat(starts, np.diff(np.append(starts, len(one))))
    first = nth < k
    return one[first], places[row[first]], pa.array(scores[first], mask=kind[first] == 2)


def nearest_each(
    index: ClusteredIndex, questions: DataFrame, k: int, tie: str, key: str = "question_id"
) -> DataFrame:
    """The k rows of each chat nearest to each question (key, vector), exact.

    Adds the key, `semantic_score` and `semantic_rank` to the rows of the index. Rows of a cell are dealt into blocks, questions
    into groups; each group meets the blocks of the cells that one of its questions wants, a pair at a time, and the best
    rows of each pair are ranked. So a row is not copied for each question, and a question only for each block.
    """
    columns = [c for c in index.rows.columns if c not in ("cluster", "to_pivot", "length")]
    cell, by, vector = [index.by, "cluster"], index.by, index.vector
    wanted = bounds(index, questions, k, key).where("wanted").select(key, *cell, "n", "q", "floor")
    parts = F.ceil(F.col("n") / BLOCK).cast("long")
    groups = questions.count() // QUESTIONS_IN_GROUP + 1
    live = wanted.groupBy(*cell).agg(F.max(parts).alias("_parts"))
    dealt = index.rows.join(live, cell).withColumn("_block", F.pmod(F.xxhash64(tie, vector), F.col("_parts")))
    blocks = dealt.groupBy(*cell, "_block").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    asked = (
        wanted.groupBy(*cell, F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group"))
        .agg(F.collect_list(F.struct(key, "q", "floor")).alias("asked"), F.max(parts).alias("_parts"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    )
    pairs = asked.join(blocks, [*cell, "_block"]).select("asked", "rows")
    kept = index.rows.select(*columns).schema.fields
    out = T.StructType([T.StructField(key, questions.schema[key].dataType), *kept, T.StructField("semantic_score", T.DoubleType())])

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, row, scores = _block_best(batch, i, vector, k, tie)
                keys = batch.column("asked")[i].values.field(key).take(pa.array(one))
                found = batch.column("rows")[i].values.take(pa.array(row))
                arrays = [keys, *(found.field(c) for c in columns), scores]
                yield pa.RecordBatch.from_arrays(arrays, names=out.fieldNames())

    first = Window.partitionBy(key, by).orderBy(F.desc("semantic_score"), tie)
    return (
        pairs.mapInArrow(best, out)
        .withColumn("semantic_rank", F.row_number().over(first))
        .where(F.col("semantic_rank") <= k)
        .select(key, *columns, "semantic_score", "semantic_rank")
    )


def rows_read(index: ClusteredIndex, questions: DataFrame, k: int, key: str = "question_id") -> DataFrame:
    """(key, rows, read): rows of the index and of the cells that each question reads."""
    read = F.sum(F.when(F.col("wanted"), F.col("n")).otherwise(0))
    return bounds(index, questions, k, key).groupBy(key).agg(F.sum("n").alias("rows"), read.alias("read"))
