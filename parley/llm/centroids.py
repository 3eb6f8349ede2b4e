"""Centroid clustering over dictionaries of subvectors.

Vectors become integers, floor(scale * x), and are kept in chunks of CHUNK rows. The dimensions of
a chunk are cut into blocks of ``width``; each block is encoded without loss as a dictionary of its
distinct subvectors and one code per vector. A round computes the exact squared distance of
every dictionary entry to every centroid once, and a vector's distance is the sum of the
entries that its codes name. New centroids come from the same dictionaries: how often a cluster uses an
entry, times the entry. All arithmetic is on integers, so results don't depend on the order of rows.

A dictionary belongs to its chunk, so its size is bounded whatever the table holds, nothing is
broadcast but the centroids, and a lost task reads its chunks again. Between rounds only the sums
of ``k`` clusters reach the driver.

A vector that is null, has another number of components, or a null or non-finite one is left out.
Repeated rows are vectors each; equal hashes (repeated ids) start in order of their components, a
null vec_id starts last and is kept. With fewer vectors than ``k`` there are fewer centroids; an
empty table gives no rows. Integer components beyond 2**20 raise an error, since their distances
don't fit a long. Only the columns vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import stored

CHUNK = 1 << 14
#: Components at most so large keep the summed distances of a chunk within a long.
LARGEST = 1 << 20
ENCODED = "ids array<long>, codes binary, entries binary, sizes array<int>"
ASSIGNED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
ROW_GROUP = {"parquet.block.size": str(16 << 20), "compression": "zstd"}


def finite(vector: Column) -> Column:
    """True for vectors without a null or non-finite component."""
    size = F.lit(float("inf"))
    return F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < size)
    )


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def dictionary(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a block and the code of each row."""
    codes = np.zeros(len(block), "i8")
    for column in block.T:
        values, place = np.unique(column, return_inverse=True)
        _, first, codes = np.unique(codes * len(values) + place, return_index=True, return_inverse=True)
    return block[first], codes


def encoded(rows: DataFrame, dimensions: int, width: int) -> DataFrame:
    """Stored chunks of rows (vec_id, v): ids, codes by block, dictionary entries and their number."""

    def chunk(table: pa.Table) -> pa.RecordBatch:
        vectors = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dimensions)
        if len(vectors) and max(vectors.max(), -vectors.min()) > LARGEST:
            raise ValueError(f"a component exceeds {LARGEST} after scaling")
        blocks = [dictionary(vectors[:, at : at + width]) for at in range(0, dimensions, width)]
        sizes = [len(entries) for entries, _ in blocks]
        codes = np.concatenate([c for _, c in blocks]).astype("u2" if max(sizes) <= 1 << 16 else "u4")
        entries = np.concatenate([e.ravel() for e, _ in blocks]).astype("i4")
        ids = table.column("vec_id").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays([0, len(ids)], ids),
                pa.array([codes.tobytes()], pa.binary()),
                pa.array([entries.tobytes()], pa.binary()),
                pa.array([sizes], pa.list_(pa.int32())),
            ],
            names=["ids", "codes", "entries", "sizes"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= CHUNK:
                yield chunk(held.slice(0, CHUNK))
                held = held.slice(CHUNK)
        if held is not None and held.num_rows:
            yield chunk(held)

    return stored(rows.mapInArrow(run, ENCODED), "subvectors", **ROW_GROUP)


def assign(row: dict, centroids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Cluster and distance of each vector of a chunk, and its (codes, entries) by block."""
    sizes, n = row["sizes"], row["n"]
    kind = "u2" if max(sizes) <= 1 << 16 else "u4"
    codes = np.frombuffer(row["codes"], kind).reshape(len(sizes), n)
    entries, blocks, at = np.frombuffer(row["entries"], "i4").astype("i8"), [], 0
    distances = np.zeros((n, len(centroids)), "i8")
    for i, size in enumerate(sizes):
        centers = centroids[:, i * width : (i + 1) * width]
        block = entries[at : at + size * centers.shape[1]].reshape(size, -1)
        at += block.size
        partial = ((block[:, None, :] - centers) ** 2).sum(2)
        distances += partial[codes[i]]
        blocks.append((codes[i], block))
    cluster = distances.argmin(1)
    return cluster, distances[np.arange(n), cluster], blocks


def chunk_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Chunks of a batch as dictionaries; ids stay an Arrow array."""
    for i in range(batch.num_rows):
        ids = batch.column("ids")[i].values
        row = {name: batch.column(name)[i].as_py() for name in ("codes", "entries", "sizes")}
        yield row | {"ids": ids, "n": len(ids)}


def totals(chunks: DataFrame, centroids: np.ndarray, width: int) -> dict[int, dict[int, int]]:
    """By cluster: sums of each component, number (-1) and summed distance (-2), exact."""
    k, dimensions = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in chunk_rows(batch):
                cluster, distance, blocks = assign(row, centroids, width)
                inertia = np.zeros(k, "i8")
                np.add.at(inertia, cluster, distance)
                columns = [np.bincount(cluster, minlength=k)[:, None], inertia[:, None]]
                for codes, entries in blocks:
                    cells = cluster * len(entries) + codes
                    used = np.bincount(cells, minlength=k * len(entries)).reshape(k, -1)
                    columns.append(used @ entries)
                place = np.concatenate([[-1, -2], np.arange(dimensions)])
                present = np.flatnonzero(columns[0][:, 0])
                values = np.hstack(columns)[present]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(present, len(place)).astype("i4")),
                        pa.array(np.tile(place, len(present)).astype("i4")),
                        pa.array(values.ravel().astype("i8")),
                    ],
                    names=["cluster", "place", "value"],
                )

    parts = chunks.mapInArrow(run, "cluster int, place int, value long")
    sums = parts.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found: dict[int, dict[int, int]] = {}
    for row in sums.collect():  # k * (dimensions + 2) rows at most
        found.setdefault(row.cluster, {})[row.place] = int(row.value)
    return found


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``<seed>:<vec_id>``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(F.asc_nulls_last(order), "v").select("v").limit(k).collect()
    return np.array([r.v for r in first], "i8")


def cluster(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    scale: int = 64,
    dimensions: int = 64,
    width: int = 2,
    seed: str = "1",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Rounds run at once; each assigns all vectors to the nearest centroid (the smaller number of
    equal ones) and moves every centroid that has vectors to the floor of their mean.
    """
    spark, vector = vectors.sparkSession, F.col("embedding")
    whole = vectors.where(vector.isNotNull() & (F.size(vector) == dimensions) & finite(vector))
    rows = whole.select(F.col("vec_id").cast("long"), integers(vector, scale).alias("v"))
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], ASSIGNED)
    chunks = encoded(rows, dimensions, width)
    for _ in range(rounds):
        for number, sums in totals(chunks, centroids, width).items():
            centroids[number] = [sums[d] // sums[-1] for d in range(dimensions)]
    inertia = {number: sums[-2] for number, sums in totals(chunks, centroids, width).items()}
    own = np.array([inertia.get(i, 0) for i in range(len(centroids))], "i8")
    digests = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])
    overall = sum(inertia.values())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in chunk_rows(batch):
                number, distance, _ = assign(row, centroids, width)
                columns = [
                    row["ids"],
                    pa.array(number.astype("i4")),
                    pa.array(distance),
                    pa.array(own[number]),
                    pa.array(np.full(row["n"], overall, "i8")),
                    digests.take(pa.array(number)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ASSIGNED.split(", ")])

    return chunks.mapInArrow(run, ASSIGNED)
