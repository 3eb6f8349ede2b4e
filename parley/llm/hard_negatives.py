"""Hard negatives by vertical scans in branch-and-bound order (BOND).

Vectors become integers, floor(scale * x). Rows are stored in blocks of BLOCK whose components lie
column by column, with the least and largest value of each column. Anchors are stored in blocks
as well, and every block of anchors meets every block of rows: anchors are copied to each GROUP of row
blocks and joined on the group, so no side is broadcast and a task holds one pair of blocks at a time.

For an anchor the columns of a block are read in descending order of the anchor's magnitudes. After
every STEP columns each candidate's score lies between its partial score plus the least and plus the
largest contribution that the unread columns can make; candidates that cannot reach the result leave the
candidate bitmap. Two passes:

1. positives: rows of the anchor's label. Out are those whose upper bound lies below the
   ``positives``-th largest lower bound.
2. negatives: rows of another label, for the score windows of all positives at once. A candidate is
   out where, for every window, its bounds miss the window or its upper bound lies below the
   ``negatives``-th largest lower bound of those sure to lie inside.

What is left after the last column has its exact score. Both passes send the best rows of a pair
of blocks on; a ranking by anchor makes them the best of the table. Results are exact.

Rows with a null vec_id, label or vector, or a null or non-finite component take no part. Shorter
vectors count as ended by zeros. Equal scores go by the smaller vec_id; rows are told apart by their
stored place, so a repeated row is another row, and a repeated anchor gives its lines again. An empty table, or one without
anchors, gives no rows. An error is raised where inner products would not fit a long. Only the columns
vec_id, label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.centroids import ROW_GROUP, finite, integers
from parley.llm.shared import numbered, stored

BLOCK = 1 << 12
ANCHORS = 1 << 9
#: Blocks of rows that share one copy of the anchors; with few blocks each has its own.
GROUP, LEAST_GROUPS = 16, 64
STEP = 8
LARGEST = 1 << 62
BLOCKS = "ids array<long>, places array<long>, labels array<int>, columns binary, dimensions int"
PAIR = "anchor int, id long, place long, score long, anchor_id long, anchor_place long"


def is_multiple(of: int) -> Column:
    return F.col("vec_id") % of == 0


def shifted_label(label: Column, every: int = 7, classes: int = 10) -> Column:
    """Labels made wrong on purpose: one further where vec_id is divisible by ``every``."""
    return F.when(is_multiple(every), (label + 1) % classes).otherwise(label)


def vertical(rows: DataFrame, dimensions: int, size: int, name: str) -> DataFrame:
    """Stored blocks of rows (vec_id, _row, label, v), columns one after the other, numbered by `block`."""

    def block(table: pa.Table) -> pa.RecordBatch:
        lists = table.column("v").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        matrix = np.zeros((len(lists), dimensions), "i8")
        matrix[np.arange(dimensions) < lengths[:, None]] = lists.flatten().to_numpy()
        small = not matrix.size or np.abs(matrix).max() < 1 << 15
        columns = np.ascontiguousarray(matrix.T).astype("i2" if small else "i8")
        return pa.RecordBatch.from_arrays(
            [
                *(
                    pa.ListArray.from_arrays([0, table.num_rows], table.column(c).combine_chunks())
                    for c in ("vec_id", "_row", "label")
                ),
                pa.array([columns.tobytes()], pa.binary()),
                pa.array([dimensions], pa.int32()),
            ],
            names=["ids", "places", "labels", "columns", "dimensions"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= size:
                yield block(held.slice(0, size))
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield block(held)

    blocks = rows.select("vec_id", "_row", F.col("label").cast("int"), "v").mapInArrow(run, BLOCKS)
    return stored(blocks.withColumn("block", F.monotonically_increasing_id()), name, **ROW_GROUP)


class Block:
    """One block in a task: ids, places, labels and columns."""

    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str):
        def take(name: str) -> pa.Scalar:
            return batch.column(prefix + name)[i]

        self.ids, self.places, self.labels = (
            take(x).values.to_numpy(False) for x in ("ids", "places", "labels")
        )
        data, dimensions = take("columns").as_py(), take("dimensions").as_py()
        wide = len(data) == 8 * len(self.ids) * dimensions
        self.columns = np.frombuffer(data, "i8" if wide else "i2").reshape(dimensions, len(self.ids))
        if dimensions:
            self.ends = self.columns.min(1).astype("i8"), self.columns.max(1).astype("i8")
        else:
            self.ends = np.zeros(0, "i8"), np.zeros(0, "i8")


def best(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Places in the arrays of the n first by score, id and place."""
    return np.lexsort((places, ids, -scores))[:n]


def kth(values: np.ndarray, k: int) -> int | None:
    """The k-th largest value."""
    return np.partition(values, len(values) - k)[-k] if len(values) >= k else None


def scan(
    block: Block, anchor: np.ndarray, alive: np.ndarray, useful: Callable[..., np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that stay when all columns are read, and their exact scores.

    ``useful(lower, upper)`` tells which candidates may still be wanted.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * end for end in block.ends])[:, order]
    rest = np.zeros((2, len(order) + 1), "i8")
    rest[:, :-1] = np.stack([ends.min(0), ends.max(0)])[:, ::-1].cumsum(1)[:, ::-1]
    reach = (np.abs(anchor) * np.maximum(*map(np.abs, block.ends))).sum() if len(order) else 0
    kind = "i4" if reach < 1 << 30 else "i8"
    weights, partial = anchor.astype(kind), np.zeros(len(alive), kind)
    for start in range(0, len(order), STEP):
        for d in order[start : start + STEP].tolist():
            if weights[d]:
                column = block.columns[d]
                partial += weights[d] * (column if len(alive) == len(column) else column[alive])
        read = min(start + STEP, len(order))
        if read == len(order) or not len(alive):
            break
        stays = useful(partial + rest[0, read], partial + rest[1, read])
        if not stays.all():
            alive, partial = alive[stays], partial[stays]
    return alive, partial.astype("i8")


def nearest_of_label(block: Block, anchors: Block, n: int) -> Iterator[tuple]:
    """Best rows of each anchor's label in a block: (anchor, candidate, score)."""
    members = {label: np.flatnonzero(block.labels == label) for label in np.unique(anchors.labels).tolist()}

    def useful(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        least = kth(lower, n)
        return np.ones(len(lower), bool) if least is None else upper >= least

    for a, label in enumerate(anchors.labels.tolist()):
        alive = members[label][block.places[members[label]] != anchors.places[a]]
        alive, scores = scan(block, anchors.columns[:, a].astype("i8"), alive, useful)
        first = best(scores, block.ids[alive], block.places[alive], n)
        yield from ((a, int(alive[i]), int(scores[i])) for i in first.tolist())


def nearest_in_windows(block: Block, anchors: Block, windows: dict[int, np.ndarray], n: int) -> Iterator[tuple]:
    """Best rows of other labels in each window (least, largest): (anchor, window, candidate, score)."""
    for a, limits in windows.items():
        least, largest = limits[:, :1], limits[:, 1:]

        def useful(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            wanted = np.zeros(len(lower), bool)
            for low, high in limits.tolist():
                sure = kth(lower[(lower >= low) & (upper <= high)], n)
                wanted |= (upper >= (low if sure is None else max(low, sure))) & (lower <= high)
            return wanted

        alive = np.flatnonzero(block.labels != anchors.labels[a])
        alive, scores = scan(block, anchors.columns[:, a].astype("i8"), alive, useful)
        inside = (scores >= least) & (scores <= largest)
        for w in range(len(limits)):
            found = np.flatnonzero(inside[w])
            first = found[best(scores[found], block.ids[alive[found]], block.places[alive[found]], n)]
            yield from ((a, w, int(alive[i]), int(scores[i])) for i in first.tolist())


def paired(blocks: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Every block of rows with every block of anchors (columns a_...), dealt out by groups of row blocks."""
    spread = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).drop("block")
    copies = anchors.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"),
        *[F.col(c).alias(f"a_{c}") for c in anchors.columns],
    )
    # anchors come first, so a task reads one block of them against all its row blocks in turn
    return copies.hint("merge").join(spread, "group").drop("group")


def lines(batch: pa.RecordBatch, found: Iterable[tuple], block: Block, anchors: Block) -> dict[str, np.ndarray]:
    """Columns anchor, id, place, score, anchor_id, anchor_place of (anchor, ..., candidate, score)."""
    table = np.array(list(found), "i8")
    table = table.reshape(len(table), -1 if len(table) else 4)
    a, c = table[:, 0], table[:, -2]
    return {
        "anchor": a.astype("i4"),
        "id": block.ids[c],
        "place": block.places[c],
        "score": table[:, -1],
        "anchor_id": anchors.ids[a],
        "anchor_place": anchors.places[a],
        "window": table[:, 1].astype("i4"),
    }


def best_positives(pairs: DataFrame, n: int) -> DataFrame:
    """(a_block, anchor, n_th, id, score, anchor_id, anchor_place): the n best rows of each anchor's label."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, anchors = Block(batch, i, ""), Block(batch, i, "a_")
                table = lines(batch, nearest_of_label(block, anchors, n), block, anchors)
                number = np.full(len(table["anchor"]), batch.column("a_block")[i].as_py(), "i8")
                columns = [pa.array(number), *(pa.array(table[x.split()[0]]) for x in PAIR.split(", "))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["a_block", *(x.split()[0] for x in PAIR.split(", "))]
    first = Window.partitionBy("anchor_place").orderBy(F.desc("score"), "id", "place")
    ranked = pairs.mapInArrow(run, f"a_block long, {PAIR}").withColumn("n_th", F.row_number().over(first))
    return ranked.where(F.col("n_th") <= n)


def best_negatives(pairs: DataFrame, n: int) -> DataFrame:
    """The n best rows of other labels for each (anchor, window) of pairs with the column a_windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, anchors = Block(batch, i, ""), Block(batch, i, "a_")
                windows: dict[int, list] = {}
                for w in batch.column("a_windows")[i].as_py():
                    windows.setdefault(w["anchor"], []).append(w)
                limits = {a: np.array([[w["least"], w["largest"]] for w in ws], "i8") for a, ws in windows.items()}
                table = lines(batch, nearest_in_windows(block, anchors, limits, n), block, anchors)
                of = [windows[a][w] for a, w in zip(table["anchor"].tolist(), table["window"].tolist())]
                columns = [pa.array(table[x.split()[0]]) for x in PAIR.split(", ")]
                columns += [pa.array([w[c] for w in of], pa.int64()) for c in ("positive_id", "positive_score")]
                columns.append(pa.array([w["n_th"] for w in of], pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{PAIR}, positive_id long, positive_score long, n_th int"
    names = [x.split()[0] for x in schema.split(", ")]
    first = Window.partitionBy("anchor_place", "n_th").orderBy(F.desc("score"), "id", "place")
    ranked = pairs.mapInArrow(run, schema).withColumn("rank", F.row_number().over(first))
    return ranked.where(F.col("rank") <= n)


def mine(
    vectors: DataFrame,
    anchors_every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    scale: int = 256,
    least_percent: int = 50,
    largest_percent: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose vec_id is divisible by ``anchors_every``. A negative's score lies between
    the two percentages of its positive's. Blocks and positives are computed and stored at once.
    """
    spark, vector = vectors.sparkSession, F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & finite(vector)
    rows = numbered(
        vectors.where(usable).select(F.col("vec_id").cast("long"), F.col("label").cast("int"), integers(vector, scale).alias("v")),
        "vectors",
    )
    largest = F.greatest(F.max(F.array_max("v")), -F.min(F.array_min("v")))
    ends = rows.agg(
        F.max(F.size("v")).alias("dimensions"),
        largest.alias("largest"),
        F.count_if(is_multiple(anchors_every)).alias("anchors"),
    ).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if ends.dimensions is None:
        return spark.createDataFrame([], out)
    if ends.dimensions * (ends.largest or 0) ** 2 * 100 >= LARGEST:
        raise ValueError("inner products of these vectors do not fit a long")

    blocks = vertical(rows, ends.dimensions, BLOCK, "blocks")
    asking = rows.where(is_multiple(anchors_every)).repartition(-(-max(ends.anchors, 1) // ANCHORS))
    anchors = vertical(asking, ends.dimensions, ANCHORS, "anchors")
    n_blocks = blocks.select("block").count()
    groups = max(n_blocks // GROUP, min(n_blocks, LEAST_GROUPS))
    nearest = best_positives(paired(blocks, anchors, groups), positives)
    found = stored(nearest.select("a_block", "anchor", "n_th", "id", "score"), "positives")

    score = F.col("score")
    windows = found.select(
        F.col("a_block").alias("block"),
        F.struct(
            "anchor",
            "n_th",
            F.col("id").alias("positive_id"),
            score.alias("positive_score"),
            F.ceil(score * least_percent / F.lit(100).cast("decimal(3,0)")).cast("long").alias("least"),
            F.floor(score * largest_percent / F.lit(100).cast("decimal(3,0)")).cast("long").alias("largest"),
        ).alias("window"),
    )
    # a block of anchors has at most ANCHORS * positives windows
    by_block = windows.groupBy("block").agg(F.sort_array(F.collect_list("window")).alias("windows"))
    mined = best_negatives(paired(blocks, anchors.join(by_block, "block"), groups), negatives)
    return mined.select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
