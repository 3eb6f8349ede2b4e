"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased words of letters and digits; shingles are five words in a row, hashed. Windows
of an item's size get a SimHash of their shingles. Its 64 bits are cut into BLOCKS blocks; items are
indexed under all values within NEAR bits of each block, so every window within
BLOCKS * (NEAR + 1) - 1 bits of an item meets it in the index under at least one block. What meets
within that radius is verified: shared shingles over all shingles, both counted with repeats, must
reach the threshold.

Only windows that can pass are made: an item and a document must have at least the threshold's share
of the item's shingles in common, and a window must hold one of them. That loses nothing, since
other windows have a smaller similarity. A document shorter than the item is one window as a whole.

The benchmark's shingles and index are joined, and broadcast only as Spark finds them small. Null and
empty texts and items match nothing; items of fewer than five words match as a whole; repeated
rows of documents are reported each, repeated items too; a null doc_id or item_id is carried along.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import numbered, stored, unused

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS = 5
NEAR = 3
RADIUS = BLOCKS * (NEAR + 1) - 1
BITS = 64
#: Bits of a count, and the lowest bits of three counts in a long.
LANE = 21
LANES = 1 | 1 << LANE | 1 << 2 * LANE


def words(text: Column) -> Column:
    split = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(split, "")


def shingles(word_list: Column, width: int) -> Column:
    """Hashes of all runs of so many words."""
    places = F.sequence(F.lit(1), F.size(word_list) - width + 1)
    hashed = F.transform(places, lambda i: F.xxhash64(F.slice(word_list, i, width)))
    return F.when(F.size(word_list) >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def fingerprint(hashes: Column) -> Column:
    """Majority bits of hashes: three counts of 21 bits at a time, or each bit alone from 2**20 hashes on."""
    return F.when(F.size(hashes) < 1 << LANE - 1, lane_bits(hashes)).otherwise(single_bits(hashes))


def single_bits(hashes: Column) -> Column:
    """Majority bits of any number of hashes."""
    out, half = F.lit(0).cast("long"), F.floor(F.size(hashes) / 2)
    for shift in range(BITS):
        ones = F.aggregate(
            hashes,
            F.lit(0).cast("long"),
            lambda total, h: total + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(1)),
        )
        out = out.bitwiseOR(F.shiftleft((ones > half).cast("long"), shift))
    return out


def lane_bits(hashes: Column) -> Column:
    """Majority bits of fewer than 2**20 hashes."""
    out = F.lit(0).cast("long")
    more = F.floor(F.size(hashes) / 2).cast("long")
    for shift in [*range(LANE), BITS - 1]:
        lanes = LANES if shift < LANE else 1
        sums = F.aggregate(
            hashes,
            F.lit(0).cast("long"),
            lambda total, h: total + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(lanes)),
        )
        # a count's top bit is set once it is over half
        over = sums + (F.lit((1 << LANE - 1) - 1) - more) * F.lit(lanes)
        bits = F.shiftrightunsigned(over, LANE - 1).bitwiseAND(F.lit(lanes))
        out = out.bitwiseOR(F.shiftleft(bits, shift))
    return out


def blocks(value: Column) -> Column:
    """(block, value) for each block of the bits."""
    cuts = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return F.array(
        *(
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned(value, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"),
            )
            for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
        )
    )


def flips() -> list[int]:
    """Patterns of at most NEAR bits within the widest block."""
    width = -(-BITS // BLOCKS)
    return [
        sum(1 << i for i in chosen)
        for n in range(NEAR + 1)
        for chosen in combinations(range(width), n)
    ]


def prepared(items: DataFrame) -> DataFrame:
    """Stored (item, item_id, size, width, hashes, fp) of items with a word; item numbers rows."""
    rows = items.select("item_id", words(F.col("text")).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("size", F.size("words"))
    five = rows.where(F.col("size") >= SHINGLE).select(
        "item_id", "size", F.lit(SHINGLE).alias("width"), shingles(F.col("words"), SHINGLE).alias("hashes")
    )
    fewer = rows.where(F.col("size") < SHINGLE).select(
        "item_id", "size", F.col("size").alias("width"), F.array(F.xxhash64("words")).alias("hashes")
    )
    both = five.union(fewer).withColumn("item", F.monotonically_increasing_id())
    return stored(both.withColumn("fp", fingerprint(F.col("hashes"))), "items")


def similarity(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes, both with repeats."""

    def count(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda y: y == x))

    def again(ordered: Column) -> Column:
        """Values that a sorted array holds twice or more."""
        return F.array_distinct(F.filter(ordered, lambda x, i: (i > 0) & (x == F.get(ordered, i - 1))))

    # every shared value counts once; only values repeated on both sides are counted one by one
    often = F.get(F.transform(F.array(F.array_sort(a)), again), F.lit(0))
    both = F.array_intersect(often, F.get(F.transform(F.array(F.array_sort(b)), again), F.lit(0)))
    more = F.aggregate(both, F.lit(0), lambda total, x: total + F.least(count(a, x), count(b, x)) - 1)
    shared = F.size(F.array_intersect(a, b)) + more
    return shared / (F.size(a) + F.size(b) - shared)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, doc_id, item_id, similarity, distance, start_word, n_words): the best window of each
    document and item whose similarity reaches the threshold.

    docs holds doc_id, text and the number _row of each row.
    """
    known = prepared(items)
    # one small row for each shingle width in use, five at most
    widths = sorted(r.width for r in known.select("width").distinct().collect())
    rows = docs.select(
        F.col("_row").alias("row"),
        F.col("doc_id").cast("long"),
        words(F.col("text")).alias("words"),
    )
    targets = known.select("item", "size", "width", F.size("hashes").alias("m"), F.explode(F.array_distinct("hashes")).alias("h"))
    found = None
    for width in widths:
        here = rows.select("row", F.posexplode(shingles(F.col("words"), width)).alias("pos", "h"))
        hits = here.join(targets.where(F.col("width") == width), "h").select("row", "item", "size", "width", "m", "pos")
        found = hits if found is None else found.union(hits)
    if found is None:
        empty = rows.select("row", "doc_id").where("false")
        return empty.crossJoin(known.select("item_id").limit(0)).selectExpr(
            "*", "0D similarity", "0 distance", "0 start_word", "0 n_words"
        )
    hits = stored(found, "hits")
    pairs = hits.groupBy("row", "item", "m").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.where(F.col("n") >= F.ceil(F.lit(threshold) * F.col("m"))).select("row", "item")
    starts = (
        hits.join(pairs, ["row", "item"])
        .select(
            "row", "size", "width",
            F.explode(F.sequence(F.greatest(F.col("pos") - F.col("m") + 1, F.lit(0)), "pos")).alias("start"),
        )
        .distinct()
        .groupBy("row", "size", "width")
        .agg(F.collect_list("start").alias("starts"))
    )
    windows = None
    for width in widths:
        at = rows.join(starts.where(F.col("width") == width), "row")
        at = at.select("row", "doc_id", "size", "width", "starts", shingles(F.col("words"), width).alias("all"))
        m = F.col("size") - width + 1
        at = at.select("row", "doc_id", "size", "width", "all", F.explode("starts").alias("start"))
        # a document shorter than the item is one window
        whole = (F.size("all") < m) & (F.col("start") == 0)
        at = at.where((F.col("start") + m <= F.size("all")) | whole).select(
            "row", "doc_id", "size", "width", "start", F.slice("all", F.col("start") + 1, m).alias("hashes")
        )
        windows = at if windows is None else windows.union(at)
    windows = stored(windows, "windows")
    printed = stored(
        windows.select("row", "size", "width", "start", fingerprint(F.col("hashes")).alias("fp")), "printed"
    )
    index = known.select(
        "item", "size", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"))).alias("b")
    ).select(
        "item", "size", "item_fp", "b.block",
        F.explode(F.array(*(F.col("b.value").bitwiseXOR(F.lit(x)) for x in flips()))).alias("value"),
    )
    met = (
        printed.select("*", F.explode(blocks(F.col("fp"))).alias("b"))
        .select("row", "size", "start", "fp", "b.block", "b.value")
        .join(index, ["size", "block", "value"])
        .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
        .where(F.col("distance") <= RADIUS)
        .select("row", "size", "start", "item", "distance")
        .distinct()
    )
    checked = (
        met.join(windows, ["row", "size", "start"])
        .join(known.select("item", "item_id", "width", F.col("hashes").alias("item_hashes")), ["item", "width"])
        .withColumn("similarity", similarity(F.col("hashes"), F.col("item_hashes")))
        .where(F.col("similarity") >= threshold)
    )
    best = F.max(F.struct("similarity", (-F.col("distance")).alias("close"), (-F.col("start")).alias("first"), F.size("hashes").alias("m")))
    return (
        checked.groupBy("row", "doc_id", "item", "item_id", "width")
        .agg(best.alias("best"))
        .select(
            "row",
            "doc_id",
            "item_id",
            F.round("best.similarity", 6).alias("similarity"),
            (-F.col("best.close")).cast("int").alias("distance"),
            (-F.col("best.first")).cast("int").alias("start_word"),
            (F.col("best.m") + F.col("width") - 1).alias("n_words"),
        )
    )


def report(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it holds."""
    rows = numbered(docs.select("doc_id", "text"), "documents")
    return leaks(rows, items, threshold).drop("row")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item; all columns stay."""
    key = unused("row", docs.columns)
    rows = numbered(docs, "documents", key)
    found = leaks(rows.select("doc_id", "text", F.col(key).alias("_row")), items, threshold)
    return rows.join(found.select(F.col("row").alias(key)).distinct(), key, "left_anti").select(*docs.columns)
