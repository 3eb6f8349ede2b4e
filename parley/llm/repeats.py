"""Removal of repeated 200-byte strings, by content-chosen anchors instead of suffix sorting.

A difference-cover sort of all suffixes needs rows for two thirds of all bytes in its first round
alone; README gives the figures. The same set of bytes is found from far fewer rows:

* The anchor of a string of LENGTH bytes is the place of the smallest hash among its runs of GRAM
  bytes, the first of equals; it depends on the string alone. Places in a row with the same anchor
  form a segment, so a text gives about one row for every seventy bytes.
* Segments of equal bytes that occur twice are repeated as a whole. Equal strings have equal anchors,
  so only a segment that shares its anchor with a different one is left open.
* Open segments, and one example of each repeated segment with that anchor, are cut into blocks of at
  most BLOCK strings, at multiples of BLOCK from the anchor. All strings of a block hold its core, the
  bytes that the last one shares with the first, so equal strings lie in blocks of equal cores. The
  same test again leaves few blocks open, whose strings are compared one by one.

All comparisons are of two 64-bit hashes, of a part and of the whole. Rows are known by doc_id and a
hash of the text, which stay the same however files are split; repeated rows, which share them, have
equal spans. Grouping is by hash with counts added before the shuffle; no group is gathered in one task, and all
copies of a segment cost one row each. Texts are UTF-8 bytes; null is empty; texts shorter than LENGTH
have nothing to remove; repeated rows remove each other; a null doc_id is carried along; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import bounded, stored

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM + 1
BLOCK = 16
BASE = 0x9E3779B97F4A7C15
TURN = 1 << 64
NO_ID = -(1 << 63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes modulo 2**64 of all runs of GRAM bytes, a power of two, by doubling."""
    h, size = data.astype("u8") + np.uint64(1), 1
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(pow(BASE, size, TURN)) + h[size:]
        size *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor, anchor hash) of all segments of a text of LENGTH bytes or more."""
    hashes = gram_hashes(data)
    low, place, size = hashes, np.arange(len(hashes), dtype="i4"), 1

    def smaller(shift: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[shift : shift + n] < low[:n]
        return (
            np.where(right, low[shift : shift + n], low[:n]),
            np.where(right, place[shift : shift + n], place[:n]),
        )

    while 2 * size <= REACH:
        low, place = smaller(size, len(low) - size)
        size *= 2
    low, place = smaller(REACH - size, len(data) - LENGTH + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return first, last, place[first], hashes[place[first]]


def hashed(parts: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, as signed numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, parts)), "i8")


def occurrences(rows: DataFrame) -> DataFrame:
    """(id, row, lo, hi, at, part, whole): segments, the hash of their anchors and of all their bytes."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            found, owner, whole = [], [], []
            for number, text in enumerate(batch.column("text")):
                data = bytes(text.as_buffer())
                if len(data) < LENGTH:
                    continue
                first, last, place, part = segments(np.frombuffer(data, "u1"))
                found.append((first, last, place, part.view("i8")))
                owner.append(np.full(len(first), number, "i4"))
                whole.append(hashed(data[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist())))
            if found:
                lo, hi, at, part = map(np.concatenate, zip(*found))
                owner = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(owner),
                        batch.column("row").take(owner),
                        *(pa.array(x.astype("i4")) for x in (lo, hi, at)),
                        pa.array(part),
                        pa.array(np.concatenate(whole)),
                    ],
                    names=["id", "row", "lo", "hi", "at", "part", "whole"],
                )

    return rows.select("id", "row", "text").mapInArrow(
        cut, "id long, row long, lo int, hi int, at int, part long, whole long"
    )


def by_row(spans: DataFrame, *columns: str) -> DataFrame:
    """Distinct spans (lo, hi and more) of each row as lists; a list is bounded by its text."""
    return spans.groupBy("id", "row").agg(F.collect_set(F.struct("lo", "hi", *columns)).alias("spans"))


def span_arrays(column: pa.ListArray, i: int, *columns: str) -> list[np.ndarray]:
    value = column[i]
    if not value.is_valid:
        return [np.zeros(0, "i4") for _ in ("lo", "hi", *columns)]
    return [value.values.field(name).to_numpy() for name in ("lo", "hi", *columns)]


def blocks(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, row, lo, hi, bytes, part, whole): blocks of the given segments, the hash of their cores and bytes."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            owner, places, parts, cores = [], [], [], []
            for i in range(batch.num_rows):
                data = bytes(batch.column("text")[i].as_buffer())
                for lo, hi, at in zip(*(x.tolist() for x in span_arrays(batch.column("spans"), i, "at"))):
                    for k in range((at - hi) // BLOCK, (at - lo) // BLOCK + 1):
                        last = at - k * BLOCK
                        first = last - BLOCK + 1
                        a, b = max(lo, first), min(hi, last)
                        owner.append(i)
                        places.append((a, b))
                        parts.append(data[a : b + LENGTH])
                        cores.append(data[last : first + LENGTH])
            owner = pa.array(owner, pa.int32())
            places = np.array(places, "i4").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(owner),
                    batch.column("row").take(owner),
                    pa.array(np.ascontiguousarray(places[:, 0])),
                    pa.array(np.ascontiguousarray(places[:, 1])),
                    pa.array(parts, pa.binary()),
                    pa.array(hashed(cores)),
                    pa.array(hashed(parts)),
                ],
                names=["id", "row", "lo", "hi", "bytes", "part", "whole"],
            )

    found = rows.select("id", "row", "text").join(by_row(spans, "at"), ["id", "row"])
    return found.mapInArrow(cut, "id long, row long, lo int, hi int, bytes binary, part long, whole long")


def strings(opened: DataFrame) -> DataFrame:
    """(id, row, lo, part, whole): the strings of the given blocks."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = (batch.column(c).to_numpy().astype("i4") for c in ("lo", "hi"))
            n = hi - lo + 1
            owner = np.repeat(np.arange(len(n), dtype="i4"), n)
            offset = np.arange(len(owner), dtype="i4") - np.repeat(np.cumsum(n) - n, n).astype("i4")
            data = batch.column("bytes").to_pylist()
            each = hashed(data[i][k : k + LENGTH] for i, k in zip(owner.tolist(), offset.tolist()))
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(take),
                    batch.column("row").take(take),
                    pa.array(lo[owner] + offset),
                    batch.column("part").take(take),
                    pa.array(each),
                ],
                names=["id", "row", "lo", "part", "whole"],
            )

    cut_rows = opened.select("id", "row", "lo", "hi", "bytes", "part")
    return cut_rows.mapInArrow(cut, "id long, row long, lo int, part long, whole long")


def met(pieces: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(repeated, open) pieces: those whose bytes occur twice, and those that may hold repeated strings.

    Open ones share their part with different pieces: each that occurs once, and one example of each other.
    """
    kinds = pieces.groupBy("part", "whole").agg(F.count(F.lit(1)).alias("n"))
    parts = kinds.groupBy("part").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    known = kinds.join(parts.where("all > 1").select("part", "kinds"), "part")
    found = stored(pieces.join(known, ["part", "whole"]), name, compression="zstd")
    several = found.where("kinds > 1")
    columns = [c for c in pieces.columns if c not in ("part", "whole")]
    examples = (
        several.where("n > 1")
        .groupBy("part", "whole")
        .agg(F.min(F.struct(*columns)).alias("example"))
        .select("example.*", "part")
    )
    single = several.where("n = 1").select(*columns, "part")
    return found.where("n > 1").select("id", "row", "lo", "hi"), single.union(examples)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(id, row, lo, hi): places where repeated strings start."""
    cut = stored(occurrences(rows), "segments", compression="zstd")
    whole_segments, opened = met(cut, "met-segments")
    cut = stored(blocks(rows, opened), "blocks", compression="zstd")
    whole_blocks, opened = met(cut, "met-blocks")
    cut = stored(strings(opened), "strings", compression="zstd")
    twice = cut.groupBy("part", "whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    single = cut.join(twice, ["part", "whole"]).select("id", "row", "lo", F.col("lo").alias("hi"))
    return whole_segments.union(whole_blocks).union(single)


def covered(starts: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Which of n bytes lie in a string that starts in one of the spans."""
    change = np.zeros(n + 1, "i8")
    np.add.at(change, starts[0], 1)
    np.add.at(change, starts[1] + LENGTH, -1)
    return np.cumsum(change)[:n] > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document.

    kept holds the remaining bytes.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    spans = by_row(repeated_spans(rows))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            out = []
            for i, text in enumerate(batch.column("text")):
                data = bytes(text.as_buffer())
                gone = covered(span_arrays(batch.column("spans"), i), len(data))
                rest = np.frombuffer(data, "u1")[~gone].tobytes() if gone.any() else data
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest(), rest))
            columns = [batch.column("doc_id")]
            columns += [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.join(spans, ["id", "row"], "left").select("doc_id", "text", "spans").mapInArrow(
        keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
