"""Quality rules: a hashed n-gram likelihood ratio between trusted text and the raw corpus.

Words and word pairs are hashed into BUCKETS. Two multinomials with add-one smoothing are counted:
one over all documents, one over trusted ones. A document's score is the mean, over its n-grams, of
log(trusted / raw). It is kept if it passes the base rules and its score is at least the trusted
documents' mean less DEVIATIONS standard deviations; one threshold holds for every document.

All trusted documents are counted, and all set the threshold. Their ids grow with the corpus, so they are not broadcast,
and no text is shuffled for them: each document sends its sorted bucket numbers, a byte or two each, to a merge join at every
size. One pass gives both counts. Corpus counts cover every document.

Null and blank texts have no words: they fail the base rules and score 0. Repeated rows are scored
each; a null doc_id is carried along and is never trusted; without trusted rows the threshold is
minus infinity. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import BATCH_BYTES, bounded, stored
from parley.llm.words import Words, split_words

BUCKETS = 1 << 16
#: Bytes of text, or of packed grams, that a task sorts or unpacks at once.
PACKED_BYTES = BATCH_BYTES // 4
DEVIATIONS = 4.0
WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "[#*$%&|<>]"
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and word pair."""
    hashed = np.array([zlib.crc32(w.encode()) for w in words.distinct.to_pylist()], "u8")
    each, text = hashed[words.codes], words.text_of_word
    pairs = (each[:-1] * np.uint64(0x9E3779B97F4A7C15) + each[1:]) >> np.uint64(40)
    inside = text[:-1] == text[1:]
    return (
        np.concatenate([text, text[1:][inside]]),
        np.concatenate([each, pairs[inside]]).astype("i8") % BUCKETS,
    )


def packed(text: np.ndarray, bucket: np.ndarray, texts: int) -> pa.Array:
    """Sorted buckets of each text as binary: differences of seven bits a byte, the last byte below 128."""
    key = np.sort(text * BUCKETS + bucket)
    first = np.flatnonzero(np.diff(key // BUCKETS, prepend=-1))
    step = np.diff(key, prepend=0)
    step[first] = key[first] % BUCKETS
    two, three = step >> 7 > 0, step >> 14 > 0
    ends = np.cumsum(1 + two + three)
    data = np.empty(ends[-1] if len(ends) else 0, "u1")
    data[ends - 1] = step & 127
    data[ends[two] - 2] = step[two] >> 7 & 127 | 128
    data[ends[three] - 3] = step[three] >> 14 | 128
    grams_before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=texts))])
    bounds = np.concatenate([[0], ends])[grams_before].astype("i4")
    return pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def unpacked(grams: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts in a row, and how many each text has."""
    data = np.frombuffer(b"".join(grams.to_pylist()), "u1")
    last = np.flatnonzero(data < 128)
    step = data[last].astype("u4")
    more = np.flatnonzero(data[last - 1] > 127)
    step[more] |= (data[last[more] - 1] & 127).astype("u4") << 7
    more = more[data[last[more] - 2] > 127]
    step[more] |= (data[last[more] - 2] & 127).astype("u4") << 14
    ends = np.searchsorted(last, np.cumsum(pc.binary_length(grams).to_numpy(False).astype("i8")))
    n = np.diff(ends, prepend=0)
    sums = np.concatenate([np.zeros(1, "u4"), np.cumsum(step, dtype="u4")])
    return sums[1:] - np.repeat(sums[ends - n], n), n


def pack_grams(docs: DataFrame) -> DataFrame:
    """(doc_id, spread, grams) of every document; spread tells rows without doc_id apart, so that no task gets them all."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in bounded(batches, "text", PACKED_BYTES):
            ids, rows = batch.column("doc_id"), np.arange(seen, seen := seen + batch.num_rows)
            spread = np.where(ids.is_null().to_numpy(False), rows, 0)
            held = packed(*grams(split_words(batch.column("text"))), len(rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(spread), held], ["doc_id", "spread", "grams"])

    texts = docs.select("doc_id", F.col("text").cast("string"))
    extra = F.lit(0).cast("long").alias("spread"), F.lit("").cast("binary").alias("grams")
    return texts.mapInArrow(pack, texts.select("doc_id", *extra).schema)


def count_grams(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, n, n_trusted) over all documents and the trusted ones; each task sends its own sums."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), "i8")
        for batch in bounded(batches, "grams", PACKED_BYTES):
            bucket, n = unpacked(batch.column("grams"))
            known = np.repeat(batch.column("known").is_valid().to_numpy(False), n)
            total += [np.bincount(x, minlength=BUCKETS) for x in (bucket, bucket[known])]
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (used, *total[:, used])], ["bucket", "n", "n_trusted"]
        )

    keys = trusted.select("doc_id", F.lit(0).cast("long").alias("spread"), F.lit(True).alias("known"))
    return (
        pack_grams(docs)
        .join(keys.hint("merge"), ["doc_id", "spread"], "left")
        .select("grams", "known")
        .mapInArrow(count, "bucket long, n long, n_trusted long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.sum("n_trusted").alias("n_trusted"))
    )


def log_ratio(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(trusted / raw) of every bucket, smoothed; at most BUCKETS rows of sums come to the driver."""
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for row in count_grams(docs, trusted).collect():
        raw[row.bucket] += row.n
        good[row.bucket] += row.n_trusted
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def repeated(codes: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(codes) < 4:
        return 0
    _, pair = np.unique(codes[:-1].astype("i8") << 32 | codes[1:], return_inverse=True)
    _, which, n = np.unique(
        pair[:-1].astype("i8") << 32 | codes[2:], return_inverse=True, return_counts=True
    )
    often = n[which] > 1
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[shift : shift + len(often)] |= often
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Base figures and score of every document."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            texts = batch.column("text").fill_null("")
            words = split_words(texts)
            chars = pc.utf8_length(words.distinct).to_numpy(False).astype("i8")
            symbols = pc.count_substring_regex(words.distinct, SYMBOLS).to_numpy(False)
            text, bucket = grams(words)
            n = np.bincount(text, minlength=len(texts))
            sums = np.bincount(text, ratio[bucket], minlength=len(texts))
            spans = zip(words.bounds.tolist(), words.bounds[1:].tolist())
            columns = [
                np.diff(words.bounds),
                words.by_text(chars),
                words.by_text(symbols.astype("i8")),
                [repeated_lines(t) if "\n" in t else 0 for t in texts.to_pylist()],
                [repeated(words.codes[a:b]) for a, b in spans],
            ]
            arrays = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns)]
            arrays.append(pa.array(np.round(sums / np.maximum(n, 1), 6)))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = pa.schema([(x.split()[0], pa.int64()) for x in BASE.split(", ")] + [("score", pa.float64())])
    return rows.mapInArrow(score, BASE + ", score double")


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    deviations: float = DEVIATIONS,
) -> DataFrame:
    """Figures, score, base_failed and kept of every document.

    ``labels`` holds (doc_id, quality); 1 marks trusted documents. Counting runs at once.
    """
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    trusted = stored(trusted, "trusted")
    rows = stored(measure(docs, log_ratio(docs, trusted)), "scores")
    ends = rows.join(trusted, "doc_id", "left_semi").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd")
    ).first()
    least = float("-inf") if ends.mean is None else round(ends.mean - deviations * ends.sd, 4)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= least)
    )
