"""Toxicity by weak supervision.

Voters: LEXICONS word lists, found as the words and word stems that are the surest
to lie in toxic training rows and dealt out by their first letters, and fixed patterns of shouting and abuse. A generative label model
estimates by expectation-maximisation how often each voter fires on either class; voters that fire
together beyond what the class explains share one vote's weight. Its posteriors are the labels of a
linear classifier over words and stems hashed to 32 bits, which scores every text; its point 0.5 is calibrated
on the labels of the training rows.

Training rows are bounded: TRAIN_ROWS labelled documents of the smallest hashes whose ids are
broadcast, so texts are not shuffled. Everything else runs in tasks over all texts.

Null and blank texts have no features: they score as a text without any learned term. Repeated rows are
scored each; a null doc_id is not held out and never learned from; without training rows all scores
are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.language import id_remainder
from parley.llm.shared import bounded, stored
from parley.llm.words import split_words

TRAIN_ROWS = 12_000
LEXICONS = 24
#: First letters by which terms are dealt out, so that forms of one word share a list.
FAMILY = 3
LEXICON_WORDS = 120
#: Lower end of the 95 % interval of a term's share of toxic documents from which it enters a list.
LEAST_SURE = 0.6
Z = 1.96
STEMS = (3, 4, 5)
#: Accuracy from which the estimate of a word list's accuracy starts.
START = 0.9
#: Log-odds of a text without any learned term while weights are fitted; calibrated() sets the final ones.
OFFSET = -2.8
STEPS = 500
RATE = 1.0
#: Summed residuals of documents with a feature below which it gets no weight.
PENALTY = 0.3
LEAST_FEATURE_DOCS = 5
#: Share of rows above which a feature is too common to be used, unless a word list holds it.
COMMON = 0.05
#: Bytes of text hashed at a time: the arrays of its words are several times its size, and a Python worker keeps
#: for later tasks what memory it once had.
SLICE_BYTES = 2 << 20
#: Characters around a word that do not belong to it.
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-+=~_/\\"
PATTERNS = (
    r"\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b",
    r"[!?]{3,}",
    r"(?i)\byou(?:'re| are)? (?:all )?(?:an? )?\w+ (?:idiot|loser|moron|clown)",
    r"(?i)\b(?:shut up|go away|hate you|get lost)\b",
)


def terms(text: Column) -> Column:
    """Distinct lower-case words without edges, and their first letters marked by a star."""
    words = F.transform(
        F.split(F.lower(text), r"[ \t-\r]+"), lambda w: F.btrim(w, F.lit(EDGES))
    )
    words = F.array_remove(words, "")

    def stems(n: int) -> Column:
        return F.transform(words, lambda w: F.concat(F.substring(w, 1, n), F.lit(f"*{n}")))

    return F.array_distinct(F.concat(words, *map(stems, STEMS)))


def lexicons(train: DataFrame) -> dict[str, int]:
    """Number of the list of each found term; at most LEXICON_WORDS terms."""
    share = F.col("bad") / F.col("n")
    low = (
        share + Z**2 / (2 * F.col("n"))
        - Z * F.sqrt(share * (1 - share) / F.col("n") + Z**2 / (4 * F.col("n") ** 2))
    ) / (1 + Z**2 / F.col("n"))
    found = (
        train.dropDuplicates(["text"])
        .select("toxic", F.explode(terms(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
        .withColumn("sure", F.round(low, 9))
        .where(F.col("sure") >= LEAST_SURE)
        .orderBy(F.desc("sure"), "term")
        .limit(LEXICON_WORDS)
    )
    return {r.term: zlib.crc32(r.term[:FAMILY].encode()) % LEXICONS for r in found.collect()}


def term_hashes(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), once for each distinct word and stem of a text, or only for known hashes."""
    words = split_words(pc.utf8_lower(texts.fill_null("")))
    bare = pc.utf8_trim(words.distinct, characters=EDGES)
    real, owner, keys = pc.not_equal(bare, "").to_numpy(False), words.text_of_word, []
    for n in (None, *STEMS):
        form = bare if n is None else pc.binary_join_element_wise(pc.utf8_slice_codeunits(bare, 0, n), "", f"*{n}")
        form = form.dictionary_encode()
        hashed = np.array([zlib.crc32(w.encode()) for w in form.dictionary.to_pylist()], "i8")[form.indices.to_numpy()]
        used = real if known is None else real & np.isin(hashed, known)
        chosen = used[words.codes]
        keys.append(owner[chosen] << 32 | hashed[words.codes[chosen]])
    keys = np.unique(np.concatenate(keys))
    return keys >> 32, keys & 0xFFFFFFFF


def label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> np.ndarray:
    """Posterior probability of the toxic class of each row of 0/1 votes, without its label.

    A voter that fires says toxic, one that does not abstains; where none of the lists fires, a
    further voter says clean. Expectation-maximisation estimates the accuracy of each, starting at
    START for lists and at the prior for patterns. A voter counts less the more it fires together with
    others beyond what the class explains.
    """
    lists = np.arange(votes.shape[1]) < LEXICONS
    start = np.where(lists, START, prior)
    clean = votes[:, lists].sum(1) == 0
    accuracy, clean_accuracy, weight = start, 1 - prior, np.ones(len(start))
    for _ in range(rounds):
        gain = np.maximum(np.log(accuracy / (1 - accuracy)), 0) * weight
        against = clean * np.log(clean_accuracy / (1 - clean_accuracy))
        p = sigmoid(votes @ gain - against)
        accuracy = np.clip((p @ votes + start) / (votes.sum(0) + 1), 0.01, 0.99)
        clean_accuracy = np.clip(((1 - p) @ clean + 1) / (clean.sum() + 1), 0.6, 0.99)
        rate = [(q @ votes + 1e-6) / (q.sum() + 1e-3) for q in (p, 1 - p)]
        rest = votes - p[:, None] * rate[0] - (1 - p)[:, None] * rate[1]
        scale = np.sqrt((rest**2).mean(0)) + 1e-6
        together = (rest.T @ rest) / len(votes) / np.outer(scale, scale)
        weight = 1 / (1 + np.clip(together - np.eye(len(scale)), 0, 1).sum(0))
    return p


@dataclass
class Classifier:
    """Weights of sorted term hashes; other terms have none."""

    hashes: np.ndarray
    weights: np.ndarray
    offset: float = OFFSET

    def score(self, texts: pa.Array) -> np.ndarray:
        owner, hashed = term_hashes(texts, self.hashes)
        each = self.weights[np.searchsorted(self.hashes, hashed)]
        return sigmoid(np.bincount(owner, each, len(texts)) + self.offset)


def sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


def train_classifier(
    owner: np.ndarray, hashed: np.ndarray, target: np.ndarray, listed: np.ndarray
) -> Classifier:
    """Logistic regression on soft targets with an L1 penalty, by proximal gradient steps.

    Weights are not negative: terms speak for toxicity or not at all. The penalty leaves features of few documents without weight, so rare words are not learned
    by heart.
    """
    hashes, docs = np.unique(hashed, return_counts=True)
    common = (docs > COMMON * len(target)) & ~np.isin(hashes, listed)
    frequent = (docs >= LEAST_FEATURE_DOCS) & ~common
    hashes, docs = hashes[frequent], docs[frequent]
    used = np.isin(hashed, hashes)
    owner, feature = owner[used], np.searchsorted(hashes, hashed[used]).astype("i4")
    weights = np.zeros(len(hashes))
    size = RATE / np.sqrt(docs * np.maximum(docs, 25))
    for _ in range(STEPS):
        error = sigmoid(np.bincount(owner, weights[feature], len(target)) + OFFSET) - target
        moved = weights - size * np.bincount(feature, error[owner], len(hashes))
        weights = np.maximum(moved - size * PENALTY, 0)
    return Classifier(hashes[weights > 0].astype("i8"), weights[weights > 0])


def calibrated(model: Classifier, owner: np.ndarray, hashed: np.ndarray, toxic: np.ndarray) -> Classifier:
    """The classifier with the offset by which 0.5 best parts the labels of the training rows.

    Best is the largest share of toxic rows found less the share of clean ones that are not kept; of
    equal cuts the middle of the gap below the highest counts.
    """
    known = np.isin(hashed, model.hashes)
    each = model.weights[np.searchsorted(model.hashes, hashed[known])]
    sums = np.bincount(owner[known], each, len(toxic))
    cuts, place = np.unique(sums, return_inverse=True)
    if len(cuts) < 2 or toxic.all() or not toxic.any():
        return model
    at_or_over = [np.bincount(place, toxic == x, len(cuts))[::-1].cumsum()[::-1] for x in (1, 0)]
    gain = (at_or_over[0] / at_or_over[0][0] - at_or_over[1] / at_or_over[1][0])[1:]
    best = len(gain) - gain[::-1].argmax()
    return Classifier(model.hashes, model.weights, -(cuts[best - 1] + cuts[best]) / 2)


def voted(train: DataFrame, lists: dict[str, int]) -> pa.Table:
    """0/1 votes and hashed features of the bounded training rows, as Arrow columns in order of doc_id.

    Features that ``train_classifier`` would drop as too rare or too common stay behind in Spark.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[int, int] = {zlib.crc32(term.encode()): n for term, n in lists.items()}
        listed = np.array(sorted(numbers), "i8")
        for batch in bounded(batches, "text", SLICE_BYTES):
            owner, hashed = term_hashes(batch.column("text"))
            hit = np.isin(hashed, listed)
            lists_of = np.zeros((batch.num_rows, LEXICONS), "i1")
            lists_of[owner[hit], [numbers[h] for h in hashed[hit].tolist()]] = 1
            shapes = [
                pc.match_substring_regex(batch.column("text"), p).to_numpy(False).astype("i1")
                for p in PATTERNS
            ]
            votes = np.column_stack([lists_of, *shapes])
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype("i4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("toxic"),
                    pa.array(votes.tolist(), pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(cuts, hashed.astype("u4").view("i4")),
                ],
                names=["doc_id", "toxic", "votes", "features"],
            )

    schema = "doc_id long, toxic int, votes array<int>, features array<int>"
    rows = stored(train.select("doc_id", "toxic", "text").mapInArrow(run, schema), "votes")
    listed = np.array([zlib.crc32(term.encode()) for term in lists], "u4").view("i4").tolist()
    docs = rows.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    not_common = (F.col("n") <= COMMON * rows.count()) | F.col("feature").isin(listed)
    kept = docs.where((F.col("n") >= LEAST_FEATURE_DOCS) & not_common).select("feature").toArrow()
    known = np.sort(kept.column("feature").to_numpy())

    def reduced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column("features")
            values, ends = features.flatten().to_numpy(), np.cumsum(pc.list_value_length(features).to_numpy())
            used = np.isin(values, known)
            cuts = np.concatenate([[0], np.cumsum(used)])[np.concatenate([[0], ends])].astype("i4")
            lists = pa.ListArray.from_arrays(cuts, values[used])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=batch.schema.names)

    return rows.mapInArrow(reduced, schema).toArrow().sort_by("doc_id")


def fit(train: DataFrame) -> Classifier | None:
    """Classifier from a bounded table (doc_id, text, toxic)."""
    lists = lexicons(train)
    if not lists:
        return None
    rows = voted(train, lists)
    prior = float(train.agg(F.avg("toxic")).first()[0])
    votes = rows.column("votes").combine_chunks().flatten().to_numpy()
    posterior = label_model(votes.reshape(rows.num_rows, -1).astype("f8"), prior)
    features = rows.column("features").combine_chunks()
    owner = np.repeat(np.arange(rows.num_rows, dtype="i4"), pc.list_value_length(features).to_numpy())
    hashed = features.flatten().to_numpy().view("u4")
    listed = np.array([zlib.crc32(term.encode()) for term in lists], "u4")
    model = train_classifier(owner, hashed, posterior, listed)
    return calibrated(model, owner, hashed, rows.column("toxic").to_numpy())


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Stored (doc_id, text, toxic) of a bounded number of labelled rows that are not held out."""
    allowed = labels.where(id_remainder(5) != 0).where("toxic IN (0, 1)")
    chosen = allowed.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = F.broadcast(stored(chosen, "labelled"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = texts.where("text IS NOT NULL").join(chosen, "doc_id")
    # an id of many rows gives one
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return stored(found.groupBy("doc_id").agg(one, F.first("toxic").alias("toxic")), "training")


def scores(texts: pa.Array, model: Classifier) -> pa.Array:
    """Rounded scores of an Arrow batch of texts, hashed in slices."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = [model.score(part.column("text")) for part in bounded([batch], "text", SLICE_BYTES)]
    return pa.array(np.round(np.concatenate([np.zeros(0), *parts]), 6))


def probability(text: Column, model: Classifier | None) -> Column:
    """Score of a text column between 0 and 1; texts stay in Arrow."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return scores(texts, model)

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; no texts wait in a queue beside Python."""
    model = fit(training_rows(docs, labels))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("string"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column("doc_id"), batch.column("held_out"), scores(batch.column("text"), model)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score"])

    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold; all columns stay."""
    model = fit(training_rows(docs, labels))
    return docs.where(probability(F.col("text").cast("string"), model) < threshold)
