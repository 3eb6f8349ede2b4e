"""Language ID by a small byte convolutional network, trained in NumPy.

Bytes are embedded; filters of two, three and four bytes run over windows of WINDOW bytes; each
filter's maximum feeds a softmax layer. A text is cut into windows over its whole length; its
prediction is the average of their log-probabilities, weighted by their bytes.

Training texts are bounded: PER_LANGUAGE labelled documents of the smallest hashes per language,
PIECES windows of each at hashed places. Everything else runs in tasks over all texts.

Null texts and those without a letter are ``und`` with score 0; without any labelled row all texts
are ``und``. Repeated rows are predicted each; a null doc_id is not held out and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.shared import bounded

UNKNOWN = "und"
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
PER_LANGUAGE = 500
PIECES = 4
EPOCHS = 12
BATCH = 128
RATE = 0.005
AT_ONCE = 512


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    offset: np.ndarray

    @classmethod
    def random(cls, languages: list[str], seed: int = 7) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        n, wide = FILTERS * len(WIDTHS), max(WIDTHS) * EMBEDDING
        return cls(
            languages,
            rng.normal(0, 0.5, (256, EMBEDDING)).astype("f4"),
            rng.normal(0, 0.3, (wide, n)).astype("f4") * cls.reach(),
            np.zeros(n, "f4"),
            rng.normal(0, 0.2, (n, len(languages))).astype("f4"),
            np.zeros(len(languages), "f4"),
        )

    @staticmethod
    def reach() -> np.ndarray:
        """1 where a filter has weights: narrower ones see the first bytes of a position only."""
        width = np.repeat(WIDTHS, FILTERS)
        return (np.arange(max(WIDTHS) * EMBEDDING)[:, None] // EMBEDDING < width).astype("f4")

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of all positions, filter values at the best position, and that position."""
        seen = self.embedding[windows]
        last = WINDOW - max(WIDTHS) + 1
        inputs = np.concatenate([seen[:, k : k + last] for k in range(max(WIDTHS))], axis=2)
        values = (inputs.reshape(-1, inputs.shape[2]) @ self.filters).reshape(len(windows), last, -1)
        return inputs, values, values.max(1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        best = np.maximum(self.pooled(windows)[2] + self.bias, 0)
        return log_softmax(best @ self.output + self.offset)

    def gradients(self, windows: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
        inputs, values, top = self.pooled(windows)
        at, best = values.argmax(1), np.maximum(top + self.bias, 0)
        error = np.exp(log_softmax(best @ self.output + self.offset))
        error[np.arange(len(truth)), truth] -= 1
        error /= len(truth)
        back = (error @ self.output.T) * (best > 0)
        chosen = inputs[np.arange(len(windows))[:, None], at]
        filters = np.einsum("nfi,nf->if", chosen, back) * self.reach()
        inner = (back[:, :, None] * self.filters.T).reshape(*back.shape, max(WIDTHS), EMBEDDING)
        place = at[:, :, None] + np.arange(max(WIDTHS))
        embedding = np.zeros_like(self.embedding)
        np.add.at(embedding, windows[np.arange(len(windows))[:, None, None], place], inner)
        return [embedding, filters, back.sum(0), best.T @ error, error.sum(0)]


def log_softmax(values: np.ndarray) -> np.ndarray:
    values = values - values.max(1, keepdims=True)
    return values - np.log(np.exp(values).sum(1, keepdims=True))


def train(windows: np.ndarray, truth: np.ndarray, languages: list[str]) -> ByteNetwork:
    """Adam over shuffled batches with fixed seeds."""
    net = ByteNetwork.random(languages)
    weights = [net.embedding, net.filters, net.bias, net.output, net.offset]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    rng, step = np.random.default_rng(11), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for part in np.array_split(order, max(1, len(order) // BATCH)):
            step += 1
            for w, g, m, v in zip(weights, net.gradients(windows[part], truth[part]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over whole texts, padded by spaces; (windows, text of each, bytes in each)."""
    sizes = np.array([len(t) for t in texts], "i8")
    n = -(-sizes // WINDOW)
    flat = np.frombuffer(b"".join(t.ljust(k * WINDOW) for t, k in zip(texts, n.tolist())), "u1")
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return flat.reshape(-1, WINDOW), owner, np.minimum(WINDOW, sizes[owner] - place * WINDOW)


#: Parts of a language's rows that are cut down to the sample's size side by side.
PARTS = 64


def sample(labelled: DataFrame, per_language: int, pieces: int) -> DataFrame:
    """(lang, piece): a bounded number of hashed pieces of labelled texts per language."""
    places = [
        F.substring(
            "text",
            F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(1)))
            .cast("int") + 1,
            F.lit(WINDOW),
        )
        for k in range(pieces)
    ]
    cuts = labelled.select("lang", F.xxhash64("doc_id", "text").alias("hash"), F.array(*places).alias("pieces"))
    # the first of each part of a language, then of the language: no task sees all rows of one
    for by in (["lang", F.pmod("hash", F.lit(PARTS))], ["lang"]):
        first = Window.partitionBy(*by).orderBy("hash")
        cuts = cuts.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).drop("n")
    return cuts.select("lang", F.explode("pieces").alias("piece"))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNetwork | None:
    """Network of labelled rows (doc_id, text, lang), or None if there are none."""
    rows = sample(labelled, per_language, PIECES).orderBy("lang", "piece").collect()
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    windows, owner, _ = cut([r.piece.encode("utf-8", "replace") for r in rows])
    truth = np.array([languages.index(r.lang) for r in rows])[owner]
    return train(windows, truth, languages)


def predict(docs: DataFrame, net: ByteNetwork | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            letters = batch.column("letters").to_numpy(False)
            texts = batch.column("text").fill_null("").to_pylist()
            windows, owner, weight = cut([t.encode("utf-8", "replace") for t in texts])
            total = np.zeros((len(texts), len(net.languages)))
            for at in range(0, len(windows), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                logs = net.log_probabilities(windows[part]) * weight[part, None]
                np.add.at(total, owner[part], logs)
            mean = log_softmax(total / np.maximum(np.bincount(owner, weight, len(texts)), 1)[:, None])
            best = mean.argmax(1)
            names = np.where(letters, np.array(net.languages, object)[best], UNKNOWN)
            score = np.where(letters, np.round(np.exp(mean.max(1)), 6), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("string"),
        F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)).alias("letters"),
    )
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def id_remainder(divisor: int) -> Column:
    """CRC-32 of doc_id as text, modulo the divisor; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def identify(docs: DataFrame) -> DataFrame:
    """Learns from labelled rows that are not held out, then predicts every row."""
    held_out = id_remainder(3) == 1
    labelled = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return predict(docs, fit(labelled.select("doc_id", "text", "lang")), held_out)
