"""The user-level jobs: analyse chats, ask them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import candidates as cand
from ..operators import extract, search, validate


def analyze_chat(
    messages: DataFrame,
    window: int = cand.WINDOW,
    batch_size: int = cand.BATCH_SIZE,
    extractor: extract.Extractor | None = None,
) -> DataFrame:
    """Candidates, extraction and validation.

    Chats without candidates give no rows; the columns stay. With the built-in rules this is one
    lazy plan with one pass over the messages and no shuffle: the evidence of a rule is the message
    itself, so it is checked against the message and its neighbours are not needed. A caller's
    ``extractor`` goes through stored batches.
    """
    if extractor is None:
        quoted = cand.filter_candidates(messages).withColumn("context_text", F.col("message"))
        found = extract.extract_rules(quoted, keep=("context_text",))
        return validate.ground(validate.clean_fields(found)).drop("context_text")
    results = extract.analyze_candidates(
        messages, cand.filter_candidates(messages), window, batch_size, extractor=extractor
    )
    # one result per candidate, so the input order has nothing to decide
    return validate.validate_results(results, messages)


def ask(
    messages: DataFrame,
    index: DataFrame,
    encoder,
    question: str,
    results: DataFrame | None = None,
    top_k: int = 5,
    window: int = 2,
) -> DataFrame:
    """Hits of a question in every chat of an index built with the same encoder."""
    vector = vec.unit(vec.literal(encoder.question(messages.sparkSession, question)))
    return search.search(index, messages, question, vector, results, top_k, window)


def answer(
    index: DataFrame, encoder, question: str, results: DataFrame, top_k: int = 5
) -> DataFrame:
    """One grounded answer per chat that has one."""
    vector = vec.unit(vec.literal(encoder.question(index.sparkSession, question)))
    return search.grounded_answer(search.rank_hits(index, question, vector, results, top_k))
