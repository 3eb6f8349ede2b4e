"""Messages worth a closer look, and their batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..schema import GROUP_NOTIFICATION
from .context import carry_context
from .numbering import number_by_id

BATCH_SIZE = 5
WINDOW = 2


def score_messages(messages: DataFrame) -> DataFrame:
    """Add `candidate_score`, `candidate_reason` and `is_candidate`."""
    text = scoring.scoring_text(F.col("message"))
    flags = F.struct(*[c for c in scoring.signals(F.col("_text"))])
    # inline() keeps the optimizer from copying the regex matches into every use of a flag
    flagged = messages.withColumn("_text", text).select(
        *messages.columns, F.inline(F.array(flags)).alias(*[f"_{n}" for n in scoring.FLAGS])
    )
    return flagged.select(
        *messages.columns,
        scoring.score_of("_").alias("candidate_score"),
        scoring.reason_of("_").alias("candidate_reason"),
    ).withColumn("is_candidate", F.col("candidate_score") >= scoring.CANDIDATE_THRESHOLD)


def filter_candidates(messages: DataFrame) -> DataFrame:
    """Scored messages at or above the threshold, without notifications."""
    return score_messages(messages.where(F.col("user") != GROUP_NOTIFICATION)).where(
        "is_candidate"
    )


def add_batch_numbers(
    candidates: DataFrame, batch_size: int = BATCH_SIZE, max_batches: int | None = None
) -> DataFrame:
    """Add `batch_no` (from 0) and `place` in the batch, in candidate order per chat."""
    nth = F.col("_nth")
    numbered = (
        number_by_id(candidates, "_nth", first=0)
        .withColumn("batch_no", F.floor(nth / F.lit(batch_size)))
        .withColumn("place", (nth % batch_size).cast("int"))
        .drop("_nth")
    )
    return numbered if max_batches is None else numbered.where(F.col("batch_no") < max_batches)


def create_batches(
    messages: DataFrame,
    candidates: DataFrame,
    batch_size: int = BATCH_SIZE,
    window: int = WINDOW,
    max_batches: int | None = None,
) -> DataFrame:
    """(chat_id, batch_no, items): candidates with their context, `batch_size` per row.

    Numbering reads the candidates twice, so pass a stored or checkpointed table when scoring
    them again is dear.
    """
    numbered = add_batch_numbers(
        candidates.select("chat_id", "message_id"), batch_size, max_batches
    )
    in_place = F.array_sort(F.collect_list(F.struct("place", "message_id", "context")))
    return (
        carry_context(numbered, messages, window)
        .groupBy("chat_id", "batch_no")
        .agg(in_place.alias("items"))
        .withColumn(
            "items",
            F.transform(
                "items",
                lambda i: F.struct(i.message_id.alias("message_id"), i.context.alias("context")),
            ),
        )
    )


def prompt_blocks(batches: DataFrame) -> DataFrame:
    """(chat_id, batch_no, conversations): the batch as the text an extractor model reads."""

    def lines(messages):
        return F.array_join(
            F.transform(messages, lambda m: F.concat_ws(": ", m.user, m.message)), "\n"
        )

    def block(item):
        return F.format_string(
            BLOCK_FORMAT,
            item.message_id,
            lines(item.context.previous),
            lines(F.array(item.context.current)),
            lines(item.context.next),
        )

    return batches.select(
        "chat_id",
        "batch_no",
        F.array_join(F.transform("items", block), BLOCK_SEPARATOR).alias("conversations"),
    )


# --- fixed values: layout of the conversation text ------------------------------------------
BLOCK_FORMAT = """
MESSAGE_ID: %d

PREVIOUS MESSAGES:
%s

CURRENT MESSAGE:
%s

NEXT MESSAGES:
%s
"""
BLOCK_SEPARATOR = "\n\n--------------------\n\n"
