"""Validation of extracted results against the conversation they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cleaning as cl
from .context import carry_context_text
from .numbering import number_rows

TEXT_FIELDS = ["task", "deadline", "evidence"]
GROUNDING_WINDOW = 2


def clean_fields(results: DataFrame) -> DataFrame:
    """Normalise type, priority, texts, confidence and importance; rows without an id go.

    Text columns the input lacks are added as null. A null importance counts as false.
    """
    have = set(results.columns)
    fields = {
        "type": cl.clean_type(F.col("type")),
        "priority": cl.clean_priority(F.col("priority")),
        "confidence": cl.clean_confidence(F.col("confidence")),
        "is_important": F.coalesce(F.col("is_important").cast("boolean"), F.lit(False)),
        **{
            c: cl.clean_value(F.col(c)) if c in have else F.lit(None).cast("string")
            for c in TEXT_FIELDS
        },
    }
    return (
        results.withColumn("message_id", cl.clean_message_id(F.col("message_id")))
        .where(F.col("message_id").isNotNull())
        .withColumns(fields)
    )


def ground(results: DataFrame) -> DataFrame:
    """Demote results whose evidence is missing or not found in `context_text`.

    Demoted rows get type `none`, no task, no deadline and no importance; evidence that is not
    in the context goes too. Type `none` without evidence stays as it is.
    """
    supported = cl.evidence_in(F.col("evidence"), F.col("context_text"))
    claimed = F.col("evidence").isNotNull()
    demoted = F.when(claimed, ~supported).otherwise(F.col("type") != "none")
    judged = results.withColumn("_demoted", demoted)
    keep = ~F.col("_demoted")
    return judged.withColumns(
        {
            "type": F.when(keep, F.col("type")).otherwise("none"),
            "task": F.when(keep, F.col("task")),
            "deadline": F.when(keep, F.col("deadline")),
            "is_important": F.col("is_important") & keep,
            "evidence": F.when(keep, F.col("evidence")),
        }
    ).drop("_demoted")


def keep_first(rows: DataFrame, seq: str = "seq", also: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each message (and of the columns `also`) in the order of `seq`."""
    first = Window.partitionBy(*also, "chat_id", "message_id").orderBy(seq)
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def validate_results(
    results: DataFrame,
    messages: DataFrame,
    window: int = GROUNDING_WINDOW,
    seq: str | None = None,
) -> DataFrame:
    """Cleaned, grounded results: at most one per message, only for existing messages.

    ``seq`` names the column that holds the input order, which decides between several results
    for one message; it is dropped. Leave it out when ids are unique. Not sorted: use
    ``in_date_order`` for display.
    """
    cleaned = clean_fields(results)
    # Whether a row is grounded does not depend on other rows, so duplicates may go first.
    single = keep_first(cleaned, seq).drop(seq) if seq else cleaned
    # ids that are no message drop out here
    return ground(carry_context_text(single, messages, window)).drop("context_text")


def in_date_order(results: DataFrame) -> DataFrame:
    return results.orderBy("chat_id", F.asc_nulls_last("date"), "message_id")


def number_by_date(results: DataFrame) -> DataFrame:
    """Results with their `place` in the chat, counted from 1 by date; undated ones come last."""
    day = F.coalesce(F.to_date("date"), F.lit("9999-12-31").cast("date"))
    order = [F.asc_nulls_last("date"), "message_id"]
    return number_rows(results, "chat_id", order, day, "place")
