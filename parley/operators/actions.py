"""The list of actions: duplicates merged, filtered and put into sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cleaning as cl
from .numbering import number_by_id

# --- fixed values -------------------------------------------------------------------------
TYPE_LABELS = {
    "Tasks": "task",
    "Requests": "request",
    "Deadlines": "deadline",
    "Decisions": "decision",
}
SECTION_OF = {"deadline": "Deadlines", "task": "Tasks", "request": "Requests", "decision": "Decisions"}
HIGH_PRIORITY = "High Priority"
NO_TASK, NO_DATE = "Deadline mentioned", "Date not specified"
NO_DEADLINE, NO_EVIDENCE = "Not specified", "No evidence available."
# ------------------------------------------------------------------------------------------

ACTION_COLUMNS = [
    "message_id", "user", "message", "type", "task", "deadline", "priority", "confidence", "evidence",
]


def add_action_keys(results: DataFrame, unicode_keys: bool = False) -> DataFrame:
    """Add `action_key` (task, or message when that leaves nothing) and `deadline_key`."""
    by_task = cl.action_key(F.col("task"), unicode_keys)
    by_message = cl.action_key(F.col("message"), unicode_keys)
    return results.withColumns(
        {
            "action_key": F.when(by_task != "", by_task).otherwise(by_message),
            "deadline_key": cl.deadline_key(F.col("deadline")),
        }
    )


def deduplicate_actions(results: DataFrame, unicode_keys: bool = False) -> DataFrame:
    """One result per action and deadline within a chat: the most confident one.

    The type is no part of the identity, so a row of type `none` can stand for a task. Ties go
    to deadline, task, request, decision in this order, then to the earlier message.
    """
    best = Window.partitionBy("chat_id", "action_key", "deadline_key").orderBy(
        F.desc("_confidence"),
        F.desc(cl.type_rank(F.col("type"))),
        F.asc_nulls_last("date"),
        "message_id",
    )
    return (
        add_action_keys(results, unicode_keys)
        .withColumn("_confidence", F.coalesce(cl.to_number(F.col("confidence")), F.lit(0.0)))
        .withColumn("_rn", F.row_number().over(best))
        .where("_rn = 1")
        .drop("_rn", "_confidence", "action_key", "deadline_key")
    )


def actionable(actions: DataFrame) -> DataFrame:
    """Actions of the four actionable types with the columns to show."""
    return actions.where(F.col("type").isin(cl.ACTIONABLE)).select("chat_id", *ACTION_COLUMNS)


def in_message_order(actions: DataFrame) -> DataFrame:
    """Actions with their `place` in the chat, counted from 1 in order of the message."""
    return number_by_id(actions, "place")


def filter_actions(actions: DataFrame, kind: str = "All", priority: str = "All") -> DataFrame:
    """Filter by type label (`Tasks`, ...) and priority; `All` keeps everything."""
    if kind != "All":
        actions = actions.where(F.col("type") == TYPE_LABELS[kind])
    if priority != "All":
        actions = actions.where(
            F.lower(F.coalesce("priority", F.lit(""))) == priority.lower()
        )
    return actions


def sections(actions: DataFrame) -> DataFrame:
    """Add `section` with the texts to show; rows that belong to none are dropped.

    High priority comes first whatever the type, so each action is in one section.
    """
    high = F.lower(F.coalesce("priority", F.lit(""))) == "high"
    section = F.when(high, HIGH_PRIORITY)
    for kind, label in SECTION_OF.items():
        section = section.when(F.col("type") == kind, label)
    placed = actions.withColumn("section", section).where(F.col("section").isNotNull())
    in_deadlines = F.col("section") == SECTION_OF["deadline"]
    return placed.withColumns(
        {
            "headline": F.coalesce(
                "task", F.when(in_deadlines, F.lit(NO_TASK)).otherwise(F.col("message"))
            ),
            "deadline_text": F.when(
                F.col("section") == HIGH_PRIORITY, F.coalesce("deadline", F.lit(NO_DEADLINE))
            ).when(in_deadlines, F.coalesce("deadline", F.lit(NO_DATE))),
            "evidence_text": F.when(F.col("evidence") != "", F.col("evidence")).otherwise(
                NO_EVIDENCE
            ),
        }
    )


def dashboard(results: DataFrame, kind: str = "All", priority: str = "All") -> DataFrame:
    """Sections of the de-duplicated, filtered actions."""
    return sections(filter_actions(deduplicate_actions(results), kind, priority))


def summary(results: DataFrame) -> DataFrame:
    """Results, tasks, requests and deadlines per chat, before duplicates are merged."""
    return results.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("results"),
        *[F.count_if(F.col("type") == t).alias(f"{t}s") for t in ("task", "request", "deadline")],
    )


def dedup_summary(results: DataFrame) -> DataFrame:
    """Results and distinct actions per chat.

    Counting distinct keys needs no ranking: every (action, deadline) keeps exactly one row.
    """
    per_key = (
        add_action_keys(results)
        .groupBy("chat_id", "action_key", "deadline_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_key.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("unique_actions"), F.sum("n").alias("results")
    )
