"""Neighbouring messages: the messages up to `window` places before and after one.

Two plans with the same result. ``attach_context`` serves all messages of a table: each chat is
cut into blocks of ids, rows near a block edge are copied into the next block, and a window runs
per block, so one shuffle moves each row about once and no task holds a whole chat.
``carry_neighbours`` serves few target messages: each target asks for its neighbours by id through
an equi-join, spread over tasks however large the chat, and takes its own columns along. Ids are
dense per chat, so a place in the chat is an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import store_by

BLOCK = 10_000
#: Ids in a block of a stored table; a target is compared with this many messages, or twice as many.
STORED_BLOCK = 256
STORED_KEYS, STORED_ORDER = ["chat_id", "id_block"], ["chat_id", "id_block", "message_id"]


def message_struct() -> Column:
    """One neighbour as the extractor sees it; the date as text."""
    return F.struct(
        "message_id",
        F.col("date").cast("string").alias("date"),
        "user",
        "message",
    )


def line() -> Column:
    return F.concat_ws(": ", "user", "message")


def _in_blocks(messages: DataFrame, window: int, block: int) -> DataFrame:
    """Each row once in its own block and, near an edge, once more in the neighbour block."""
    place = F.col("message_id") - 1
    lo = F.floor(F.greatest(place - window, F.lit(0)) / F.lit(block))
    hi = F.floor((place + window) / F.lit(block))
    return messages.withColumn("_home", F.floor(place / F.lit(block))).withColumn(
        "_block", F.explode(F.sequence(lo, hi))
    )


def over_neighbours(
    messages: DataFrame, window: int, block: int = BLOCK, **columns
) -> DataFrame:
    """Add columns computed by ``f(frame)`` over (previous, all, next) row frames.

    Every value of ``columns`` is a function of one `frames` object with `previous`, `around`
    and `next` window specifications.
    """
    ordered = Window.partitionBy("chat_id", "_block").orderBy("message_id")

    class frames:
        previous = ordered.rowsBetween(-window, -1)
        around = ordered.rowsBetween(-window, window)
        next = ordered.rowsBetween(1, window)

    wide = _in_blocks(messages, window, block).select(
        "*", *[make(frames).alias(name) for name, make in columns.items()]
    )
    return wide.where(F.col("_block") == F.col("_home")).drop("_block", "_home")


def attach_context(messages: DataFrame, window: int = 2, block: int = BLOCK) -> DataFrame:
    """Add `previous` and `next`, arrays of neighbour structs, to every message."""
    return over_neighbours(
        messages,
        window,
        block,
        previous=lambda f: F.collect_list(message_struct()).over(f.previous),
        next=lambda f: F.collect_list(message_struct()).over(f.next),
    )


def attach_context_text(messages: DataFrame, window: int = 2, block: int = BLOCK) -> DataFrame:
    """Add `context_text`, the `user: message` lines around every message."""
    return over_neighbours(
        messages,
        window,
        block,
        context_text=lambda f: F.array_join(F.collect_list(line()).over(f.around), "\n"),
    )


def neighbours_of(targets: DataFrame, messages: DataFrame, window: int = 2) -> DataFrame:
    """One row per (target, neighbour) with the neighbour's columns and `target_id`.

    A target id that is no message of its chat may still have neighbours; callers drop it.
    """
    wanted = targets.select("chat_id", F.col("message_id").alias("target_id")).distinct()
    asked = wanted.withColumn(
        "message_id",
        F.explode(F.sequence(F.col("target_id") - window, F.col("target_id") + window)),
    )
    return asked.join(messages, ["chat_id", "message_id"])


def id_block(message_id: Column) -> Column:
    return F.floor(message_id / F.lit(STORED_BLOCK)).cast("bigint")


def store_messages(messages: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """The messages stored in buckets by chat and block of ids, with the column `id_block`.

    Takes any table with chat_id and message_id, so also a search index. Functions that look up neighbours
    or rows by id use the layout where that column is there.
    """
    rows = messages.withColumn("id_block", id_block(F.col("message_id")))
    return store_by(rows, STORED_KEYS, STORED_ORDER, path, buckets)


def _asked_by_block(targets: DataFrame, stored: DataFrame, window: int, neighbour: Column) -> DataFrame:
    """(chat_id, _target, _own, _neighbour) from a stored table; its buckets are joined as they are."""
    target_id = F.col("message_id")
    first, last = target_id - window, target_id + window
    requests = targets.select(
        "chat_id",
        target_id.alias("_target"),
        F.struct(*targets.columns).alias("_row"),
        F.explode(F.sequence(id_block(first), id_block(last))).alias("id_block"),
    )
    around = stored.select("chat_id", "id_block", "message_id", neighbour.alias("_neighbour"))
    apart = F.abs(F.col("message_id") - F.col("_target"))
    own = F.when(apart == 0, F.col("_row"))
    return (
        requests.join(around, STORED_KEYS)
        .where(apart <= window)
        .select("chat_id", "_target", own.alias("_own"), "_neighbour")
    )


def _asked_by_id(targets: DataFrame, messages: DataFrame, window: int, neighbour: Column) -> DataFrame:
    """(chat_id, _target, _own, _neighbour) of any table of messages."""
    own = F.struct(*targets.columns)
    target_id = F.col("message_id")
    offsets = F.sequence(F.lit(-window), F.lit(window))
    requests = targets.select(
        "chat_id",
        target_id.alias("_target"),
        F.inline(
            F.transform(
                offsets,
                lambda o: F.struct(
                    (target_id + o).alias("message_id"), F.when(o == 0, own).alias("_own")
                ),
            )
        ),
    )
    return requests.join(
        messages.select("chat_id", "message_id", neighbour.alias("_neighbour")),
        ["chat_id", "message_id"],
    )


def carry_neighbours(
    targets: DataFrame, messages: DataFrame, window: int, neighbour: Column, out: str
) -> DataFrame:
    """Add `out`, the `neighbour` structs around each target in id order, to the targets.

    Targets must be unique per message; those whose id is no message of the chat drop out. The
    targets are computed once: their columns travel with the request for the own message, the
    other requests carry keys only.
    """
    if "id_block" in messages.columns:
        found = _asked_by_block(targets, messages, window, neighbour)
    else:
        found = _asked_by_id(targets, messages, window, neighbour)
    return (
        found.groupBy("chat_id", "_target")
        .agg(
            F.first("_own", ignorenulls=True).alias("_own"),
            F.array_sort(F.collect_list("_neighbour")).alias(out),
        )
        .where(F.col("_own").isNotNull())
        .select("_own.*", out)
    )


def carry_context(targets: DataFrame, messages: DataFrame, window: int = 2) -> DataFrame:
    """Add `context` = struct(previous, current, next) to unique targets."""
    around = carry_neighbours(targets, messages, window, message_struct(), "_around")
    own = F.col("message_id")
    context = F.struct(
        F.filter("_around", lambda m: m.message_id < own).alias("previous"),
        F.get(F.filter("_around", lambda m: m.message_id == own), F.lit(0)).alias("current"),
        F.filter("_around", lambda m: m.message_id > own).alias("next"),
    )
    return around.withColumn("context", context).drop("_around")


def carry_context_text(targets: DataFrame, messages: DataFrame, window: int = 2) -> DataFrame:
    """Add `context_text`, the lines around each, to unique targets."""
    around = carry_neighbours(
        targets, messages, window, F.struct("message_id", line().alias("line")), "_around"
    )
    text = F.array_join(F.transform("_around", lambda m: m.line), "\n")
    return around.withColumn("context_text", text).drop("_around")


def context_for(targets: DataFrame, messages: DataFrame, window: int = 2) -> DataFrame:
    """(chat_id, message_id, context) of the messages that any targets name."""
    return carry_context(targets.select("chat_id", "message_id").distinct(), messages, window)


def context_text_for(targets: DataFrame, messages: DataFrame, window: int = 2) -> DataFrame:
    """(chat_id, message_id, context_text) of the messages that any targets name."""
    return carry_context_text(targets.select("chat_id", "message_id").distinct(), messages, window)


def action_source(actions: DataFrame, messages: DataFrame, window: int = 2) -> DataFrame:
    """The conversation around each action, one row per message, the source row marked."""
    found = neighbours_of(
        actions, messages.select("chat_id", "message_id", "date", "user", "message"), window
    ).withColumn("is_current", F.col("message_id") == F.col("target_id"))
    per_target = Window.partitionBy("chat_id", "target_id")
    return (
        found.withColumn("_known", F.max("is_current").over(per_target))
        .where("_known")
        .drop("_known")
    )
