"""Activity statistics per chat.

Each function takes the messages table and an optional user; ``user=None`` means everybody,
system notifications included. All are one partial + final aggregation keyed by chat. Tables that are shown in an
order carry it as `place`, counted from 1 in each chat, because rows of a distributed table have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..schema import GROUP_NOTIFICATION
from .numbering import place_rows

PERIODS = [f"{h:02d}-{(h + 1) % 24:02d}" for h in range(24)]


def filter_user(messages: DataFrame, user: str | None = None) -> DataFrame:
    return messages if user is None else messages.where(F.col("user") == user)


def _measures(endings: list[str] | None = None) -> list:
    return [
        F.count(F.lit(1)).alias("messages"),
        F.sum(tx.word_count(F.col("message")).cast("bigint")).alias("words"),
        F.count_if(tx.is_media(F.col("message"))).alias("media"),
        F.sum(tx.link_count(F.col("message"), endings).cast("bigint")).alias("links"),
    ]


def fetch_stats(
    messages: DataFrame, user: str | None = None, endings: list[str] | None = None
) -> DataFrame:
    """Messages, words, media messages and links per chat; `endings` are those of hosts without a scheme."""
    return filter_user(messages, user).groupBy("chat_id").agg(*_measures(endings))


def stats_rollup(messages: DataFrame, endings: list[str] | None = None) -> DataFrame:
    """`fetch_stats` for every user and for everybody (`scope` = 'Overall') in one pass.

    Rows are first reduced to one per (chat, user), so the rollup expands that small table and
    not the messages.
    """
    per_user = messages.groupBy("chat_id", "user").agg(*_measures(endings))
    # grouping() of the user is 1 in the grand-total row of a chat
    return (
        per_user.groupingSets([["chat_id", "user"], ["chat_id"]], "chat_id", "user")
        .agg(
            F.grouping("user").cast("int").alias("is_overall"),
            *[F.sum(c).alias(c) for c in ("messages", "words", "media", "links")],
        )
        .withColumn("user", F.when(F.col("is_overall") == 1, "Overall").otherwise(F.col("user")))
    )


def _user_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id", "user").agg(F.count(F.lit(1)).alias("messages"))


def busy_users(messages: DataFrame, top: int = 5) -> DataFrame:
    """The `top` users of each chat by number of messages."""
    best = Window.partitionBy("chat_id").orderBy(F.desc("messages"), "user")
    return (
        _user_counts(messages)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )


def user_percent(messages: DataFrame) -> DataFrame:
    """Share of each user in the messages of the chat, in percent with two decimals."""
    users = _user_counts(messages)
    totals = users.groupBy("chat_id").agg(F.sum("messages").alias("total"))
    return users.join(totals, "chat_id").select(
        "chat_id",
        F.col("user").alias("name"),
        F.round(F.lit(100.0) * F.col("messages") / F.col("total"), 2).alias("percent"),
    )


def _placed(rows: DataFrame, *order) -> DataFrame:
    """Adds `place` to an aggregate with a bounded number of rows per chat, such as its days or weekdays."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("chat_id").orderBy(*order)))


def monthly_timeline(messages: DataFrame, user: str | None = None) -> DataFrame:
    """Messages per month in order of time, with a `Month-YYYY` label."""
    months = (
        filter_user(messages, user)
        .groupBy("chat_id", "year", "month_num", "month")
        .agg(F.count(F.lit(1)).alias("messages"))
        .withColumn("time", F.concat_ws("-", "month", "year"))
    )
    return _placed(months, "year", "month_num")


def daily_timeline(messages: DataFrame, user: str | None = None) -> DataFrame:
    """Messages per day that has any, in order of time."""
    days = (
        filter_user(messages, user)
        .groupBy("chat_id", "only_date")
        .agg(F.count(F.lit(1)).alias("messages"))
    )
    return _placed(days, "only_date")


def _activity(messages: DataFrame, user: str | None, by: str) -> DataFrame:
    counts = (
        filter_user(messages, user)
        .groupBy("chat_id", by)
        .agg(F.count(F.lit(1)).alias("messages"))
    )
    return _placed(counts, F.desc("messages"), by)


def week_activity(messages: DataFrame, user: str | None = None) -> DataFrame:
    """Messages per weekday, the busiest first; equal counts by name."""
    return _activity(messages, user, "day_name")


def month_activity(messages: DataFrame, user: str | None = None) -> DataFrame:
    """Messages per month name over all years, the busiest first; equal counts by name."""
    return _activity(messages, user, "month")


def activity_heatmap(messages: DataFrame, user: str | None = None) -> DataFrame:
    """Messages per (weekday, hour period) that has any."""
    return (
        filter_user(messages, user)
        .groupBy("chat_id", "day_name", "period")
        .agg(F.count(F.lit(1)).alias("messages"))
    )


def activity_heatmap_wide(messages: DataFrame, user: str | None = None) -> DataFrame:
    """The heatmap with one column per hour period, zero where nothing was sent."""
    return (
        filter_user(messages, user)
        .groupBy("chat_id", "day_name")
        .pivot("period", PERIODS)
        .agg(F.count(F.lit(1)))
        .fillna(0, subset=PERIODS)
    )


def participants(messages: DataFrame) -> DataFrame:
    """An `Overall` entry (place 0) and the users of each chat in order of their names.

    A chat may have any number of users: they are placed across ranges of names, at once.
    """
    users = messages.select("chat_id", "user").distinct()
    everyone = users.select("chat_id").distinct().select("chat_id", F.lit(0).alias("place"), F.lit("Overall").alias("user"))
    named = place_rows(users.where(F.col("user") != GROUP_NOTIFICATION), "chat_id", ["user"], "place")
    return everyone.unionByName(named.withColumn("place", F.col("place").cast("int")))
