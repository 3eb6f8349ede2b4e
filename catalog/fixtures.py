"""Chats made of the driver's tables, as DataFrames and as DuckDB SQL.

Messages come from `events`: real times, a sender per event and a phrase from a fixed list, so
that every pattern occurs. Both forms are written from the same list.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators.numbering import number_rows
from parley.schema import GROUP_NOTIFICATION
from parley.sources.exports import add_calendar
from parley.storage import shared_dir

# --- fixed values: message = PHRASES[event_id % 24] -----------------------------------------
PHRASES = [
    "Please submit the assignment by tomorrow",
    "ok",
    "<Media omitted>",
    "Can you send me the notes?",
    "we decided to use option 2",
    "good morning",
    "https://example.com/submit?x=1",
    "see https://example.com/doc for details",
    "You deleted this message",
    "mujhe notes bhej do",
    "kal 7 baje form bhar dena",
    "lol \U0001f602\U0001f602 that was great",
    "❤️\U0001f44d",
    "Meeting moved to 2nd floor",
    "let's go with react, final?",
    "is this right?",
    "user added a member",
    "This message was deleted",
    "the deadline is within two days",
    "could you share the file before 10th?",
    "random chatter about nothing at all",
    "haan theek hai bhai",
    "multi line\nsecond line here",
    "update: 12/10 works",
]
NOTIFICATION_PHRASE = 16
QUESTION = "When do I need to submit the assignment?"
PIVOT_YEAR = 2026
# ----------------------------------------------------------------------------------------------

N = len(PHRASES)
SPARK_PHRASES = ", ".join("'" + p.replace("'", "\\'") + "'" for p in PHRASES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return os.path.join(shared_dir(spark), f"results-{uuid.uuid4().hex}")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without ids, for everything that does not need them: no shuffle."""
    phrase = F.col("event_id") % N
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        (F.col("user_id") % 10).alias("chat_id"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("date"),
        F.when(phrase == NOTIFICATION_PHRASE, GROUP_NOTIFICATION)
        .otherwise(F.concat(F.lit("user_"), F.col("user_id")))
        .alias("user"),
        F.expr(f"get(array({SPARK_PHRASES}), int(event_id % {N}))").alias("message"),
    )
    return add_calendar(rows)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with dense ids per chat in time order."""
    return number_rows(
        event_messages(spark, sf_dir), "chat_id", ["ts", "event_id"], F.col("date"), "message_id"
    )


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chat_id"),
        (F.col("turn") + 1).alias("message_id"),
        F.col("role").alias("user"),
        F.col("text").alias("message"),
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one long message each; the source is the chat, the language the sender."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("chat_id"),
        F.col("doc_id").alias("message_id"),
        F.col("lang").alias("user"),
        F.col("text").alias("message"),
    )


PART = 1000


def export_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chat_id, split, text): chats rendered as export text, at most PART messages per row."""
    head = F.date_format("date", "dd/MM/yy, h:mm a")
    sender = F.when(F.col("user") == GROUP_NOTIFICATION, "").otherwise(
        F.concat(F.col("user"), F.lit(": "))
    )
    line = F.concat(head, F.lit(" - "), sender, F.col("message"), F.lit("\n"))
    return (
        messages(spark, sf_dir)
        .select(
            "chat_id",
            F.floor((F.col("message_id") - 1) / F.lit(PART)).alias("split"),
            "message_id",
            line.alias("line"),
        )
        .groupBy("chat_id", "split")
        .agg(F.array_sort(F.collect_list(F.struct("message_id", "line"))).alias("lines"))
        .select(
            "chat_id",
            "split",
            F.array_join(F.transform("lines", lambda r: r.line), "").alias("text"),
        )
    )


# --- SQL forms --------------------------------------------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s_strip(x: str) -> str:
    return f"trim({x}, {quote(tx.WHITESPACE)})"


def s_words(x: str) -> str:
    return f"string_split_regex({s_strip(x)}, '[{tx.WS}]+')"


def s_word_count(x: str) -> str:
    return f"(CASE WHEN {s_strip(x)} = '' THEN 0 ELSE len({s_words(x)}) END)"


def s_collapse(x: str) -> str:
    return f"regexp_replace({x}, '[{tx.WS}]+', ' ', 'g')"


def s_clean_words(x: str) -> str:
    trimmed = f"list_transform({s_words(f'lower({x})')}, lambda w: trim(w, {quote(tx.WORD_EDGE)}))"
    return f"list_filter({trimmed}, lambda w: w <> '')"


EV = f"""ev AS (
  SELECT event_id, ts, user_id % 10 AS chat_id, date_trunc('minute', ts) AS date,
    CASE WHEN event_id % {N} = {NOTIFICATION_PHRASE} THEN '{GROUP_NOTIFICATION}'
         ELSE 'user_' || user_id END AS "user",
    ([{", ".join(quote(p) for p in PHRASES)}])[(event_id % {N})::INT + 1] AS message
  FROM events),
evc AS (
  SELECT *, year(date)::INT AS year, month(date)::INT AS month_num,
    strftime(date, '%B') AS month, date::DATE AS only_date, day(date)::INT AS day,
    strftime(date, '%A') AS day_name, hour(date)::INT AS hour, minute(date)::INT AS minute,
    printf('%02d-%02d', hour(date), (hour(date) + 1) % 24) AS period
  FROM ev)"""

MSGS = f"""{EV},
msgs AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts, event_id) AS message_id
  FROM evc)"""

CONV = """conv AS (
  SELECT conv_id AS chat_id, turn + 1 AS message_id, role AS "user", text AS message
  FROM conversations)"""

DOCS = """docs AS (
  SELECT source AS chat_id, doc_id AS message_id, lang AS "user", text AS message
  FROM documents)"""
