"""Column types of the tables the engine reads and writes."""

from pyspark.sql import types as T

GROUP_NOTIFICATION = "group_notification"
MEDIA_MESSAGE = "<Media omitted>"

_S, _L, _I, _D, _B = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
)

# One row per chat message. `chat_id` is the partition key the whole engine works on:
# a path for scanned exports, any other type when the caller brings an own table.
MESSAGES = T.StructType(
    [
        T.StructField("chat_id", _S, False),
        T.StructField("message_id", _L, False),
        T.StructField("date", T.TimestampNTZType(), True),
        T.StructField("user", _S, False),
        T.StructField("message", _S, False),
        T.StructField("year", _I, True),
        T.StructField("month_num", _I, True),
        T.StructField("month", _S, True),
        T.StructField("only_date", T.DateType(), True),
        T.StructField("day", _I, True),
        T.StructField("day_name", _S, True),
        T.StructField("hour", _I, True),
        T.StructField("minute", _I, True),
        T.StructField("period", _S, True),
    ]
)

# What an extractor returns for one message of a batch.
EXTRACTION = T.StructType(
    [
        T.StructField("message_id", _L),
        T.StructField("is_important", _B),
        T.StructField("type", _S),
        T.StructField("task", _S),
        T.StructField("deadline", _S),
        T.StructField("priority", _S),
        T.StructField("confidence", _D),
        T.StructField("evidence", _S),
    ]
)

# Fields an extractor must fill; a batch that leaves one of them out is malformed.
EXTRACTION_REQUIRED = ["message_id", "is_important", "type", "priority", "confidence"]

# Extraction joined to its candidate message.
AI_RESULTS = T.StructType(
    [
        T.StructField("chat_id", _S),
        T.StructField("message_id", _L),
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("user", _S),
        T.StructField("message", _S),
        T.StructField("candidate_score", _I),
        T.StructField("candidate_reason", _S),
        T.StructField("is_important", _B),
        T.StructField("type", _S),
        T.StructField("task", _S),
        T.StructField("deadline", _S),
        T.StructField("priority", _S),
        T.StructField("confidence", _D),
        T.StructField("evidence", _S),
    ]
)

EXTRACTION_FIELDS = [f.name for f in EXTRACTION if f.name != "message_id"]


def with_chat_type(schema: T.StructType, chat_type: T.DataType) -> T.StructType:
    """The same schema with another type for the chat key."""
    return T.StructType(
        [
            T.StructField(f.name, chat_type, f.nullable) if f.name == "chat_id" else f
            for f in schema
        ]
    )
