"""Extraction of tasks, requests, deadlines and decisions from candidate batches.

The extractor is pluggable: any Python function from a batch to result records runs in
``mapInArrow`` next to the data, a few batches at a time. Without one, deterministic rules on the candidate's signals
run as native columns.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import EXTRACTION, EXTRACTION_FIELDS, EXTRACTION_REQUIRED
from ..storage import materialize
from .candidates import BATCH_SIZE, WINDOW, add_batch_numbers, create_batches

Extractor = Callable[[list[dict]], Iterable[dict]]

RESULTS = T.StructType([T.StructField("results", T.ArrayType(EXTRACTION))])
CANDIDATE_COLUMNS = ["date", "user", "message", "candidate_score", "candidate_reason"]

# Words that name a time, for the rule extractor's deadline text.
_TIME_WORDS = r"(?iu)\b(today|tomorrow|tonight|aaj|kal|\d{1,2}(?:st|nd|rd|th)|\d{1,2} baje)\b"


def extract_rules(candidates: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Extraction fields from the candidate's own signals; the evidence is the message.

    ``keep`` names further columns of the candidates to pass on.
    """
    has = lambda name: F.array_contains(F.split("candidate_reason", ", "), name)
    kind = (
        F.when(has("action"), "task")
        .when(has("request"), "request")
        .when(has("deadline"), "deadline")
        .when(has("decision"), "decision")
        .otherwise("information")
    )
    when_text = F.regexp_extract("message", _TIME_WORDS, 1)
    return candidates.select(
        "chat_id",
        "message_id",
        *CANDIDATE_COLUMNS,
        F.lit(True).alias("is_important"),
        kind.alias("type"),
        F.when(has("action") | has("request"), F.col("message")).alias("task"),
        F.when(has("deadline") & (when_text != ""), when_text).alias("deadline"),
        F.when(has("action") & has("deadline"), "high")
        .when(has("action") | has("request") | has("deadline"), "medium")
        .otherwise("low")
        .alias("priority"),
        F.least(F.lit(1.0), F.col("candidate_score") / F.lit(10.0)).alias("confidence"),
        F.col("message").alias("evidence"),
        *keep,
    )


KINDS = {
    T.BooleanType: (bool,),
    T.StringType: (str,),
    T.LongType: (int,),
    T.IntegerType: (int,),
    T.DoubleType: (int, float),
}


def checked(result: dict) -> tuple:
    """Extraction fields of one answer; raises if one is missing or of another type."""
    values = []
    for field in EXTRACTION.fields:
        value = result.get(field.name)
        if value is None:
            if field.name in EXTRACTION_REQUIRED:
                raise ValueError(f"{field.name} is missing")
        else:
            kinds = KINDS[type(field.dataType)]
            if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds):
                raise ValueError(f"{field.name} is {value!r}")
            value = float(value) if float in kinds else value
        values.append(value)
    return tuple(values)


#: Types of the extraction fields in Arrow.
ARROW = {
    T.BooleanType: pa.bool_(),
    T.StringType: pa.string(),
    T.LongType: pa.int64(),
    T.IntegerType: pa.int32(),
    T.DoubleType: pa.float64(),
}
#: Batches whose answers a task holds at once.
BATCHES_AT_ONCE = 32


def attempts(batches: Iterable[pa.RecordBatch], extractor: Extractor) -> Iterator[pa.RecordBatch]:
    """Answers to batches (chat_id, batch_no, items), sent on after every BATCHES_AT_ONCE calls."""
    log = logging.getLogger(__name__)
    fields = [("error", pa.string()), ("pos", pa.int32())]
    fields += [(f.name, ARROW[type(f.dataType)]) for f in EXTRACTION.fields]
    unfilled = (None,) * (len(fields) - 1)
    for batch in batches:
        for start in range(0, batch.num_rows, BATCHES_AT_ONCE):
            part, rows, owners = batch.slice(start, BATCHES_AT_ONCE), [], []
            for i in range(part.num_rows):
                try:
                    results = list(extractor(json.loads(part.column("items")[i].as_py())))
                    found = [(None, pos, *checked(r)) for pos, r in enumerate(results)]
                except Exception as error:  # one bad batch must not stop the rest
                    chat_id, batch_no = (part.column(c)[i].as_py() for c in ("chat_id", "batch_no"))
                    log.warning("batch %s of chat %s failed: %s", batch_no, chat_id, error)
                    found = [(str(error) or type(error).__name__, *unfilled)]
                rows += found
                owners += [i] * len(found)
            owner = pa.array(owners, pa.int64())
            arrays = [part.column(c).take(owner) for c in ("chat_id", "batch_no")]
            arrays += [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(arrays, names=["chat_id", "batch_no", *(name for name, _ in fields)])


def attempt_batches(
    batches: DataFrame, extractor: Extractor, parallelism: int | None = None
) -> DataFrame:
    """Run a function over batches: (chat_id, batch_no, error, pos, extraction fields).

    ``extractor`` gets the batch as a list of ``{"message_id", "context"}`` dicts and returns
    dicts with the extraction fields. A batch whose call fails, that lacks a required field or has
    one of another type gives one row with the error and nothing else; the others go on. Calls wait
    on the model, not on bytes, so batches are dealt over ``parallelism`` tasks (the number of
    shuffle partitions by default), which adaptive execution does not merge. A task holds the answers of a few batches only. Store the result to
    use both ``answers`` and ``extract_failures`` of it, or the batches are sent twice.
    """
    chat_type = batches.schema["chat_id"].dataType
    schema = T.StructType(
        [
            T.StructField("chat_id", chat_type),
            T.StructField("batch_no", T.LongType()),
            T.StructField("error", T.StringType()),
            T.StructField("pos", T.IntegerType()),
            *EXTRACTION.fields,
        ]
    )
    payload = F.to_json("items").alias("items")
    tasks = parallelism or int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = batches.select("chat_id", "batch_no", payload)
    return dealt.repartition(tasks, "chat_id", "batch_no").mapInArrow(lambda parts: attempts(parts, extractor), schema)


def answers(attempts: DataFrame) -> DataFrame:
    """The answers (chat_id, batch_no, pos, extraction fields) of the batches that succeeded."""
    return attempts.where("error IS NULL").drop("error")


def extract_failures(attempts: DataFrame) -> DataFrame:
    """(chat_id, batch_no, error) of the batches that gave no answer."""
    return attempts.where("error IS NOT NULL").select("chat_id", "batch_no", "error")


def extract_with(
    batches: DataFrame, extractor: Extractor, parallelism: int | None = None
) -> DataFrame:
    """Answers of a function over batches; see ``attempt_batches``."""
    return answers(attempt_batches(batches, extractor, parallelism))


def parse_extractions(answers: DataFrame) -> DataFrame:
    """Decode (chat_id, batch_no, answer JSON); malformed batches give no rows."""
    decoded = answers.withColumn("decoded", F.from_json("answer", RESULTS))
    complete = F.forall(
        "decoded.results",
        lambda r: r.isNotNull()
        & ~F.exists(
            F.array(*[r[c].isNull() for c in EXTRACTION_REQUIRED]), lambda missing: missing
        ),
    )
    return decoded.where(complete).select(
        "chat_id", "batch_no", F.posexplode("decoded.results").alias("pos", "r")
    ).select("chat_id", "batch_no", "pos", "r.*")


def join_extractions(numbered: DataFrame, extractions: DataFrame) -> DataFrame:
    """Attach extraction results to candidates of the same batch.

    Of several results for one message the last counts; results for messages of other batches
    are ignored, and candidates without a result drop out.
    """
    key = ["chat_id", "batch_no", "message_id"]
    last = Window.partitionBy(*key).orderBy(F.desc("pos"))
    latest = (
        extractions.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "pos")
    )
    return numbered.join(latest, key).select(
        "chat_id", "message_id", *CANDIDATE_COLUMNS, *EXTRACTION_FIELDS
    )


def analyze_candidates(
    messages: DataFrame,
    candidates: DataFrame,
    window: int = WINDOW,
    batch_size: int = BATCH_SIZE,
    max_batches: int | None = None,
    extractor: Extractor | None = None,
) -> DataFrame:
    """Results table of the candidates, by a given extractor or by the built-in rules."""
    if extractor is None:
        # the rules look at one message at a time: no context and no batches needed
        if max_batches is not None:
            candidates = add_batch_numbers(candidates, batch_size, max_batches)
        return extract_rules(candidates)
    # Model calls are dear and may answer differently next time: candidates and answers are
    # stored before anything reads them twice. Each batch is sent once; only the unfinished
    # tasks of a lost executor are sent again.
    stored = materialize(candidates)
    numbered = add_batch_numbers(stored, batch_size, max_batches)
    batches = create_batches(messages, stored, batch_size, window, max_batches)
    return join_extractions(numbered, materialize(extract_with(batches, extractor)))
