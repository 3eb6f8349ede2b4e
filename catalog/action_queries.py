"""Registered queries on extraction, validation, actions and search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

import parley as pl
from parley.functions import keywords as kw
from parley.functions import vectors as vec
from parley.operators import actions as act
from parley.operators import extract as ex
from parley.operators import search as se
from parley.operators import validate as va
from parley.operators.candidates import add_batch_numbers
from parley.operators.context import context_text_for
from parley.schema import AI_RESULTS, with_chat_type

from . import fixtures as fx
from .chat_queries import CANDS, NUMBERED, ORACLES, QUERIES, _contexts, register
from .chat_queries import s_action_key, s_deadline_key, s_normalize, s_overlap
from .fixtures import MSGS, quote, s_collapse, s_strip

__all__ = ["ORACLES", "QUERIES"]

# --- extraction -------------------------------------------------------------------------------

_HAS = "list_contains(string_split(candidate_reason, ', '), '{}')"
_ACT, _REQ, _DUE, _DEC = (_HAS.format(n) for n in ("action", "request", "deadline", "decision"))
_WHEN = r"(?i)\b(today|tomorrow|tonight|aaj|kal|\d{1,2}(?:st|nd|rd|th)|\d{1,2} baje)\b"
_CANDIDATE = 'chat_id, message_id, date, "user", message, candidate_score, candidate_reason'

RULES = f"""rules AS (
  SELECT {_CANDIDATE}, true AS is_important,
    CASE WHEN {_ACT} THEN 'task' WHEN {_REQ} THEN 'request' WHEN {_DUE} THEN 'deadline'
         WHEN {_DEC} THEN 'decision' ELSE 'information' END AS type,
    CASE WHEN {_ACT} OR {_REQ} THEN message END AS task,
    CASE WHEN {_DUE} THEN nullif(regexp_extract(message, '{_WHEN}', 1), '') END AS deadline,
    CASE WHEN {_ACT} AND {_DUE} THEN 'high' WHEN {_ACT} OR {_REQ} OR {_DUE} THEN 'medium'
         ELSE 'low' END AS priority,
    least(1.0::DOUBLE, candidate_score / 10.0::DOUBLE)::DOUBLE AS confidence, message AS evidence
  FROM cands)"""


@register("extract_rules", f"WITH {MSGS}, {CANDS}, {RULES} SELECT * FROM rules")
def extract_rules(spark, sf):
    return pl.extract_rules(pl.filter_candidates(fx.messages(spark, sf)))


@register("analyze_candidates", f"WITH {MSGS}, {CANDS}, {RULES} SELECT * FROM rules")
def analyze_candidates(spark, sf):
    messages = fx.messages(spark, sf)
    return pl.analyze_candidates(messages, pl.filter_candidates(messages))


@register("max_batches", f"""WITH {MSGS}, {CANDS}, {RULES}, {NUMBERED}
SELECT rules.* FROM rules JOIN numbered USING (chat_id, message_id) WHERE batch_no < 30""")
def max_batches(spark, sf):
    """The parameter that stops after a number of batches per chat."""
    messages = fx.messages(spark, sf)
    return pl.analyze_candidates(messages, pl.filter_candidates(messages), max_batches=30)


@register("analyze_chat", f"WITH {MSGS}, {CANDS}, {RULES} SELECT * FROM rules")
def analyze_chat(spark, sf):
    """The rules quote the message itself as evidence, so validation keeps every row as it is."""
    return pl.analyze_chat(fx.messages(spark, sf))


@register(
    "extract_udf",
    f"""WITH {MSGS}, {CANDS}, {_contexts('msgs')}, {NUMBERED},
b AS (SELECT chat_id, batch_no, min(message_id) AS first_id FROM numbered GROUP BY 1, 2)
SELECT chat_id, message_id, date, "user", message, candidate_score, candidate_reason,
  true AS is_important, 'task' AS type, message AS task, NULL::VARCHAR AS deadline,
  'low' AS priority, around_n / 10.0::DOUBLE AS confidence,
  nullif(split_part(prev_lines, chr(10), 1), '') AS evidence
FROM numbered JOIN b USING (chat_id, batch_no)
JOIN (SELECT chat_id, message_id, around_n, prev_lines FROM ctx) USING (chat_id, message_id)
WHERE first_id % 4 <> 0""",
)
def extract_udf(spark, sf):
    """A caller's extractor in Python; every batch whose first id is a multiple of 4 fails."""

    def extractor(batch):
        if batch[0]["message_id"] % 4 == 0:
            raise RuntimeError("model unavailable")
        for item in batch:
            context = item["context"]
            before = [f"{m['user']}: {m['message']}" for m in context["previous"]]
            yield {
                "message_id": item["message_id"],
                "is_important": True,
                "type": "task",
                "task": context["current"]["message"],
                "priority": "low",
                "confidence": (len(before) + 1 + len(context["next"])) / 10,
                "evidence": before[0].split("\n")[0] if before else None,
            }

    messages = fx.messages(spark, sf)
    return pl.analyze_candidates(messages, pl.filter_candidates(messages), extractor=extractor)


@register(
    "extract_failures",
    f"""WITH {MSGS}, {CANDS}, {NUMBERED},
b AS (SELECT chat_id, batch_no, min(message_id) AS first_id FROM numbered GROUP BY 1, 2)
SELECT chat_id, batch_no::BIGINT AS batch_no, CASE first_id % 4 WHEN 0 THEN 'model unavailable'
  WHEN 1 THEN 'confidence is ' || chr(39) || 'high' || chr(39) ELSE 'type is missing' END AS error
FROM b WHERE first_id % 4 <> 3""",
)
def extract_failures(spark, sf):
    """Batches by their first id: one kind raises, one is ill-typed, one lacks a field, one is right."""

    def extractor(batch):
        kind = batch[0]["message_id"] % 4
        if kind == 0:
            raise RuntimeError("model unavailable")
        for item in batch:
            yield {
                "message_id": item["message_id"],
                "is_important": True,
                "type": None if kind == 2 else "task",
                "priority": "low",
                "confidence": "high" if kind == 1 else 0.5,
            }

    messages = fx.messages(spark, sf)
    batches = pl.create_batches(messages, pl.filter_candidates(messages))
    return ex.extract_failures(ex.attempt_batches(batches, extractor))


@register(
    "parse_extractions",
    f"""WITH {MSGS}, {CANDS}, {NUMBERED}
SELECT chat_id, batch_no::BIGINT AS batch_no, (nth % 5)::INT AS pos, message_id,
  true AS is_important, 'request' AS type, NULL::VARCHAR AS task, NULL::VARCHAR AS deadline,
  'low' AS priority, 0.5::DOUBLE AS confidence, message AS evidence
FROM numbered WHERE batch_no % 5 NOT IN (3, 4)""",
)
def parse_extractions(spark, sf):
    """Answers in JSON; some batches are cut off, some lack a required field."""
    numbered = add_batch_numbers(pl.filter_candidates(fx.messages(spark, sf)))
    result = F.struct(
        "place",
        "message_id",
        F.lit(True).alias("is_important"),
        F.lit("request").alias("type"),
        F.lit("low").alias("priority"),
        F.lit(0.5).alias("confidence"),
        F.col("message").alias("evidence"),
    )
    text = F.to_json(F.struct(F.array_sort(F.collect_list(result)).alias("results")))
    answers = numbered.groupBy("chat_id", "batch_no").agg(text.alias("answer"))
    broken = (
        F.when(F.col("batch_no") % 5 == 3, F.expr("left(answer, length(answer) - 7)"))
        .when(F.col("batch_no") % 5 == 4, F.replace("answer", F.lit("confidence"), F.lit("certainty")))
        .otherwise(F.col("answer"))
    )
    return pl.parse_extractions(answers.withColumn("answer", broken))


@register(
    "join_extractions",
    f"""WITH {MSGS}, {CANDS}, {NUMBERED}
SELECT chat_id, message_id, date, "user", message, candidate_score, candidate_reason,
  CASE WHEN message_id % 4 = 0 THEN false ELSE true END AS is_important,
  CASE WHEN message_id % 4 = 0 THEN 'information' ELSE 'task' END AS type, message AS task,
  NULL::VARCHAR AS deadline, 'low' AS priority, 0.5::DOUBLE AS confidence, message AS evidence
FROM numbered WHERE message_id % 6 <> 0""",
)
def join_extractions(spark, sf):
    """No answer for every sixth message, two for every fourth, and some for foreign ids."""
    numbered = add_batch_numbers(pl.filter_candidates(fx.messages(spark, sf)))
    mid = F.col("message_id")

    def result(message_id, pos, important, kind):
        return F.struct(
            message_id.alias("message_id"),
            F.lit(pos).alias("pos"),
            F.lit(important).alias("is_important"),
            F.lit(kind).alias("type"),
        )

    answers = numbered.select(
        "chat_id",
        "batch_no",
        F.col("message").alias("task"),
        F.lit(None).cast("string").alias("deadline"),
        F.lit("low").alias("priority"),
        F.lit(0.5).alias("confidence"),
        F.col("message").alias("evidence"),
        F.inline(
            F.array_compact(
                F.array(
                    F.when(mid % 6 != 0, result(mid, 0, True, "task")),
                    F.when((mid % 4 == 0) & (mid % 6 != 0), result(mid, 1, False, "information")),
                    F.when(mid % 5 == 0, result(mid + 10_000_000, 2, True, "task")),
                )
            )
        ),
    )
    return ex.join_extractions(numbered, answers)


# --- results to validate ------------------------------------------------------------------------

_RAW_TYPE = """CASE event_id % 7 WHEN 0 THEN 'task' WHEN 1 THEN 'INVALID_TYPE' WHEN 2 THEN 'request'
  WHEN 3 THEN 'deadline' WHEN 4 THEN ' Decision ' WHEN 5 THEN 'none' ELSE 'information' END"""
_RAW_EVIDENCE = """CASE event_id % 7 WHEN 0 THEN message WHEN 1 THEN message
  WHEN 3 THEN 'not in the chat' WHEN 4 THEN upper(message)
  WHEN 6 THEN replace(message, ' ', '  ') END"""
_RAW_TASK = "CASE event_id % 3 WHEN 0 THEN message WHEN 1 THEN 'None' END"
_RAW_DEADLINE = "CASE event_id % 3 WHEN 0 THEN 'tomorrow' WHEN 1 THEN 'null' END"
_RAW_PRIORITY = """CASE event_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'INVALID_PRIORITY'
  WHEN 2 THEN 'medium' END"""
_RAW_CONFIDENCE = """CASE WHEN event_id % 11 = 0 THEN 'abc' WHEN event_id % 4 = 0 THEN '0.95'
  WHEN event_id % 4 = 1 THEN '1.5' WHEN event_id % 4 = 2 THEN '-0.2' END"""


def ai_raw(spark, sf):
    """Results as a careless model returns them; `seq` keeps their order."""
    found = pl.filter_candidates(fx.messages(spark, sf))
    variants = F.expr(
        f"""array_compact(array(
          struct(message_id * 2 AS seq, {_RAW_CONFIDENCE} AS confidence,
            concat(message_id, CASE WHEN event_id % 13 = 0 THEN '.0' ELSE '' END) AS message_id),
          CASE WHEN event_id % 14 = 0 THEN
            struct(message_id * 2 + 1 AS seq, '0.1' AS confidence,
              string(message_id) AS message_id) END,
          CASE WHEN event_id % 17 = 0 THEN
            struct(message_id * 2 + 1 AS seq, '0.1' AS confidence, 'x12' AS message_id) END,
          CASE WHEN event_id % 50 = 0 THEN
            struct(message_id * 2 + 1 AS seq, '0.1' AS confidence, '-1' AS message_id) END))"""
    )
    return found.select(
        "chat_id",
        *ex.CANDIDATE_COLUMNS,
        F.lit(True).alias("is_important"),
        F.expr(_RAW_TYPE).alias("type"),
        F.expr(_RAW_TASK).alias("task"),
        F.expr(_RAW_DEADLINE).alias("deadline"),
        F.expr(_RAW_PRIORITY).alias("priority"),
        F.expr(_RAW_EVIDENCE).alias("evidence"),
        F.inline(variants),
    )


def validated(spark, sf):
    return pl.validate_results(ai_raw(spark, sf), fx.messages(spark, sf), seq="seq")


_RAW_ROWS = f"""chat_id, date, "user", message, candidate_score, candidate_reason,
    true AS is_important, {_RAW_TYPE} AS type, {_RAW_TASK} AS task, {_RAW_DEADLINE} AS deadline,
    {_RAW_PRIORITY} AS priority, {_RAW_EVIDENCE} AS evidence"""


def _clean(x: str) -> str:
    return f"CASE WHEN lower({s_strip(x)}) NOT IN ('', 'none', 'null', 'nan') THEN {s_strip(x)} END"


_TYPES = "('task', 'request', 'deadline', 'decision', 'information', 'none')"
AI = f"""raw AS (
  SELECT {_RAW_ROWS}, message_id * 2 AS seq, {_RAW_CONFIDENCE} AS confidence,
    message_id || CASE WHEN event_id % 13 = 0 THEN '.0' ELSE '' END AS message_id FROM cands
  UNION ALL SELECT {_RAW_ROWS}, message_id * 2 + 1, '0.1', message_id::VARCHAR FROM cands
    WHERE event_id % 14 = 0
  UNION ALL SELECT {_RAW_ROWS}, message_id * 2 + 1, '0.1', 'x12' FROM cands WHERE event_id % 17 = 0
  UNION ALL SELECT {_RAW_ROWS}, message_id * 2 + 1, '0.1', '-1' FROM cands
    WHERE event_id % 50 = 0),
cleaned AS (
  SELECT chat_id, date, "user", message, candidate_score, candidate_reason, is_important, seq,
    trunc(try_cast(message_id AS DOUBLE))::BIGINT AS message_id,
    CASE WHEN {s_strip("lower(type)")} IN {_TYPES} THEN {s_strip("lower(type)")} ELSE 'none' END AS type,
    {_clean("task")} AS task, {_clean("deadline")} AS deadline,
    CASE WHEN {s_strip("lower(priority)")} IN ('low', 'medium', 'high')
      THEN {s_strip("lower(priority)")} ELSE 'low' END AS priority,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(try_cast(confidence AS DOUBLE), 0.0)))::DOUBLE
      AS confidence,
    {_clean("evidence")} AS evidence
  FROM raw),
judged AS (
  SELECT cleaned.*, CASE WHEN evidence IS NULL THEN type <> 'none' ELSE
      NOT contains({s_collapse("lower(context_text)")}, {s_collapse("lower(evidence)")}) END AS bad
  FROM cleaned JOIN (SELECT chat_id, message_id, context_text FROM ctx) USING (chat_id, message_id)),
grounded AS (
  SELECT chat_id, message_id, date, "user", message, candidate_score, candidate_reason, seq,
    is_important AND NOT bad AS is_important, CASE WHEN bad THEN 'none' ELSE type END AS type,
    CASE WHEN NOT bad THEN task END AS task, CASE WHEN NOT bad THEN deadline END AS deadline,
    priority, confidence, CASE WHEN NOT bad THEN evidence END AS evidence
  FROM judged),
ai AS (
  SELECT * EXCLUDE (seq) FROM grounded
  QUALIFY row_number() OVER (PARTITION BY chat_id, message_id ORDER BY seq) = 1)"""

ALL_AI = f"{MSGS}, {CANDS}, {_contexts('msgs')}, {AI}"


@register("validate_results", f"WITH {ALL_AI} SELECT * FROM ai")
def validate_results(spark, sf):
    return validated(spark, sf)


@register("ground_results", f"WITH {ALL_AI} SELECT * FROM grounded")
def ground_results(spark, sf):
    cleaned = va.clean_fields(ai_raw(spark, sf))
    contexts = context_text_for(cleaned, fx.messages(spark, sf))
    return va.ground(cleaned.join(contexts, ["chat_id", "message_id"])).drop("context_text")


@register("ai_results_csv_roundtrip", f"WITH {ALL_AI} SELECT * FROM ai")
def ai_results_csv_roundtrip(spark, sf):
    path = fx.scratch_dir(spark)
    schema = with_chat_type(AI_RESULTS, T.LongType())
    pl.write_results_csv(validated(spark, sf).select(*AI_RESULTS.fieldNames()), path)
    return pl.read_results_csv(spark, path, schema)


# --- actions ------------------------------------------------------------------------------------

_KEY = f"""coalesce(nullif({s_action_key("task")}, ''), {s_action_key("message")})"""
ACTIONS = f"""keyed AS (SELECT *, {_KEY} AS action_key, {s_deadline_key("deadline")} AS deadline_key FROM ai),
actions AS (
  SELECT * EXCLUDE (action_key, deadline_key) FROM keyed
  QUALIFY row_number() OVER (PARTITION BY chat_id, action_key, deadline_key
    ORDER BY confidence DESC,
      CASE type WHEN 'deadline' THEN 4 WHEN 'task' THEN 3 WHEN 'request' THEN 2
        WHEN 'decision' THEN 1 ELSE 0 END DESC, date NULLS LAST, message_id) = 1)"""
ALL_ACTIONS = f"{ALL_AI}, {ACTIONS}"


@register("dedup_actions", f"WITH {ALL_ACTIONS} SELECT * FROM actions")
def dedup_actions(spark, sf):
    return pl.deduplicate_actions(validated(spark, sf))


@register(
    "dedup_summary",
    f"""WITH {ALL_ACTIONS} SELECT chat_id, count(DISTINCT (action_key, deadline_key)) AS unique_actions,
  count(*) AS results FROM keyed GROUP BY chat_id""",
)
def dedup_summary(spark, sf):
    return pl.dedup_summary(validated(spark, sf)).select(
        "chat_id", "unique_actions", F.col("results").cast("bigint").alias("results")
    )


@register(
    "ai_summary",
    f"""WITH {ALL_AI} SELECT chat_id, count(*) AS results, count(*) FILTER (type = 'task') AS tasks,
  count(*) FILTER (type = 'request') AS requests, count(*) FILTER (type = 'deadline') AS deadlines
FROM ai GROUP BY chat_id""",
)
def ai_summary(spark, sf):
    return pl.summary(validated(spark, sf))


_SHOWN = 'chat_id, message_id, "user", message, type, task, deadline, priority, confidence, evidence'


@register(
    "actionable_table",
    f"""WITH {ALL_ACTIONS} SELECT {_SHOWN} FROM actions
WHERE type IN ('task', 'request', 'deadline', 'decision')""",
)
def actionable_table(spark, sf):
    return pl.actionable(pl.deduplicate_actions(validated(spark, sf)))


@register(
    "actions_by_id",
    f"""WITH {ALL_ACTIONS} SELECT {_SHOWN}, row_number() OVER (PARTITION BY chat_id ORDER BY message_id) AS place
FROM actions WHERE type IN ('task', 'request', 'deadline', 'decision')""",
)
def actions_by_id(spark, sf):
    return act.in_message_order(pl.actionable(pl.deduplicate_actions(validated(spark, sf))))


@register(
    "results_by_date",
    f"""WITH {ALL_AI} SELECT *, row_number() OVER (
  PARTITION BY chat_id ORDER BY date NULLS LAST, message_id) AS place FROM ai""",
)
def results_by_date(spark, sf):
    return va.number_by_date(validated(spark, sf))


@register(
    "dashboard_filter",
    f"WITH {ALL_ACTIONS} SELECT {_SHOWN} FROM actions WHERE type = 'task' AND priority = 'high'",
)
def dashboard_filter(spark, sf):
    actions = pl.deduplicate_actions(validated(spark, sf))
    return pl.filter_actions(actions, "Tasks", "High").select("chat_id", *act.ACTION_COLUMNS)


@register(
    "dashboard_sections",
    f"""WITH {ALL_ACTIONS}, s AS (SELECT *, CASE WHEN priority = 'high' THEN 'High Priority'
    ELSE CASE type WHEN 'deadline' THEN 'Deadlines' WHEN 'task' THEN 'Tasks'
      WHEN 'request' THEN 'Requests' WHEN 'decision' THEN 'Decisions' END END AS section FROM actions)
SELECT chat_id, message_id, type, confidence, section,
  coalesce(task, CASE WHEN section = 'Deadlines' THEN 'Deadline mentioned' ELSE message END) AS headline,
  CASE section WHEN 'High Priority' THEN coalesce(deadline, 'Not specified')
    WHEN 'Deadlines' THEN coalesce(deadline, 'Date not specified') END AS deadline_text,
  coalesce(nullif(evidence, ''), 'No evidence available.') AS evidence_text
FROM s WHERE section IS NOT NULL""",
)
def dashboard_sections(spark, sf):
    return pl.dashboard(validated(spark, sf)).select(
        "chat_id", "message_id", "type", "confidence", "section", "headline", "deadline_text",
        "evidence_text",
    )


@register(
    "action_source",
    f"""WITH {ALL_ACTIONS} SELECT a.chat_id, a.message_id AS target_id, m.message_id, m.date, m."user",
  m.message, m.message_id = a.message_id AS is_current
FROM actions a JOIN msgs m ON m.chat_id = a.chat_id
  AND m.message_id BETWEEN a.message_id - 2 AND a.message_id + 2""",
)
def action_source(spark, sf):
    return pl.action_source(
        pl.deduplicate_actions(validated(spark, sf)), fx.messages(spark, sf)
    )


# --- search -------------------------------------------------------------------------------------

def s_dot(a: str, b: str) -> str:
    return f"list_dot_product(({a})::DOUBLE[], ({b})::DOUBLE[])"


def s_unit(v: str) -> str:
    return f"list_transform(({v})::DOUBLE[], lambda x: x / sqrt({s_dot(v, v)}))::FLOAT[]"


_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def query_vector(spark, sf):
    """The embedding with id 0 as a scalar subquery: one row, read inside the job."""
    rows = fx.table(spark, sf, "embeddings")
    return rows.where("vec_id = 0").select(vec.unit(F.col("embedding")).alias("v")).scalar()


@register(
    "vector_topk",
    f"""SELECT vec_id, label, round({s_dot('embedding', _QUERY_VECTOR)}, 6) AS semantic_score
FROM embeddings ORDER BY {s_dot('embedding', _QUERY_VECTOR)} DESC, vec_id LIMIT 25""",
)
def vector_topk(spark, sf):
    rows = fx.table(spark, sf, "embeddings")
    query = rows.where("vec_id = 0").select("embedding").scalar()
    return se.top_k(rows, query, 25, "vec_id", "embedding").select(
        "vec_id", "label", F.round("semantic_score", 6).alias("semantic_score")
    )


def vector_index(spark, sf):
    """Searchable messages with the driver's vectors in place of an encoder's."""
    vectors = fx.table(spark, sf, "embeddings").select("vec_id", vec.unit(F.col("embedding")).alias("vector"))
    count = fx.table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    return (
        fx.messages(spark, sf)
        .where(kw.searchable(F.col("message")))
        .select(
            "chat_id", "message_id", "date", "user", "message", (F.col("event_id") % count).alias("vec_id")
        )
        .join(vectors, "vec_id")
        .drop("vec_id")
    )


_SEARCHABLE = f"""{fx.s_word_count("message")} >= 3 AND lower({s_strip("message")})
    NOT IN ({", ".join(quote(s) for s in kw.UNSEARCHABLE)})"""
_ASKED = quote(fx.QUESTION)


def s_hits(scored: str) -> str:
    """Nearest, scored and ranked hits of messages with a semantic score s."""
    return f"""near AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY s DESC, message_id) AS semantic_rank
  FROM ({scored})
  QUALIFY semantic_rank <= 25),
hits AS (
  SELECT *, 0.60::DOUBLE * s + 0.25::DOUBLE * keyword_score + 0.15::DOUBLE * ai_score AS score
  FROM (SELECT near.*, ai.type, ai.task, ai.deadline, ai.priority, ai.confidence, ai.evidence,
      {s_overlap(_ASKED, "near.message")} AS keyword_score,
      {s_overlap(_ASKED, "concat_ws(' ', ai.type, ai.task, ai.deadline, ai.evidence)")} AS ai_score
    FROM near LEFT JOIN ai USING (chat_id, message_id))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY score DESC, semantic_rank)::INT AS rank
  FROM hits QUALIFY rank <= 5)"""


HITS = s_hits(f"""SELECT m.chat_id, m.message_id, m.date, m."user", m.message,
      {s_dot(s_unit("e.embedding"), "q.v")} AS s
    FROM msgs m JOIN embeddings e ON m.event_id % (SELECT count(*) FROM embeddings) = e.vec_id,
      (SELECT {s_unit("embedding")} AS v FROM embeddings WHERE vec_id = 0) q
    WHERE {_SEARCHABLE}""")
ALL_HITS = f"{ALL_AI}, {HITS}"
_SCORES = ["semantic_score", "keyword_score", "ai_score", "score"]


@register(
    "search_with_ai",
    f"""WITH {ALL_HITS} SELECT chat_id, message_id, semantic_rank::INT AS semantic_rank, type, evidence,
  round(s, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score,
  round(ai_score, 6) AS ai_score, round(score, 6) AS score FROM hits""",
)
def search_with_ai(spark, sf):
    """The nearest 25 messages of each chat with all partial scores."""
    near = se.nearest(
        vector_index(spark, sf), query_vector(spark, sf), 25, ["chat_id"], "message_id"
    )
    hits = se.score_hits(se.with_results(near, validated(spark, sf)), fx.QUESTION)
    return hits.select(
        "chat_id", "message_id", "semantic_rank", "type", "evidence",
        *[F.round(c, 6).alias(c) for c in _SCORES],
    )


_SHOWN_HITS = """SELECT chat_id, rank, message_id, "user", message, type, task, deadline,
  priority, confidence, evidence, round(s, 6) AS semantic_score,
  round(keyword_score, 6) AS keyword_score, round(ai_score, 6) AS ai_score,
  round(score, 6) AS score, context_text AS context
FROM ranked JOIN (SELECT chat_id, message_id, context_text FROM ctx) USING (chat_id, message_id)"""


def shown_hits(hits):
    lines = F.transform("context", lambda m: F.concat_ws(": ", m.user, m.message))
    fields = ["type", "task", "deadline", "priority", "confidence", "evidence"]
    return hits.select(
        "chat_id", "rank", "message_id", "user", "message",
        *[F.col(f"ai_result.{c}").alias(c) for c in fields],
        *[F.round(c, 6).alias(c) for c in _SCORES],
        F.array_join(lines, "\n").alias("context"),
    )


@register("hybrid_search", f"WITH {ALL_HITS} {_SHOWN_HITS}")
def hybrid_search(spark, sf):
    hits = pl.search(
        vector_index(spark, sf),
        fx.messages(spark, sf),
        fx.QUESTION,
        query_vector(spark, sf),
        validated(spark, sf),
    )
    return shown_hits(hits)


_SAY = {name: text.replace("%s", "{}") for name, text in se.ANSWERS.items()}


@register(
    "grounded_answer",
    f"""WITH {ALL_HITS}, first AS (
  SELECT * FROM ranked WHERE type IN ('task', 'request', 'deadline', 'decision')
  QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY rank) = 1)
SELECT chat_id, message_id, evidence, priority, confidence, CASE type
  WHEN 'deadline' THEN CASE
    WHEN task IS NOT NULL AND deadline IS NOT NULL
      THEN format({quote(_SAY['deadline with task'])}, task, deadline)
    WHEN deadline IS NOT NULL THEN format({quote(_SAY['deadline'])}, deadline)
    ELSE {quote(_SAY['bare deadline'])} END
  WHEN 'task' THEN CASE WHEN task IS NOT NULL THEN format({quote(_SAY['task'])}, task)
    ELSE {quote(_SAY['bare task'])} END
  WHEN 'request' THEN CASE WHEN task IS NOT NULL THEN format({quote(_SAY['request'])}, task)
    ELSE {quote(_SAY['bare request'])} END
  ELSE {quote(_SAY['decision'])} END AS answer
FROM first""",
)
def grounded_answer(spark, sf):
    ranked = pl.rank_hits(
        vector_index(spark, sf), fx.QUESTION, query_vector(spark, sf), validated(spark, sf)
    )
    return pl.grounded_answer(ranked)


@register(
    "ai_relevance",
    f"""WITH {ALL_AI} SELECT chat_id, message_id, round({s_overlap(_ASKED,
  "concat_ws(' ', type, task, deadline, evidence)")}, 6) AS ai_score FROM ai""",
)
def ai_relevance(spark, sf):
    score = kw.keyword_score(F.lit(fx.QUESTION), kw.facts_text())
    return validated(spark, sf).select(
        "chat_id", "message_id", F.round(score, 6).alias("ai_score")
    )


LETTERS = "aeioutsn"


def letter_counts(texts: list[str]) -> list[list[int]]:
    """A model that SQL can restate: how often each of a few letters occurs."""
    return [[t.lower().count(c) for c in LETTERS] for t in texts]


def s_letters(text: str) -> str:
    counts = (f"len({text}) - len(replace(lower({text}), '{c}', ''))" for c in LETTERS)
    return f"[{', '.join(counts)}]::DOUBLE[]"


def s_numbers(vector: str) -> str:
    each = (f"round(({vector})[{i}]::DOUBLE, 6) AS v{i}" for i in range(1, len(LETTERS) + 1))
    return ", ".join(each)


def numbers():
    each = (F.get("vector", F.lit(i)).cast("double") for i in range(len(LETTERS)))
    return [F.round(x, 6).alias(f"v{i}") for i, x in enumerate(each, 1)]


@register(
    "embed_messages",
    f"""SELECT conv_id AS chat_id, turn + 1 AS message_id, {s_numbers(s_letters("text"))}
FROM conversations""",
)
def embed_messages(spark, sf):
    rows = pl.FunctionEncoder(letter_counts).transform(fx.conversation_messages(spark, sf))
    return rows.select("chat_id", "message_id", *numbers())


_TERMS = f"""list_filter(string_split({s_normalize("text")}, ' '), lambda w: w <> '')"""
_DIMENSIONS_SQL = f"""list_transform({_TERMS}, lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 256)::INT)"""


@register(
    "embed_hashing",
    f"""WITH t AS (SELECT conv_id AS chat_id, turn + 1 AS message_id, {_DIMENSIONS_SQL} AS dims FROM conversations),
df AS (SELECT d, count(*) AS n FROM (SELECT unnest(list_distinct(dims)) AS d FROM t) GROUP BY d),
tf AS (SELECT chat_id, message_id, d, count(*) AS n FROM (SELECT chat_id, message_id, unnest(dims) AS d FROM t) GROUP BY ALL)
SELECT chat_id, message_id, d::INT AS dimension,
  round((tf.n * ln(((SELECT count(*) FROM t) + 1)::DOUBLE / (df.n + 1)))::FLOAT::DOUBLE, 4) AS weight
FROM tf JOIN df USING (d) WHERE weight <> 0""",
)
def embed_hashing(spark, sf):
    """The offline encoder: one row per message and dimension in use."""
    rows = fx.conversation_messages(spark, sf)
    encoded = pl.HashingEncoder.fit(rows).transform(rows)
    each = encoded.select("chat_id", "message_id", F.posexplode("vector").alias("dimension", "weight"))
    weight = F.round(F.col("weight").cast("double"), 4)
    return each.select("chat_id", "message_id", "dimension", weight.alias("weight")).where("weight <> 0")


_STRIPPED = s_letters(s_strip("message"))


@register(
    "search_index",
    f"""WITH {MSGS} SELECT chat_id, message_id, date, "user", message, {s_numbers(s_unit(_STRIPPED))}
FROM msgs WHERE {_SEARCHABLE}""",
)
def search_index(spark, sf):
    index = pl.build_index(fx.messages(spark, sf), pl.FunctionEncoder(letter_counts))
    return index.select("chat_id", "message_id", "date", "user", "message", *numbers())


_BY_LETTERS = f"""SELECT chat_id, message_id, date, "user", message,
      {s_dot(s_unit(_STRIPPED), s_unit(s_letters(_ASKED)))} AS s
    FROM msgs WHERE {_SEARCHABLE}"""


@register(
    "ask_question",
    f"""WITH {MSGS}, {CANDS}, {_contexts('msgs')}, {RULES}, ai AS (SELECT * FROM rules),
{s_hits(_BY_LETTERS)} {_SHOWN_HITS}""",
)
def ask_question(spark, sf):
    """From text to hits: the question is encoded like the messages."""
    messages, encoder = fx.messages(spark, sf), pl.FunctionEncoder(letter_counts)
    index = pl.build_index(messages, encoder)
    return shown_hits(pl.ask(messages, index, encoder, fx.QUESTION, pl.analyze_chat(messages)))
