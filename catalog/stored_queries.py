"""Registered queries that write files or stored layouts first and work on those."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

import parley as pl
from parley.functions import vectors as vec
from parley.schema import AI_RESULTS, MESSAGES, with_chat_type

from . import action_queries as aq
from . import fixtures as fx
from .chat_queries import CANDS, ORACLES, QUERIES, _flat, register
from .fixtures import MSGS, quote

__all__ = ["ORACLES", "QUERIES"]

# --- export files -------------------------------------------------------------------------------


def export_files(spark, sf) -> str:
    """A folder chat_id=<id> for each chat with its rendered export as one file."""
    path = fx.scratch_dir(spark)
    # the writer ends every text with the line end that is cut here
    texts = fx.export_texts(spark, sf).withColumn("text", F.expr("left(text, length(text) - 1)"))
    dealt = texts.repartition("chat_id").sortWithinPartitions("chat_id", "split")
    dealt.select("chat_id", "text").write.partitionBy("chat_id").text(path)
    return path


def read_both(spark, path):
    """Even chats as whole files, odd ones in pieces."""
    whole = pl.read_exports(spark, f"{path}/chat_id=[02468]/*", fx.PIVOT_YEAR)
    pieces = pl.read_exports(spark, f"{path}/chat_id=[13579]/*", fx.PIVOT_YEAR, whole_file_bytes=0)
    number = F.regexp_extract("chat_id", "chat_id=([0-9]+)", 1).cast("bigint")
    return whole.unionByName(pieces).withColumn("chat_id", number)


@register("parse_export_files", ORACLES["parse_export"])
def parse_export_files(spark, sf):
    """Messages of export files, read by both plans."""
    return read_both(spark, export_files(spark, sf)).select("chat_id", *MESSAGES.fieldNames()[1:])


@register("export_files_actions", ORACLES["analyze_chat"])
def export_files_actions(spark, sf):
    """From export files to checked actions."""
    return pl.analyze_chat(read_both(spark, export_files(spark, sf)))


# --- results as CSV -----------------------------------------------------------------------------


@register("ai_results_csv_split", ORACLES["ai_results_csv_roundtrip"])
def ai_results_csv_split(spark, sf):
    """Results with line breaks in their texts, written as CSV and read by file splits."""
    path = fx.scratch_dir(spark)
    schema = with_chat_type(AI_RESULTS, T.LongType())
    pl.write_results_csv(aq.validated(spark, sf).select(*AI_RESULTS.fieldNames()), path)
    return pl.read_results_csv_split(spark, path, schema)


@register("stop_words_file", ORACLES["stop_words"])
def stop_words_file(spark, sf):
    """A word list read from a text file: the lines of all documents."""
    path = fx.scratch_dir(spark)
    lines = fx.table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    lines.write.text(path)
    return pl.read_stop_words(spark, path)


# --- extraction by a caller's function -------------------------------------------------------------


@register(
    "analyze_chat_extractor",
    f"""WITH {MSGS}, {CANDS}
SELECT chat_id, message_id, date, "user", message, CASE WHEN message_id % 3 = 0 THEN 'none' ELSE 'task' END AS type,
  CASE WHEN message_id % 3 <> 0 THEN message END AS task, 'low' AS priority, 0.5::DOUBLE AS confidence,
  message_id % 3 <> 0 AS is_important, CASE WHEN message_id % 3 <> 0 THEN message END AS evidence
FROM cands""",
)
def analyze_chat_extractor(spark, sf):
    """The whole analysis with a model in place of the rules; every third answer quotes what nobody wrote."""

    def extractor(batch):
        return [
            {
                "message_id": item["message_id"],
                "is_important": True,
                "type": "task",
                "task": item["context"]["current"]["message"],
                "priority": "low",
                "confidence": 0.5,
                "evidence": "nobody wrote this" if item["message_id"] % 3 == 0 else item["context"]["current"]["message"],
            }
            for item in batch
        ]

    found = pl.analyze_chat(fx.messages(spark, sf), extractor=extractor)
    return found.select(
        "chat_id", "message_id", "date", "user", "message", "type", "task", "priority", "confidence", "is_important", "evidence"
    )


# --- stored layouts -----------------------------------------------------------------------------


@register("context_stored", ORACLES["context_join"])
def context_stored(spark, sf):
    """The context of candidates out of a table stored by chat and block of ids."""
    messages = pl.store_messages(fx.messages(spark, sf))
    return pl.context_for(pl.filter_candidates(messages), messages).select(
        "chat_id",
        "message_id",
        _flat("context.previous").alias("previous"),
        _flat(F.array("context.current")).alias("current"),
        _flat("context.next").alias("next"),
    )


@register("search_stored", ORACLES["hybrid_search"])
def search_stored(spark, sf):
    """Hits with their context out of a stored table."""
    hits = pl.search(
        aq.vector_index(spark, sf),
        pl.store_messages(fx.messages(spark, sf)),
        fx.QUESTION,
        aq.query_vector(spark, sf),
        aq.validated(spark, sf),
    )
    return aq.shown_hits(hits)


# --- many questions -----------------------------------------------------------------------------

_SCORE = aq.s_dot("r.embedding", "q.embedding")


@register(
    "vector_topk_many",
    f"""SELECT q.vec_id AS question_id, r.vec_id, r.label, round({_SCORE}, 6) AS semantic_score,
  (row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SCORE} DESC, r.vec_id))::INTEGER AS semantic_rank
FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0
QUALIFY semantic_rank <= 10""",
)
def vector_topk_many(spark, sf):
    """The ten nearest rows of each twentieth vector, from a clustered index."""
    rows = fx.table(spark, sf, "embeddings").select(
        F.lit(0).alias("corpus"), "vec_id", "label", F.col("embedding").alias("vector")
    )
    index = pl.cluster_index(rows, by="corpus")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "vector")
    return pl.nearest_each(index, asked, 10, "vec_id").select(
        "question_id", "vec_id", "label", F.round("semantic_score", 6).alias("semantic_score"), "semantic_rank"
    )


_QUESTIONS = [fx.QUESTION, "who can share the notes before 10th?", "what did we decide about react?", " "]
_ASKED_SQL = ", ".join(f"({i}, {quote(q)})" for i, q in enumerate(_QUESTIONS))


def questions(spark, sf):
    """Questions with the vectors of the first embeddings."""
    texts = F.array(*map(F.lit, _QUESTIONS))
    rows = fx.table(spark, sf, "embeddings").where(F.col("vec_id") < len(_QUESTIONS))
    return rows.select(
        F.col("vec_id").alias("question_id"),
        F.get(texts, F.col("vec_id").cast("int")).alias("question"),
        vec.unit(F.col("embedding")).alias("vector"),
    )


def _s_many() -> str:
    one = aq.HITS.replace(aq._ASKED, "question")
    one = one.replace("m.chat_id, m.message_id, m.date", "q.question_id, q.question, m.chat_id, m.message_id, m.date")
    one = one.replace("PARTITION BY chat_id", "PARTITION BY question_id, chat_id")
    return one.replace(
        f"(SELECT {aq.s_unit('embedding')} AS v FROM embeddings WHERE vec_id = 0) q",
        f"""(SELECT question_id, question, {aq.s_unit('embedding')} AS v
      FROM (VALUES {_ASKED_SQL}) asked(question_id, question) JOIN embeddings ON vec_id = question_id
      WHERE trim(question) <> '') q""",
    )


@register(
    "search_many",
    f"""WITH {aq.ALL_AI}, {_s_many()}
SELECT question_id::BIGINT AS question_id, question, chat_id, rank, message_id, type, evidence,
  round(s, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score, round(ai_score, 6) AS ai_score,
  round(score, 6) AS score FROM ranked""",
)
def search_many(spark, sf):
    """A table of questions answered in one job; blank ones give nothing."""
    index = pl.cluster_index(aq.vector_index(spark, sf), clusters=32)
    ranked = pl.rank_hits_each(index, questions(spark, sf), aq.validated(spark, sf))
    return ranked.select(
        "question_id", "question", "chat_id", "rank", "message_id", "type", "evidence",
        *[F.round(c, 6).alias(c) for c in aq._SCORES],
    )
