"""Hybrid search: vector similarity, keyword overlap and extracted facts.

Every chat is a corpus of its own; filter the index by chat to search one. Per chat the
``5 * top_k`` nearest messages are scored further, as the ranking asks, and ``top_k`` remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cleaning as cl
from ..functions import keywords as kw
from ..functions import text as tx
from ..functions import vectors as vec
from .context import carry_neighbours, message_struct
from .validate import keep_first
from .vector_index import ClusteredIndex, nearest_each

AI_FIELDS = ["type", "task", "deadline", "priority", "confidence", "evidence", "is_important"]


def build_index(messages: DataFrame, encoder, strict: bool = False) -> DataFrame:
    """Searchable messages with a unit `vector` column; write it to parquet to keep it.

    ``strict=True`` raises when nothing is searchable.
    """
    rows = messages.select("chat_id", "message_id", "date", "user", "message").where(
        kw.searchable(F.col("message"))
    )
    if strict and rows.isEmpty():
        raise ValueError("no searchable messages")
    encoded = encoder.transform(rows.withColumn("_text", tx.strip(F.col("message"))), "_text")
    return encoded.withColumn("vector", vec.unit(F.col("vector"))).drop("_text")


def _scored(rows: DataFrame, query_vector: Column, vector: str) -> DataFrame:
    # the query is a column of its own first: a subquery may not stand inside a lambda
    return (
        rows.withColumn("_query", query_vector)
        .withColumn("semantic_score", vec.dot(F.col(vector), F.col("_query")))
        .drop("_query")
    )


def nearest(
    rows: DataFrame, query_vector: Column, k: int, by: list[str], tie: str, vector: str = "vector"
) -> DataFrame:
    """The k rows of each group nearest to the query vector, exact.

    Adds `semantic_score` and `semantic_rank`. Spark cuts each partition to its own best k
    before rows are shuffled.
    """
    best = Window.partitionBy(*by).orderBy(F.desc("semantic_score"), tie)
    return (
        _scored(rows, query_vector, vector)
        .withColumn("semantic_rank", F.row_number().over(best))
        .where(F.col("semantic_rank") <= k)
    )


def top_k(rows: DataFrame, query_vector: Column, k: int, tie: str, vector: str = "vector") -> DataFrame:
    """The k rows nearest to the query vector in the whole table, exact."""
    return _scored(rows, query_vector, vector).orderBy(F.desc("semantic_score"), tie).limit(k)


def with_results(
    hits: DataFrame, results: DataFrame | None, seq: str | None = None, also: tuple[str, ...] = ()
) -> DataFrame:
    """Left-join the extracted result of each hit.

    Of several results for one message the first by the column ``seq`` counts; without it, the
    first in the order of their fields. Hits are unique by message and the columns ``also``.
    """
    if results is None:
        kinds = {"confidence": "double", "is_important": "boolean"}
        return hits.withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in AI_FIELDS})
    found = F.struct(*[F.col(seq)] if seq else [], *AI_FIELDS).alias("_found")
    joined = hits.join(
        results.select("chat_id", "message_id", found), ["chat_id", "message_id"], "left"
    )
    # joined before it is reduced, so only results of hits are compared
    return keep_first(joined, "_found", also).select(*hits.columns, *[f"_found.{c}" for c in AI_FIELDS])


def score_hits(hits: DataFrame, question: str | Column) -> DataFrame:
    """Add keyword, fact and combined scores to nearest rows joined with their results.

    The question is a text, or a column of the hits.
    """
    asked = kw.keywords(F.lit(question) if isinstance(question, str) else question)
    return (
        hits.withColumn("keyword_score", kw.overlap(asked, F.col("message")))
        .withColumn("ai_score", kw.overlap(asked, kw.facts_text()))
        .withColumn(
            "score",
            F.lit(kw.WEIGHT_SEMANTIC) * F.col("semantic_score")
            + F.lit(kw.WEIGHT_KEYWORD) * F.col("keyword_score")
            + F.lit(kw.WEIGHT_FACTS) * F.col("ai_score"),
        )
    )


def rank_hits(
    index: DataFrame,
    question: str,
    query_vector: Column,
    results: DataFrame | None = None,
    top_k: int = 5,
    seq: str | None = None,
) -> DataFrame:
    """The best `top_k` messages per chat with all scores and `rank`; no context yet.

    A blank question gives no rows.
    """
    if not question or not question.strip():
        index = index.where(F.lit(False))
    near = nearest(index, query_vector, kw.OVERFETCH * top_k, ["chat_id"], "message_id").drop(
        "vector"
    )
    best = Window.partitionBy("chat_id").orderBy(F.desc("score"), "semantic_rank")
    return (
        score_hits(with_results(near, results, seq), question)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top_k)
    )


def rank_hits_each(
    index: ClusteredIndex,
    questions: DataFrame,
    results: DataFrame | None = None,
    top_k: int = 5,
    seq: str | None = None,
) -> DataFrame:
    """``rank_hits`` for a table of questions (question_id, question, vector) on a clustered index.

    One job answers all of them; rows have the columns question_id and question. Blank questions give no rows.
    """
    asked = questions.where(~tx.is_blank(F.coalesce("question", F.lit(""))))
    near = nearest_each(index, asked, kw.OVERFETCH * top_k, "message_id").drop(index.vector)
    near = near.join(asked.select("question_id", "question"), "question_id")
    found = with_results(near, results, seq, ("question_id",))
    best = Window.partitionBy("question_id", "chat_id").orderBy(F.desc("score"), "semantic_rank")
    return (
        score_hits(found, F.col("question"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top_k)
    )


def attach_hit_context(hits: DataFrame, messages: DataFrame, window: int = 2) -> DataFrame:
    """Add `context`, the messages around each hit including itself."""
    return carry_neighbours(hits, messages, window, message_struct(), "context")


def search(
    index: DataFrame,
    messages: DataFrame,
    question: str,
    query_vector: Column,
    results: DataFrame | None = None,
    top_k: int = 5,
    window: int = 2,
) -> DataFrame:
    """Ranked hits with scores, context and the extracted result as a struct."""
    ranked = attach_hit_context(
        rank_hits(index, question, query_vector, results, top_k), messages, window
    )
    found = F.when(F.col("type").isNotNull(), F.struct(*AI_FIELDS))
    return ranked.withColumn("ai_result", found).drop("semantic_rank", *AI_FIELDS)


# --- fixed values: answer sentences -------------------------------------------------------
ANSWERS = {
    "deadline with task": "You need to **%s** **%s**.",
    "deadline": "The relevant deadline is **%s**.",
    "bare deadline": "A deadline was found in the conversation.",
    "task": "The conversation indicates that you need to **%s**.",
    "bare task": "A task was identified in the conversation.",
    "request": "The conversation contains a request related to **%s**.",
    "bare request": "A request related to your question was found.",
    "decision": "A decision related to your question was found in the conversation.",
}
# ------------------------------------------------------------------------------------------


def answer_text() -> Column:
    """Sentence for a result by its type and the fields it has."""
    task, deadline = F.col("task"), F.col("deadline")
    has_task = F.coalesce(task != "", F.lit(False))
    has_deadline = F.coalesce(deadline != "", F.lit(False))
    kind = F.col("type")
    say = F.format_string
    return (
        F.when(
            (kind == "deadline") & has_task & has_deadline,
            say(ANSWERS["deadline with task"], task, deadline),
        )
        .when((kind == "deadline") & has_deadline, say(ANSWERS["deadline"], deadline))
        .when(kind == "deadline", ANSWERS["bare deadline"])
        .when((kind == "task") & has_task, say(ANSWERS["task"], task))
        .when(kind == "task", ANSWERS["bare task"])
        .when((kind == "request") & has_task, say(ANSWERS["request"], task))
        .when(kind == "request", ANSWERS["bare request"])
        .when(kind == "decision", ANSWERS["decision"])
    )


def grounded_answer(ranked: DataFrame) -> DataFrame:
    """One answer per chat from its best-ranked hit with an actionable result.

    Chats without such a hit give no row. `ranked` comes from ``rank_hits``.
    """
    first = Window.partitionBy("chat_id").orderBy("rank")
    return (
        ranked.where(F.col("type").isin(cl.ACTIONABLE))
        .withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .select(
            "chat_id", answer_text().alias("answer"), "message_id", "evidence", "priority", "confidence"
        )
    )
