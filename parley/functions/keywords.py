"""Keyword overlap between a question and a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# --- fixed values -------------------------------------------------------------------------
QUESTION_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "do", "did", "does",
    "what", "when", "where", "who", "how", "why", "which", "about", "with", "for",
    "from", "to", "of", "in", "on", "and", "or", "me", "we", "i",
    "you", "my", "our", "it", "need",
]
MIN_KEYWORD = 3
# Deleted or omitted messages, lower-cased.
UNSEARCHABLE = ["<media omitted>", "you deleted this message", "this message was deleted"]
MIN_SEARCHABLE_WORDS = 3
# Share of vector, keyword and extracted-fact similarity in the combined score.
WEIGHT_SEMANTIC, WEIGHT_KEYWORD, WEIGHT_FACTS = 0.60, 0.25, 0.15
OVERFETCH = 5
# ------------------------------------------------------------------------------------------


def normalize(text: Column) -> Column:
    """Lower case, no URLs, only ASCII letters, digits and single spaces."""
    lowered = F.regexp_replace(F.lower(text), tx.FULL_URL, " ")
    ascii_only = F.regexp_replace(lowered, f"[^a-z0-9{tx.WS}]", " ")
    return tx.strip(tx.collapse_spaces(ascii_only))


def keywords(text: Column) -> Column:
    words = F.split(normalize(text), " ")
    return F.filter(
        words, lambda w: (F.length(w) >= MIN_KEYWORD) & ~w.isin(QUESTION_STOP_WORDS)
    )


def overlap(question_words: Column, text: Column) -> Column:
    """Share of distinct question keywords that the text holds; 0 when either has none."""
    asked = F.array_distinct(question_words)
    found = F.size(F.array_intersect(asked, keywords(text)))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(
        F.coalesce(found / F.size(asked), F.lit(0.0))
    )


def keyword_score(question: Column, text: Column) -> Column:
    return overlap(keywords(question), text)


def facts_text(prefix: str = "") -> Column:
    """Type, task, deadline and evidence of an extracted result as one text."""
    return F.concat_ws(" ", *[F.col(prefix + c) for c in ("type", "task", "deadline", "evidence")])


def searchable(message: Column) -> Column:
    text = tx.strip(message)
    return F.coalesce(
        ~F.lower(text).isin(UNSEARCHABLE) & (tx.word_count(text) >= MIN_SEARCHABLE_WORDS),
        F.lit(False),
    )
