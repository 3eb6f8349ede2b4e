"""Normalisation of extracted fields and the test of evidence against its context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# --- fixed values -------------------------------------------------------------------------
TYPES = ["task", "request", "deadline", "decision", "information", "none"]
ACTIONABLE = ["task", "request", "deadline", "decision"]
PRIORITIES = ["low", "medium", "high"]
NULL_WORDS = ["", "none", "null", "nan"]
FILLER_WORDS = ["provided", "the", "a", "an"]
TYPE_RANK = {"deadline": 4, "task": 3, "request": 2, "decision": 1}
NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)$"
# ------------------------------------------------------------------------------------------


def clean_value(col: Column) -> Column:
    """Stripped text, or null for blanks and the written-out forms of null."""
    text = tx.strip(col.cast("string"))
    return F.when(~F.lower(text).isin(NULL_WORDS), text)


def _one_of(col: Column, allowed: list[str], fallback: str) -> Column:
    text = tx.strip(F.lower(col.cast("string")))
    return F.when(text.isin(allowed), text).otherwise(fallback)


def clean_type(col: Column) -> Column:
    return _one_of(col, TYPES, "none")


def clean_priority(col: Column) -> Column:
    return _one_of(col, PRIORITIES, "low")


def to_number(col: Column) -> Column:
    """Numeric value of a text, null when it is none (NaN included).

    The pattern keeps out forms a cast would accept, such as ``1.5d`` or hex floats.
    """
    text = tx.strip(col.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def clean_confidence(col: Column) -> Column:
    number = F.coalesce(to_number(col), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))


def clean_message_id(col: Column) -> Column:
    """Integer id, fractions cut off; null when it is no number."""
    exact = tx.strip(col.cast("string")).try_cast("bigint")
    return F.coalesce(exact, to_number(col).try_cast("bigint"))


def evidence_in(evidence: Column, context: Column) -> Column:
    """Is the evidence a part of the context, up to case and runs of whitespace?"""
    needle, hay = F.lower(tx.strip(evidence)), F.lower(tx.strip(context))
    loose = tx.collapse_spaces(hay).contains(tx.collapse_spaces(needle))
    found = (needle != "") & (hay != "") & (hay.contains(needle) | loose)
    return F.coalesce(found, F.lit(False))


def action_key(text: Column, unicode_keys: bool = False) -> Column:
    """Wording-insensitive identity of an action; `''` when nothing is left.

    By default only ASCII letters and digits count, so texts in other scripts get an empty
    key; ``unicode_keys=True`` keeps letters and digits of every script.
    """
    kept = r"\p{L}\p{M}\p{Nd}" if unicode_keys else "a-z0-9"
    plain = F.regexp_replace(F.lower(tx.strip(text)), f"[^{kept}{tx.WS}]", " ")
    words = F.filter(tx.split_words(plain), lambda w: ~w.isin(FILLER_WORDS))
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def deadline_key(text: Column) -> Column:
    return F.coalesce(tx.collapse_spaces(tx.strip(F.lower(text))), F.lit(""))


def type_rank(col: Column) -> Column:
    rank = F.lit(0)
    for name, value in TYPE_RANK.items():
        rank = F.when(F.lower(col) == name, value).otherwise(rank)
    return rank
