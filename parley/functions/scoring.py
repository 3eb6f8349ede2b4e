"""How likely is a message to hold a task, request, deadline or decision?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# --- fixed values: signal patterns, weights and threshold ---------------------------------
ACTION = [
    r"\b(submit|complete|finish|prepare|create|make|update|fix|review|fill|solve|send|share)\b",
    r"\b(bhar de|bhar do|bhej de|bhej do|bhej dena|send kar|share kar)\b",
    r"\b(check kar|check karke|bata dena|bata do|bata de|pta krke|pata karke)\b",
    r"\b(kar dena|kar do|kar de|kr dena|kr do|kr de|karke bhej)\b",
    r"\b(ans bhej|answer bhej|questions solve|form bhar)\b",
]
REQUEST = [
    r"\b(can you|could you|would you|please|pls|plz)\b",
    r"\b(mujhe.*bhej|mujhe.*chahiye)\b",
    r"\b(ek baar.*bata|ek bar.*bata)\b",
]
DEADLINE = [
    r"\b(today|tomorrow|tonight|morning|evening)\b",
    r"\b(aaj|kal|raat|subah|shaam)\b",
    r"\b(deadline|due|before|within|by)\b",
    r"\b(baje|bje)\b",
    r"\b(submit.*\d+|assignment.*\d+)\b",
    r"\b\d{1,2}(st|nd|rd|th)\b",
]
DECISION = [
    r"\b(decide|decided|decision|final|finalized|choose|selected|agreed)\b",
    r"\b(decide kar|decide kr|final kar|select kar)\b",
    r"\b(we will|we'll|lets|let's)\b",
]
# Two-word small talk; one-word small talk is already below the token minimum.
SMALL_TALK = ["good morning", "good night"]
SIGNALS = [
    ("action", 3, ACTION),
    ("request", 2, REQUEST),
    ("deadline", 3, DEADLINE),
    ("decision", 2, DECISION),
]
QUESTION_WEIGHT = 1
CANDIDATE_THRESHOLD = 3
# ------------------------------------------------------------------------------------------

# Unicode word boundaries and digits; '.' stops at '\n' only.
_FLAGS = "(?Ud)"
# Letters that equal an ASCII one when case is ignored although lower() keeps them.
_FOLD_FROM, _FOLD_TO = "\u0131\u017f", "is"


def any_of(patterns: list[str]) -> str:
    """One alternation per family: a text is walked once, and its word starts tested once."""
    edge = r"\b"
    assert all(p.startswith(edge) and p.endswith(edge) for p in patterns)
    inner = "|".join(p[len(edge) : -len(edge)] for p in patterns)
    return f"{edge}(?:{inner}){edge}"


def scoring_text(message: Column) -> Column:
    """What patterns are matched against: stripped, lower-cased, case-folded."""
    return F.translate(F.lower(tx.strip(message)), _FOLD_FROM, _FOLD_TO)


def is_small_talk(text: Column) -> Column:
    """Nothing in a scoring text worth a closer look: one word, a greeting or links only."""
    has_link = text.contains("http") | text.contains("www.")
    return (
        ~text.rlike(f"[{tx.WS}]")
        | text.isin(SMALL_TALK)
        | (has_link & tx.is_blank(F.regexp_replace(text, tx.FULL_URL, "")))
    )


def signals(text: Column) -> list[Column]:
    """Boolean columns `worth` and one per signal, of a scoring text."""
    flags = [text.rlike(_FLAGS + any_of(pats)).alias(name) for name, _, pats in SIGNALS]
    worth = F.coalesce(~is_small_talk(text), F.lit(False))
    return [worth.alias("worth"), *flags, text.contains("?").alias("question")]


FLAGS = ["worth", *[name for name, _, _ in SIGNALS], "question"]


def _weights() -> list[tuple[str, int]]:
    return [(name, w) for name, w, _ in SIGNALS] + [("question", QUESTION_WEIGHT)]


def score_of(flags: str) -> Column:
    """Sum of the weights of the signals under a prefix; 0 for small talk."""
    total = F.lit(0)
    for name, weight in _weights():
        total = total + F.when(F.col(flags + name), weight).otherwise(0)
    return F.when(F.col(flags + "worth"), total).otherwise(0).cast("int")


def reason_of(flags: str) -> Column:
    """Names of the signals under a prefix, comma-separated."""
    names = [F.when(F.col(flags + name), name) for name, _ in _weights()]
    return F.when(F.col(flags + "worth"), F.concat_ws(", ", *names)).otherwise("")
