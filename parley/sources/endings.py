"""Endings of host names: a file with one per line, as the public lists of suffixes and top-level domains have them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import MOST_ENDINGS, strip


def with_punycode(endings: list[str]) -> list[str]:
    """The endings, and the ASCII form of those with other letters."""
    found = dict.fromkeys(endings)
    for ending in endings:
        try:
            found[ending.encode("idna").decode("ascii").lower()] = None
        except UnicodeError:
            continue
    return list(found)


def read_endings(spark: SparkSession, path: str) -> list[str]:
    """Last labels of the endings in a file, lower-case, also in ASCII form, in order.

    Blank lines and comments after ``//`` or ``#`` are left out, and so are the marks of wildcards and exceptions. The
    list is small by nature; one of more than MOST_ENDINGS labels raises an error.
    """
    rule = strip(F.regexp_replace("value", r"(?://|#).*$", ""))
    label = F.lower(F.element_at(F.split(F.element_at(F.split(rule, "[ \t]+"), 1), r"\."), -1))
    rows = spark.read.text(path).where(rule != "").select(F.regexp_replace(label, r"^[!*]+", "").alias("ending"))
    found = rows.where("ending <> ''").distinct().orderBy("ending").limit(MOST_ENDINGS + 1).collect()
    if len(found) > MOST_ENDINGS:
        raise ValueError(f"{path} holds more than {MOST_ENDINGS} endings")
    return with_punycode([r.ending for r in found])
