"""Stop-word lists: a text source with one word per line, or a short built-in list."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

# Our own short list of frequent English and Hinglish words; bring a longer one as a file.
DEFAULT = """
a about all also am an and any are as at be because been but by can could did do does for from
get go had has have he her here him his how i if in into is it its just know like me more my no
not now of ok on one only or our out over she so some than that the their them then there they
this to too up us very was we well were what when which who why will with would yes you your
aur ab abhi acha bas bhai bhi bhar de dena do fir ha haan hai hain han ho hota hu hua hum ja jo
ka kal kar karo ke ki ko koi kuch kya le liye main mai mein mera mere mujhe na nahi ne pe par raha
rahe se sab tha the theek ti to toh tu tum voh wo woh ya ye yeh yaha
"""


def default_words() -> list[str]:
    return list(dict.fromkeys(DEFAULT.split()))


def normalize_words(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct lower-cased words of a column with one entry per row; blanks dropped."""
    word = F.lower(tx.strip(F.col(column)))
    return lines.select(word.alias("word")).where(F.col("word") != "").distinct()


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) from a text file or directory with one word per line; empty when there is none."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    return normalize_words(lines)


def default_stop_words(spark: SparkSession) -> DataFrame:
    """The built-in list as a table; its size is fixed, so it may always be broadcast."""
    words = F.array(*[F.lit(w) for w in default_words()])
    return F.broadcast(spark.range(1).select(F.explode(words).alias("word")))
