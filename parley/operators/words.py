"""Word and emoji tables per chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..schema import GROUP_NOTIFICATION
from ..sources.stopwords import default_stop_words
from .stats import filter_user

#: Names the built-in stop-word list; None means no list.
BUILT_IN = "built-in"
TOP_WORDS = 20
CLOUD_WORDS = 200


def spoken(messages: DataFrame) -> DataFrame:
    """Messages people typed: no notifications, no media placeholders."""
    return messages.where(
        (F.col("user") != GROUP_NOTIFICATION) & ~tx.is_media(F.col("message"))
    )


def without_stop_words(words: DataFrame, stop_words: DataFrame | str | None) -> DataFrame:
    """Anti-join on the word. Catalyst picks the join by the real size of the list."""
    if isinstance(stop_words, str):
        if stop_words != BUILT_IN:
            raise ValueError(f"no stop-word list is called {stop_words!r}")
        stop_words = default_stop_words(words.sparkSession)
    return words if stop_words is None else words.join(stop_words, "word", "left_anti")


def _tokens(messages: DataFrame, user: str | None, *columns: str) -> DataFrame:
    """(columns, pos, word), one row per clean word of the typed messages."""
    # Lower-cased word by word: lower() has a fast way for ASCII that a single accent in a long
    # text would rule out. Cleaned inside the generator, so that the filter on the word is not
    # pushed below it, where it would clean every word a second time.
    words = F.transform(
        tx.split_words(F.col("message")), lambda w: tx.strip_edges(F.lower(w))
    )
    tokens = spoken(filter_user(messages, user)).select(
        *columns, F.posexplode(words).alias("pos", "word")
    )
    return tokens.where("word != ''")


def _first_use() -> Column:
    """Place of the first use: by message, then by position in it.

    One decimal instead of a struct, because hash aggregation needs fixed-width buffers.
    """
    return F.min(F.expr("decimal(message_id) * 4294967296BD + pos").cast("decimal(38,0)"))


def word_counts(
    messages: DataFrame, user: str | None = None, stop_words: DataFrame | str | None = BUILT_IN
) -> DataFrame:
    """(chat_id, word, n): counted first, so the anti-join sees distinct words only."""
    counted = (
        _tokens(messages, user, "chat_id").groupBy("chat_id", "word").agg(F.count(F.lit(1)).alias("n"))
    )
    return without_stop_words(counted, stop_words)


def top_words(
    messages: DataFrame,
    user: str | None = None,
    stop_words: DataFrame | str | None = BUILT_IN,
    top: int = TOP_WORDS,
) -> DataFrame:
    """The most frequent words of each chat; equal counts in order of first use."""
    counted = (
        _tokens(messages, user, "chat_id", "message_id")
        .groupBy("chat_id", "word")
        .agg(F.count(F.lit(1)).alias("n"), _first_use().alias("first_use"))
    )
    best = Window.partitionBy("chat_id").orderBy(F.desc("n"), "first_use")
    return (
        without_stop_words(counted, stop_words)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .drop("first_use")
    )


def word_weights(
    messages: DataFrame,
    user: str | None = None,
    stop_words: DataFrame | str | None = BUILT_IN,
    top: int = CLOUD_WORDS,
) -> DataFrame:
    """Words of a word cloud with their weight relative to the most frequent one."""
    best = Window.partitionBy("chat_id").orderBy(F.desc("n"), "word")
    ranked = (
        word_counts(messages, user, stop_words)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )
    return ranked.withColumn(
        "weight", F.round(F.col("n") / F.max("n").over(Window.partitionBy("chat_id")), 6)
    )


def clean_corpus(
    messages: DataFrame, stop_words: list[str] | DataFrame, user: str | None = None
) -> DataFrame:
    """Each typed message as its cleaned words in one string.

    A short list is filtered inside the row; a table of any size is anti-joined by word, and the
    words of each message are put together again.
    """
    typed = spoken(filter_user(messages, user))
    if not isinstance(stop_words, DataFrame):
        return typed.withColumn("clean_text", tx.remove_stop_words(F.col("message"), stop_words))
    key = ["chat_id", "message_id"]
    kept = without_stop_words(_tokens(messages, user, *key), stop_words).groupBy(*key)
    placed = F.array_sort(F.collect_list(F.struct("pos", "word")))
    texts = kept.agg(F.array_join(F.transform(placed, lambda w: w.word), " ").alias("clean_text"))
    return typed.join(texts, key, "left").withColumn("clean_text", F.coalesce("clean_text", F.lit("")))


def emoji_counts(messages: DataFrame, user: str | None = None, sequences: bool = False) -> DataFrame:
    """Emoji of each chat by frequency; equal counts in order of first use.

    Counts code points, or with `sequences` flags, keycaps, skin tones and joined emoji as they are seen.
    """
    counted = (
        filter_user(messages, user)
        .select(
            "chat_id", "message_id", F.posexplode(tx.emojis(F.col("message"), sequences)).alias("pos", "emoji")
        )
        .groupBy("chat_id", "emoji")
        .agg(F.count(F.lit(1)).alias("n"), _first_use().alias("first_use"))
    )
    best = Window.partitionBy("chat_id").orderBy(F.desc("n"), "first_use")
    return counted.withColumn("rank", F.row_number().over(best)).drop("first_use")


def emoji_share(
    messages: DataFrame, user: str | None = None, top: int = 5, sequences: bool = False
) -> DataFrame:
    """Share of the `top` emoji among themselves, in percent with one decimal."""
    leading = emoji_counts(messages, user, sequences).where(F.col("rank") <= top)
    total = F.sum("n").over(Window.partitionBy("chat_id"))
    return leading.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / total, 1))
