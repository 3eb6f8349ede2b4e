"""Chat exports: text files with one chat each, cut into messages.

A message is everything from one header to the next, wherever headers stand in the text. Two
plans give the same rows:

* ``parse_texts`` parses whole texts where they are read. Segments, valid dates and message ids
  come out of array functions on the text, so nothing is shuffled. Right for the many exports
  that fit into memory.
* ``parse_pieces`` serves exports of any size. A header contains exactly one hyphen, its last
  mark, so the file is read in records that end at hyphens: no header ever lies across two
  records, and Spark may split the file anywhere. Records are numbered per file split, and only
  counts and the text at split borders cross splits.

``read_exports`` sends every file to the plan its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import timestamps as ts
from ..operators.numbering import slice_starts
from ..schema import GROUP_NOTIFICATION, MESSAGES
from ..storage import deal_by, store_by

WHOLE_FILE_BYTES = 64 * 1024 * 1024


def _first_match(pattern: str, col: Column) -> Column:
    return F.regexp_extract(col, pattern, 0)


def split_sender(raw: Column) -> tuple[Column, Column]:
    """(user, message) of a message block.

    The sender is the text before the first colon when it is on the first line; a block without
    one is a system notification.
    """
    block = tx.strip(raw)
    head = F.substring_index(block, ":", 1)
    has_sender = block.contains(":") & (head != "") & ~head.contains("\n")
    rest = F.substr(block, F.length(head) + F.lit(2))
    user = F.when(has_sender, tx.strip(head)).otherwise(GROUP_NOTIFICATION)
    return user, F.when(has_sender, tx.strip(rest)).otherwise(block)


def add_calendar(rows: DataFrame) -> DataFrame:
    """Calendar columns of `date`, and the hour period; no value depends on a time zone."""
    date, hour, day = F.col("date"), F.hour("date"), F.to_date("date")
    return rows.select(
        "*",
        F.year(date).alias("year"),
        F.month(date).alias("month_num"),
        F.date_format(day, "MMMM").alias("month"),
        day.alias("only_date"),
        F.day(date).alias("day"),
        F.date_format(day, "EEEE").alias("day_name"),
        hour.alias("hour"),
        F.minute(date).alias("minute"),
        F.format_string("%02d-%02d", hour, (hour + 1) % 24).alias("period"),
    )


def _to_messages(rows: DataFrame) -> DataFrame:
    """Rows (chat_id, message_id, date, raw) in the messages schema."""
    user, message = split_sender(F.col("raw"))
    shaped = rows.select("chat_id", "message_id", "date", user.alias("user"), message.alias("message"))
    return add_calendar(shaped).select(*MESSAGES.fieldNames())


def parse_texts(texts: DataFrame, pivot_year: int | None = None) -> DataFrame:
    """Messages of (chat_id, text), one row per chat, without a shuffle."""
    date = ts.stamp_to_date(f"regexp_extract(s, r'^{ts.STAMP}', 0)", pivot_year)
    dated = F.expr(
        f"""filter(
          transform(
            regexp_extract_all(text, r'(?s){ts.HEADER}.*?(?={ts.HEADER}|\\z)', 0),
            s -> struct(s AS segment, {date} AS date)),
          m -> m.date IS NOT NULL)"""
    )
    rows = texts.select("chat_id", F.posexplode(dated).alias("pos", "m")).select(
        "chat_id",
        (F.col("pos") + 1).cast("bigint").alias("message_id"),
        "m.date",
        F.regexp_replace("m.segment", f"^{ts.HEADER}", "").alias("raw"),
    )
    return _to_messages(rows)


def parse_pieces(pieces: DataFrame, pivot_year: int | None = None) -> DataFrame:
    """Messages of chats given as pieces (chat_id, split, pos, piece, open_end, size).

    The pieces of a chat in order of (split, pos) make up its text, and a piece holds no hyphen
    but a leading one. A header is the end of a piece that a hyphen follows; only the last piece of a split may lack
    one, which ``open_end`` tells, or, where that is null, the bytes of all pieces against the ``size`` of the file.

    The pieces are read once: segments are made by split and stored in buckets, and what crosses splits
    (counts, and text ahead of a split's first header) comes out of that table.
    """
    keys = ["chat_id", "split"]
    local = store_by(segments(deal_by(pieces, keys), pivot_year), keys, [*keys, "g"], dealt=True)
    placed = _placed(local)

    # joined where the text already lies, so each text is shuffled once
    rest = F.when(F.col("g") == F.col("headers"), F.col("rest"))
    whole = F.concat("text", F.coalesce(rest, F.lit("")))
    rows = (
        local.where((F.col("g") > 0) & F.col("date").isNotNull())
        .join(placed, ["chat_id", "split"])
        .where(F.col("g") <= F.col("headers"))
        .select(
            "chat_id",
            (F.col("dated_start") + F.col("nth")).alias("message_id"),
            "date",
            # the leading hyphen belongs to the header
            F.substr(whole, F.lit(2)).alias("raw"),
        )
    )
    return _to_messages(rows)


def segments(pieces: DataFrame, pivot_year: int | None = None) -> DataFrame:
    """Text of each message by split: (chat_id, split, g, text, date, nth, doubt, open_end, bytes, size).

    g counts the headers of a split and nth those with a readable date; g = 0 is the text ahead of the first. ``doubt`` is
    the end of the last piece of a split, which is a header unless no hyphen follows.
    """
    ends = ts.STAMP + rf"[{tx.WS}]*\z"
    in_split = Window.partitionBy("chat_id", "split").orderBy("pos")
    ahead = in_split.rowsBetween(Window.unboundedPreceding, -1)
    cut = pieces.withColumn("tail", _first_match(ends, F.col("piece"))).select(
        "chat_id",
        "split",
        "pos",
        "open_end",
        "size",
        F.octet_length("piece").cast("bigint").alias("bytes"),
        F.expr("left(piece, length(piece) - length(tail))").alias("body"),
        F.expr(ts.stamp_to_date("tail", pivot_year)).alias("date"),
        F.nullif(F.col("tail"), F.lit("")).alias("tail"),
    )
    numbered = cut.select(
        "*",
        F.lead(F.lit(1)).over(in_split).isNull().alias("is_last"),
        F.count("tail").over(ahead).alias("g"),
        F.count("date").over(ahead).alias("v"),
    )

    # A piece continues message g of its split; a header opens message g + 1.
    nothing = F.lit(None)
    continued = F.struct(
        F.col("g"),
        F.struct(F.col("pos"), F.col("body")).alias("part"),
        nothing.cast("timestamp_ntz").alias("date"),
        nothing.cast("bigint").alias("nth"),
        nothing.cast("string").alias("doubt"),
        F.col("bytes"),
    )
    opened = F.when(
        F.col("tail").isNotNull(),
        F.struct(
            (F.col("g") + 1).alias("g"),
            F.struct(F.col("pos"), F.lit("").alias("body")).alias("part"),
            F.col("date"),
            (F.col("v") + 1).alias("nth"),
            F.when(F.col("is_last"), F.col("tail")).alias("doubt"),
            F.lit(0).cast("bigint").alias("bytes"),
        ),
    )
    return (
        numbered.select(
            "chat_id", "split", "open_end", "size", F.inline(F.array_compact(F.array(continued, opened)))
        )
        .groupBy("chat_id", "split", "g")
        .agg(
            F.array_sort(F.collect_list("part")).alias("parts"),
            *[F.max(c).alias(c) for c in ("date", "nth", "doubt", "open_end", "size")],
            F.sum("bytes").alias("bytes"),
        )
        .withColumn("text", F.array_join(F.transform("parts", lambda p: p.body), ""))
        .withColumn("nth", F.when(F.col("date").isNotNull(), F.col("nth")))
        .drop("parts")
    )


def _placed(local: DataFrame) -> DataFrame:
    """(chat_id, split, headers, dated_start, rest): one row per split of stored segments.

    ``rest`` is text that belongs to the split's last message but lies ahead of the first header of later splits,
    or in a last piece that turned out to be no header.
    """
    chat = Window.partitionBy("chat_id")
    by_bytes = (F.col("split") == F.max("split").over(chat)) & (
        # the reader drops a three-byte order mark
        F.sum("bytes").over(chat) - F.col("size")
    ).isin(1, -2)
    counted = local.groupBy("chat_id", "split").agg(
        F.max("g").alias("g"),
        F.coalesce(F.max("nth"), F.lit(0)).alias("v"),
        F.max("doubt").alias("doubt"),
        F.max(F.col("doubt").isNotNull() & F.col("date").isNotNull()).alias("doubt_dated"),
        F.sum("bytes").alias("bytes"),
        *[F.max(c).alias(c) for c in ("open_end", "size")],
    )
    ghost = F.col("doubt").isNotNull() & F.coalesce("open_end", by_bytes)
    splits = counted.withColumn("ghost", ghost).select(
        "chat_id",
        "split",
        F.when(F.col("ghost"), F.col("doubt")).alias("doubt"),
        (F.col("g") - F.col("ghost").cast("bigint")).alias("headers"),
        (F.col("v") - (F.col("ghost") & F.col("doubt_dated")).cast("bigint")).alias("dated"),
    )
    splits = slice_starts(splits, "chat_id", "split", "headers", "dated", keep=["headers", "doubt"])
    splits = splits.withColumn("last_header", F.col("headers_start") + F.col("headers"))

    leads = (
        local.where((F.col("g") == 0) & (F.col("text") != ""))
        .select("chat_id", "split", F.lit(0).alias("place"), "text")
        .join(splits.select("chat_id", "split", F.col("headers_start").alias("last_header")), ["chat_id", "split"])
    )
    ghosts = splits.where(F.col("doubt").isNotNull()).select(
        "chat_id", "split", F.lit(1).alias("place"), F.col("doubt").alias("text"), "last_header"
    )
    rests = (
        leads.unionByName(ghosts)
        .where(F.col("last_header") > 0)
        .groupBy("chat_id", "last_header")
        .agg(F.array_sort(F.collect_list(F.struct("split", "place", "text"))).alias("rest"))
        .withColumn("rest", F.array_join(F.transform("rest", lambda r: r.text), ""))
    )
    return splits.join(rests, ["chat_id", "last_header"], "left").select(
        "chat_id", "split", "headers", "dated_start", "rest"
    )


def pieces_of(texts: DataFrame) -> DataFrame:
    """Pieces of (chat_id, split, text) rows; no header may lie across two splits."""
    parts = texts.select(
        "chat_id", "split", F.posexplode(F.split("text", "-", -1)).alias("pos", "part")
    )
    lead = F.when(F.col("pos") == 0, "").otherwise("-")
    return parts.select(
        "chat_id",
        "split",
        F.col("pos").cast("bigint").alias("pos"),
        F.concat(lead, "part").alias("piece"),
        F.lit(True).alias("open_end"),
        F.lit(None).cast("bigint").alias("size"),
    )


def scan_texts(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(chat_id, text): every file whole, up to a size when one is given."""
    files = spark.read.text(path, wholetext=True)
    if max_bytes is not None:
        files = files.where(F.col("_metadata.file_size") <= max_bytes)
    return files.select(
        F.col("_metadata.file_path").alias("chat_id"), F.col("value").alias("text")
    )


def scan_pieces(spark: SparkSession, path: str, min_bytes: int = -1) -> DataFrame:
    """Pieces of the files above a size, read in records that end at hyphens."""
    records = (
        spark.read.text(path, lineSep="-")
        .where(F.col("_metadata.file_size") > min_bytes)
        .select(
            F.col("_metadata.file_path").alias("chat_id"),
            F.col("_metadata.file_block_start").alias("split"),
            F.col("_metadata.file_size").alias("size"),
            # grows along a split, which one task reads in order
            F.monotonically_increasing_id().alias("pos"),
            "value",
        )
    )
    # records do not tell whether a hyphen follows the last one; the byte count does
    return records.select(
        "chat_id",
        "split",
        "pos",
        F.concat(F.lit("-"), "value").alias("piece"),
        F.lit(None).cast("boolean").alias("open_end"),
        "size",
    )


def read_exports(
    spark: SparkSession,
    path: str,
    pivot_year: int | None = None,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
    strict: bool = False,
) -> DataFrame:
    """Messages of all export files under a path, chat_id = file path.

    ``strict=True`` raises when a file holds no message header; otherwise see
    ``export_rejects``.
    """
    if strict:
        bad = export_rejects(spark, path, whole_file_bytes).limit(5).collect()
        if bad:
            raise ValueError(f"no message header in {[r.chat_id for r in bad]}")
    small = parse_texts(scan_texts(spark, path, whole_file_bytes), pivot_year)
    large = parse_pieces(scan_pieces(spark, path, whole_file_bytes), pivot_year)
    return small.unionByName(large)


def text_rejects(texts: DataFrame) -> DataFrame:
    """Chats of (chat_id, text) that are not blank and hold no header."""
    text = F.col("text")
    return texts.where(~tx.is_blank(text) & ~text.rlike(ts.HEADER)).select("chat_id")


def export_rejects(
    spark: SparkSession, path: str, whole_file_bytes: int = WHOLE_FILE_BYTES
) -> DataFrame:
    """Files under a path that are not blank and hold no header."""
    small = text_rejects(scan_texts(spark, path, whole_file_bytes))
    piece = F.col("piece")
    stamped = piece.rlike(ts.STAMP + rf"[{tx.WS}]*\z")
    # a stamp at an open end is no header
    open_end = (F.sum(F.octet_length("piece")) - F.max("size")).isin(1, -2)
    open_stamp = open_end & F.max_by(stamped, F.struct("split", "pos"))
    large = (
        scan_pieces(spark, path, whole_file_bytes)
        .groupBy("chat_id")
        .agg(
            (F.count_if(stamped) - open_stamp.cast("int")).alias("headers"),
            F.bool_or(~tx.is_blank(F.substr(piece, F.lit(2)))).alias("has_text"),
        )
        .where(F.col("has_text") & (F.col("headers") == 0))
        .select("chat_id")
    )
    return small.unionByName(large)
