"""Export parsing: header grammar, date rules, both plans against a plain re-statement."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

import parley as pl
from parley.functions import timestamps as ts
from parley.schema import MESSAGES
from parley.sources import exports

YEAR = 2026

# Expected dates of headers, null where the row is dropped.
STAMPS = {
    "12/09/26, 10:30 pm": dt.datetime(2026, 9, 12, 22, 30),
    "12/09/2026, 10:30 PM": dt.datetime(2026, 9, 12, 22, 30),
    "12/09/2026, 10:30pm": dt.datetime(2026, 9, 12, 22, 30),
    "12/09/2026, 10:30 pm": dt.datetime(2026, 9, 12, 22, 30),
    "12/25/2026, 1:05 am": dt.datetime(2026, 12, 25, 1, 5),
    "25/12/26, 1:05 AM": dt.datetime(2026, 12, 25, 1, 5),
    "12/25/26, 1:05 AM": dt.datetime(2026, 12, 25, 1, 5),
    "1/2/99, 1:00 am": dt.datetime(1999, 2, 1, 1, 0),
    "1/2/76, 1:00 am": dt.datetime(1976, 2, 1, 1, 0),
    "1/2/75, 1:00 am": dt.datetime(2075, 2, 1, 1, 0),
    "12/09/26, 0:30 am": dt.datetime(2026, 9, 12, 0, 30),
    "12/09/26, 12:30 am": dt.datetime(2026, 9, 12, 0, 30),
    "12/09/26, 0:30 pm": dt.datetime(2026, 9, 12, 12, 30),
    "12/09/26, 12:30 pm": dt.datetime(2026, 9, 12, 12, 30),
    "1/1/1600, 1:00 am": None,
    "1/1/2300, 1:00 am": None,
    "1/2/202, 1:00 am": None,
    "31/02/2026, 1:00 am": None,
    "13/13/2026, 1:00 am": None,
    "0/5/26, 1:00 am": None,
    "12/09/26, 13:30 pm": None,
    "12/09/26, 10:60 pm": None,
    "32/1/05, 1:05 am": None,
}


def test_stamps(spark):
    rows = spark.createDataFrame([(s,) for s in STAMPS], "stamp string")
    got = rows.select("stamp", F.expr(ts.stamp_to_date("stamp", YEAR)).alias("d")).collect()
    assert {r.stamp: r.d for r in got} == STAMPS


def whole(spark, text):
    df = spark.createDataFrame([("c", text)], "chat_id string, text string")
    return pl.parse_texts(df, YEAR)


def rows(df):
    return [
        tuple(r) for r in df.select("message_id", "date", "user", "message").orderBy("message_id").collect()
    ]


SAMPLE = (
    "junk before 1/2 - \n"
    "12/09/26, 10:30 pm - Ann: hello - there\nsecond line\n"
    "12/09/26, 10:31 pm - Messages are encrypted\n"
    "12/09/26, 10:32 pm - Security code of Bob: changed\n"
    "31/02/26, 10:33 pm - Ann: lost, the date is impossible\n"
    "12/09/26, 10:34 pm - Bob: quoting 13/09/26, 1:00 am - Ann: old\n"
    "12/09/26,\n\n 10:35\npm\n-\n Eve :  spread over lines \n"
    "12/09/26, 10:36 pm - "
)
D = dt.datetime
EXPECTED = [
    (1, D(2026, 9, 12, 22, 30), "Ann", "hello - there\nsecond line"),
    (2, D(2026, 9, 12, 22, 31), "group_notification", "Messages are encrypted"),
    (3, D(2026, 9, 12, 22, 32), "Security code of Bob", "changed"),
    (4, D(2026, 9, 12, 22, 34), "Bob", "quoting"),
    (5, D(2026, 9, 13, 1, 0), "Ann", "old"),
    (6, D(2026, 9, 12, 22, 35), "Eve", "spread over lines"),
    (7, D(2026, 9, 12, 22, 36), "group_notification", ""),
]


def test_whole_text(spark):
    df = whole(spark, SAMPLE)
    assert df.columns == MESSAGES.fieldNames()
    assert rows(df) == EXPECTED


def write_bytes(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.txt").write_bytes(text.encode("utf-8"))
    return str(folder)


TAILS = ["", "x", "see 12/09/26, 10:40 pm", "12/09/26, 10:40 pm -", " -\n"]


@pytest.mark.parametrize("split_bytes", [61, 1 << 20])
def test_files_in_both_plans(spark, tmp_path, split_bytes):
    """Split files give what whole files give, wherever the splits fall."""
    files = {f"a{i}": SAMPLE + tail for i, tail in enumerate(TAILS)}
    path = write_bytes(tmp_path, **files, b="\ufeff" + SAMPLE, c="no header", d=" \n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        split = pl.read_exports(spark, path, YEAR, whole_file_bytes=-1)
        one = pl.read_exports(spark, path, YEAR)
        keys = ["chat_id", *MESSAGES.fieldNames()[1:]]
        a, b = (sorted(map(tuple, df.select(*keys).collect())) for df in (split, one))
        assert a == b
        assert len([r for r in a if r[0].endswith("b.txt")]) == len(EXPECTED)
        for limit in (-1, 1 << 30):
            bad = pl.export_rejects(spark, path, limit).collect()
            assert [r.chat_id.rsplit("/", 1)[1] for r in bad] == ["c.txt"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_strict_names_the_file(spark, tmp_path):
    path = write_bytes(tmp_path, good=SAMPLE, bad="nothing")
    with pytest.raises(ValueError, match="bad.txt"):
        pl.read_exports(spark, path, YEAR, strict=True)


def test_size_filter_prunes_files(spark, tmp_path):
    path = write_bytes(tmp_path, small="x", large="y" * 1000)
    small = exports.scan_texts(spark, path, 10)
    assert [r.text for r in small.collect()] == ["x"]
    assert [r.piece for r in exports.scan_pieces(spark, path, 10).collect()] == ["-" + "y" * 1000]


HEADER = re.compile(
    r"(\d{1,2})/(\d{1,2})/(\d{2,4}),\s*(\d{1,2}):(\d{2})\s*[AaPp][Mm]\s*-\s*"
)


def readable(first, second, year, hour, minute):
    day, month = (second, first) if int(second) > 12 >= int(first) else (first, second)
    year = {2: "20" + year, 4: year}.get(len(year), "0")
    try:
        dt.datetime(int(year), int(month), int(day), int(hour) % 12, int(minute))
    except ValueError:
        return False
    return int(hour) <= 12 and 1678 <= int(year) <= 2261


def restated(text):
    """Blocks of the messages with readable dates, by scanning."""
    found = list(HEADER.finditer(text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    blocks = [(m.groups(), text[m.end() : e].strip()) for m, e in zip(found, ends)]
    return [block for stamp, block in blocks if readable(*stamp)]


FRAGMENTS = [
    "12/09/26", "1/2/2026", "112/9/26", ",", " ", "\n", "10:30", "1:05", "pm", "Am", "-", " - ",
    "Ann", ":", "hi", "/", "7", "12/09/26, 10:30 pm - ", "1/2/26, 1:00 am -",
]


def test_random_texts(spark):
    """Both plans segment random mixes of header parts like the plain scan."""
    dice = random.Random(7)
    texts = ["".join(dice.choices(FRAGMENTS, k=dice.randrange(60))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "chat_id long, text string")
    one = pl.parse_texts(df, YEAR)
    split = pl.parse_pieces(exports.pieces_of(df.withColumn("split", F.lit(0))), YEAR)
    expected = []
    for i, text in enumerate(texts):
        for number, block in enumerate(restated(text), 1):
            head, colon, rest = block.partition(":")
            has = bool(colon and head and "\n" not in head)
            user, message = (head.strip(), rest.strip()) if has else ("group_notification", block)
            expected.append((i, number, user, message))
    assert len(expected) > 3000
    for got in (one, split):
        fields = got.select("chat_id", "message_id", "user", "message").collect()
        assert sorted(map(tuple, fields)) == sorted(expected)


def test_blank_text_gives_typed_empty_table(spark):
    df = whole(spark, " \n ")
    assert df.count() == 0 and df.columns == MESSAGES.fieldNames()
    assert [f.dataType for f in df.schema] == [f.dataType for f in MESSAGES]


def test_stream_of_exports(spark, tmp_path):
    from parley.streaming.exports import stream_exports

    inbox = tmp_path / "in"
    inbox.mkdir()
    write_bytes(inbox, a=SAMPLE)
    scored = pl.score_messages(stream_exports(spark, str(inbox), YEAR))
    query = (
        scored.writeStream.format("memory")
        .queryName("arrivals")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .start()
    )
    try:
        query.processAllAvailable()
        write_bytes(inbox, b=SAMPLE)
        query.processAllAvailable()
        arrived = rows(spark.table("arrivals"))
        assert sorted(arrived) == sorted(EXPECTED * 2)
    finally:
        query.stop()
