"""CSV files read by many tasks against the reader that takes whole files."""

import random

import pytest

from parley.sources import results

SCHEMA = "a string, b long, c string"
PIECES = ['"', '""', ",", "\n", "\r\n", "x", "long text here", "é😀", " ", "''", "7", "\t"]


def field(value, dice):
    if value is None:
        return ""
    if any(c in value for c in '",\n\r') or dice.random() < 0.3:
        return '"' + value.replace('"', '""') + '"'
    return value


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "211")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def text(dice, end):
    lines = ["a,b,c"]
    for _ in range(dice.randrange(60, 140)):
        a, c = ("".join(dice.choices(PIECES, k=dice.randrange(9))) or None for _ in "ac")
        lines.append(",".join([field(a, dice), str(dice.randrange(10**6)), field(c, dice)]))
    return end.join(lines) + dice.choice(["", end])


def parsed(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_random_files_in_small_splits(spark, tmp_path, small_splits):
    from pyspark.sql import types as T

    dice = random.Random(5)
    for i, end in enumerate(["\n", "\r\n", "\n"]):
        (tmp_path / f"f{i}.csv").write_bytes((("﻿" if i == 2 else "") + text(dice, end)).encode())
    schema = T.StructType.fromDDL(SCHEMA)
    whole = parsed(results.read_results_csv(spark, str(tmp_path), schema))
    lines = results.scan_lines(spark, str(tmp_path))
    assert lines.select("file", "split").distinct().count() > 30
    split = parsed(results.read_results_csv_split(spark, str(tmp_path), schema))
    assert len(whole) > 150 and split == whole


def test_one_text_over_many_splits(spark, tmp_path, small_splits):
    from pyspark.sql import types as T

    long = "\n".join(f"line {i}, with a comma" for i in range(400))
    body = f'a,b,c\n"{long}",1,"x ""quoted"""\nplain,2,\n\n,3,"{long}"\n'
    (tmp_path / "one.csv").write_text(body)
    schema = T.StructType.fromDDL(SCHEMA)
    got = parsed(results.read_results_csv_split(spark, str(tmp_path), schema))
    want = sorted([(long, 1, 'x "quoted"'), ("plain", 2, None), (None, 3, long)], key=repr)
    assert got == want == parsed(results.read_results_csv(spark, str(tmp_path), schema))


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b,c\n")
    assert results.read_results_csv_split(spark, str(tmp_path)).count() == 0


def test_byte_order_mark(spark, tmp_path):
    import glob

    import pandas as pd
    from pyspark.sql import types as T

    rows = spark.createDataFrame([("é, ü", 1, "two\nlines"), (None, 2, 'a "b"')], SCHEMA).coalesce(1)
    path = str(tmp_path / "out")
    results.write_results_csv(rows, path)
    (part,) = glob.glob(path + "/part-*.csv")
    assert open(part, "rb").read(3) == b"\xef\xbb\xbf"
    frame = pd.read_csv(part, encoding="utf-8-sig")
    assert list(frame.columns) == ["a", "b", "c"] and frame["c"][0] == "two\nlines" and frame["a"][0] == "é, ü"
    schema = T.StructType.fromDDL(SCHEMA)
    for read in (results.read_results_csv, results.read_results_csv_split):
        assert parsed(read(spark, path, schema)) == parsed(rows)
    plain = str(tmp_path / "plain")
    results.write_results_csv(rows, plain, byte_order_mark=False)
    assert open(glob.glob(plain + "/part-*.csv")[0], "rb").read(1) != b"\xef"


def test_endings(spark, tmp_path):
    from pyspark.sql import functions as F

    from parley.functions import text as tx
    from parley.sources.endings import read_endings

    (tmp_path / "endings.dat").write_text("// comment\ncom\nco.uk\n*.ck\n!www.ck\n\nрф // Russia\nhorse # note\n")
    endings = read_endings(spark, str(tmp_path / "endings.dat"))
    assert endings == ["ck", "com", "horse", "uk", "рф", "xn--p1ai"]
    texts = ["my.horse a.b.co.uk пример.рф xn--e1afmkfd.xn--p1ai", "no.link 1.5 e.g. this", "x.com.Then go", "me@my.horse",
             "a." * 50_000, "x.com/a.horse/b", None]
    frame = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in frame.select(tx.link_count(F.col("v"), endings)).collect()]
    assert got == [4, 0, 1, 0, 0, 1, None]
    with pytest.raises(ValueError):
        tx.links(F.col("v"), ["x"] * 20_001)
