"""Pipeline stages on odd tables, and decontamination against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import decontamination, secrets, simhash, toxicity
from parley.llm.shared import unused


def test_unused_names():
    assert unused("row", ["text", "Row", "row_"]) == "row__" and unused("row", []) == "row"


ODD = "doc_id long, text string, lang string, source string, n_chars long, _row string, ROW string, row_ long, spans string, score string, toxic int"


def odd(spark, texts):
    rows = [(i, t, None, "s", len(t or ""), "keep", "me", 7, "as", "is", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], ODD)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    words = [f"w{i}" for i in range(400)]
    dice = random.Random(1)
    texts = [" ".join(dice.choices(words, k=60)) for _ in range(40)] + [None, "", 'token = "abcdefghijklmnop1234" and more']
    odd(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, texts[3])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts


def test_columns_of_the_user_stay_as_they_are(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert {tuple(r)[5:] for r in rows} == {("keep", "me", 7, "as", "is", 1)}, name
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None), name
        ids = collections.Counter(r.doc_id for r in rows)
        if name == "near_duplicates":
            # null and empty are one group, and repeated rows leave one
            assert set(ids) == set(range(43)) - {41} and set(ids.values()) == {1}
        if name == "decontamination":
            assert set(ids) == set(range(43)) - {3}
        if name == "secrets":
            assert len(rows) == 45 and {r.text for r in rows if r.doc_id == 42} == {'[secret]" and more'}


def test_whole_pipeline_and_empty_tables(spark, tables, tmp_path):
    folder, texts = tables
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(range(43)) - {3, 41}
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
    items = spark.createDataFrame([], "item_id long, text string")
    some = odd(spark, texts[:4])
    assert decontamination.without_leaks(some, items).count() == 6


def test_decontamination_equals_brute_force(spark):
    dice = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(dice.choices(vocabulary, k=k)) for k in (3, 8, 20, 40, 90)] + ["again and again and " * 8]
    texts = []
    for item in items * 8:
        words = item.split()
        changed = [w if dice.random() > 0.03 else "new" for w in words]
        texts.append(" ".join(dice.choices(vocabulary, k=dice.randrange(60)) + changed + dice.choices(vocabulary, k=dice.randrange(60))))

    def grams(words, width):
        return collections.Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))

    want, close = {}, set()
    for d, text in enumerate(texts):
        words = text.split()
        for n, item in enumerate(items):
            target = item.split()
            width = min(5, len(target))
            mine, best = grams(target, width), 0.0
            size = min(len(target), len(words))
            for at in range(len(words) - size + 1):
                other = grams(words[at : at + size], width)
                shared = sum((mine & other).values())
                best = max(best, shared / (sum(mine.values()) + sum(other.values()) - shared))
            if best >= 0.8:
                want[d, n] = round(best, 6)
                # at just 0.8 the index may miss one in some thousands
                close |= {(d, n)} if best < 0.85 else set()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.report(frame, given).collect()}
    assert len(want) > 20 and {k: v for k, v in want.items() if k not in close} == {k: v for k, v in got.items() if k not in close}
    assert set(got) <= set(want)


def test_fingerprints_of_any_number_of_hashes(spark, monkeypatch):
    dice = random.Random(2)
    for n in (0, 1, 2, 7, 64):
        values = [dice.randrange(-(2**63), 2**63) for _ in range(n)]
        frame = spark.createDataFrame([(values,)], "h array<long>")
        row = frame.select(decontamination.lane_bits(F.col("h")).alias("a"), decontamination.single_bits(F.col("h")).alias("b")).first()
        want = sum((2 * sum(v >> b & 1 for v in values) > n) << b for b in range(64))
        assert row.a == row.b == (want - (1 << 64) if want >> 63 else want)


def test_similarity_counts_repeats(spark):
    dice = random.Random(5)
    pairs = [([dice.randrange(k) for _ in range(dice.randrange(1, 30))], [dice.randrange(k) for _ in range(dice.randrange(1, 30))])
             for k in (2, 5, 40) for _ in range(40)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<long>, b array<long>")
    got = {r.i: r.s for r in frame.select("i", decontamination.similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = collections.Counter(a), collections.Counter(b)
        shared = sum((x & y).values())
        assert got[i] == pytest.approx(shared / (len(a) + len(b) - shared))


def test_toxicity_without_labels_keeps_all(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert toxicity.without_toxic(docs, labels).count() == docs.count()
    assert {r.score for r in toxicity.score_toxicity(docs, labels).collect()} == {0.0}


def test_kept_document_has_the_smallest_id(spark):
    text = "one two three four five six seven eight"
    rows = [(9, text), (None, text), (2, text), (2, text), (5, "other words stand here in this text now")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(frame).collect()) == [2, 5]
    assert secrets.redact(frame).count() == 5
