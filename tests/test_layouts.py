"""Stored layouts and places against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import parley as pl
from parley.operators import numbering
from parley.operators import vector_index as vi
from parley.storage import open_by, store_by


def test_places_in_any_order(spark):
    rng = np.random.default_rng(3)
    data = [(int(c) if c < 4 else None, f"u{u:05d}", float(x)) for c, u, x in
            zip(rng.integers(0, 5, 4000), rng.permutation(4000), rng.integers(0, 50, 4000))]
    data += [(9, f"v{i:05d}", 1.0) for i in range(3000)]
    frame = spark.createDataFrame(data, "k int, u string, x double").repartition(7)
    got = numbering.place_rows(frame, "k", [F.desc("x"), "u"], "place").collect()
    want = {}
    for k in {r[0] for r in data}:
        for i, r in enumerate(sorted((r for r in data if r[0] == k), key=lambda r: (-r[2], r[1])), 1):
            want[r] = i
    assert {(r.k, r.u, r.x): r.place for r in got} == want and len(got) == len(data)
    assert numbering.place_rows(frame.limit(0), "k", ["u"], "place").count() == 0


def test_buckets_open_again(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    store_by(rows, ["k"], ["k", "id"], str(tmp_path / "b"), 4)
    again = open_by(spark, str(tmp_path / "b"), "k long, id long", ["k"], ["k", "id"], 4)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("window", [0, 2, 300])
def test_contexts_across_blocks(spark, window):
    messages = spark.range(1, 1401).select(
        (F.col("id") % 2).alias("chat_id"), F.ceil(F.col("id") / 2).cast("long").alias("message_id"),
        F.lit(None).cast("timestamp_ntz").alias("date"), F.lit("u").alias("user"), F.col("id").cast("string").alias("message"),
    )
    targets = messages.where("message_id % 97 = 0 OR message_id IN (1, 255, 256, 257, 700)").select("chat_id", "message_id")
    targets = targets.union(spark.createDataFrame([(0, 9999), (5, 1)], "chat_id long, message_id long"))
    plain = pl.context_text_for(targets, messages, window)
    stored = pl.context_text_for(targets, pl.store_messages(messages), window)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plain.collect()))
    assert plain.count() == targets.count() - 2


def brute(rows, questions, k):
    out = {}
    for q, v in questions:
        for chat in {r[0] for r in rows}:
            mine = [(-float(np.dot(np.float64(v), np.float64(r[2]))), r[1]) for r in rows if r[0] == chat]
            out[q, chat] = [i for _, i in sorted(mine)[:k]]
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_each_is_exact(spark, clustered):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 16)) * (6 if clustered else 0)
    vectors = centers[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))
    vectors[:40] = vectors[0]
    vectors[40:45] = 0
    vectors = np.float32(vectors)
    rows = [(int(i % 3 if i < 850 else 7 + i), i, v.tolist()) for i, v in enumerate(vectors)]
    asked = [(i, (v + 0.1).astype(float).tolist()) for i, v in enumerate(vectors[[0, 42, 100, 500, 899]])] + [(9, [0.0] * 16)]
    frame = spark.createDataFrame(rows, "chat_id long, message_id long, vector array<float>")
    questions = spark.createDataFrame(asked, "question_id long, vector array<double>")
    index = vi.cluster_index(frame, clusters=12)
    got = {}
    for r in vi.nearest_each(index, questions, 4, "message_id").orderBy("semantic_rank").collect():
        got.setdefault((r.question_id, r.chat_id), []).append(r.message_id)
    assert got == brute(rows, asked, 4)
    large = vi.cluster_index(frame.where("chat_id < 3"), clusters=16)
    (share,) = [r.read / r.rows for r in vi.rows_read(large, questions.where("question_id = 2"), 4).collect()]
    assert share < (0.4 if clustered else 1.01)


def test_rows_are_not_copied_for_each_question(spark, monkeypatch):
    """Many questions on few cells: pairs of blocks and groups go through the join, not of rows and questions."""
    monkeypatch.setattr(vi, "BLOCK", 64)
    monkeypatch.setattr(vi, "QUESTIONS_IN_GROUP", 32)
    rng = np.random.default_rng(5)
    vectors = np.float32(rng.normal(size=(1500, 12)))
    vectors[200:700] = vectors[7]
    vectors[700:760] = 0
    rows = [(i % 2, 9000 - i, v.tolist()) for i, v in enumerate(vectors)] + [(0, None, vectors[3].tolist())]
    frame = spark.createDataFrame(rows, "chat_id int, message_id long, vector array<float>").repartition(3)
    asked = [(f"q{i}", [float(x) for x in vectors[i]]) for i in range(0, 300, 2)]
    questions = spark.createDataFrame(asked, "question_id string, vector array<double>")
    index = vi.cluster_index(frame, clusters=4)
    found = vi.nearest_each(index, questions, 6, "message_id")
    got = {}
    for r in found.orderBy("semantic_rank").collect():
        got.setdefault((r.question_id, r.chat_id), []).append(-1 if r.message_id is None else r.message_id)
    assert got == brute([(c, -1 if i is None else i, v) for c, i, v in rows], asked, 6)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "zip_with" not in text.split("MapInArrow")[0].lower()


def test_empty_index_and_no_questions(spark):
    none = spark.createDataFrame([], "chat_id long, message_id long, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, vector array<double>")
    assert vi.nearest_each(vi.cluster_index(none), asked, 3, "message_id").count() == 0
    some = spark.createDataFrame([(1, 1, [1.0, 0.0])], "chat_id long, message_id long, vector array<float>")
    index = vi.cluster_index(some)
    assert vi.nearest_each(index, asked.limit(0), 3, "message_id").count() == 0
    assert [r.message_id for r in vi.nearest_each(index, asked, 3, "message_id").collect()] == [1]
