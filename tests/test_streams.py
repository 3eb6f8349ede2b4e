"""Stateful streams against the batch job on the same messages, with late rows and a restart."""

import pytest
from pyspark.sql import functions as F

import parley as pl
from catalog import fixtures as fx
from parley.streaming import state


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(state.STATE_STORE[0])
    state.use_state_store(spark)
    yield
    spark.conf.set(state.STATE_STORE[0], before)


def replay(spark, folder, out, checkpoint, build, mode):
    """Run a stream over all files that are there and stop."""
    schema = spark.read.parquet(str(folder)).schema
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))

    def keep(batch, number):
        batch.write.mode("append").parquet(str(out))

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(keep)
        .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_ids_and_contexts_equal_the_batch(spark, sf, tmp_path, rocks):
    rows = fx.event_messages(spark, sf).select(
        "chat_id", F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("seq"), "user", "message"
    ).orderBy("event_time").toPandas()
    # neighbours change places: late by some rows, within the lateness
    order = [i ^ 3 if (i ^ 3) < len(rows) else i for i in range(len(rows))]
    rows = rows.iloc[order].reset_index(drop=True)
    parts = [rows.iloc[i : i + 250] for i in range(0, len(rows), 250)]
    inbox, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    build = lambda stream: state.number_stream(stream, "2 days")
    for i, part in enumerate(parts):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(inbox))
        if i == 1:  # stopped here, and started again from the checkpoint
            replay(spark, inbox, out, ck, build, "append")
    replay(spark, inbox, out, ck, build, "append")
    got = {(r.chat_id, r.message_id): r for r in spark.read.parquet(str(out)).collect()}
    batch = pl.attach_context(fx.messages(spark, sf)).collect()
    last = {}
    for r in batch:
        last[r.chat_id] = max(last.get(r.chat_id, 0), r.message_id)
    want = {(r.chat_id, r.message_id): r for r in batch}
    assert len(got) > 0.8 * len(want)
    for key, r in got.items():
        w = want[key]
        assert (r.user, r.message) == (w.user, w.message)
        assert r.previous == [f"{m.user}: {m.message}" for m in w.previous]
        assert r.next == [f"{m.user}: {m.message}" for m in w.next]
    for chat, n in last.items():  # without gaps from 1 on
        ids = sorted(i for c, i in got if c == chat)
        assert ids == list(range(1, len(ids) + 1)) and len(ids) < n


def test_actions_equal_the_batch(spark, sf, tmp_path, rocks):
    results = pl.analyze_chat(fx.messages(spark, sf)).withColumn("date", F.col("date").cast("timestamp"))
    inbox, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    results.repartition(3, "message_id").write.parquet(str(inbox))
    replay(spark, inbox, out, ck, state.first_actions, "update")
    found = spark.read.parquet(str(out))
    keys = ["chat_id", "action_key", "deadline_key"]
    last = pl.operators.actions.add_action_keys(found).groupBy(*keys).agg(F.max_by("message_id", "revision").alias("message_id"))
    got = sorted((r.chat_id, r.message_id) for r in last.collect())
    want = sorted((r.chat_id, r.message_id) for r in pl.deduplicate_actions(results).collect())
    assert got == want and found.agg(F.max("revision")).first()[0] > 1
