"""Numbering and neighbours on a chat much larger than a slice or block."""

import random

import pytest
from pyspark.sql import functions as F

import parley as pl
from parley.operators import candidates as cand
from parley.operators import context as ctx
from parley.operators import numbering as num


@pytest.fixture(scope="module")
def hot(spark):
    """One chat with nearly all rows and some small ones."""
    return spark.range(1000).select(
        F.when(F.col("id") < 940, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("chat_id"),
        "id",
    )


def test_numbers_are_dense_in_order(hot):
    got = num.number_rows(hot, "chat_id", ["id"], F.floor(F.col("id") / 10), "n").collect()
    by_chat = {}
    for r in sorted(got, key=lambda r: r.id):
        by_chat.setdefault(r.chat_id, []).append(r.n)
    assert all(ns == list(range(1, len(ns) + 1)) for ns in by_chat.values())
    assert len(by_chat["hot"]) == 940


def test_batch_numbers_across_slices(hot, monkeypatch):
    monkeypatch.setattr(num, "SLICE_IDS", 7)
    picked = random.Random(3).sample(range(1, 900), 301)
    rows = hot.where(F.col("id").isin(picked)).withColumn("message_id", F.col("id"))
    got = cand.add_batch_numbers(rows, 4).orderBy("id").collect()
    assert [(r.batch_no, r.place) for r in got] == [(i // 4, i % 4) for i in range(301)]
    assert cand.add_batch_numbers(rows, 4, max_batches=2).count() == 8


@pytest.mark.parametrize("window, block", [(2, 3), (2, 1), (4, 3), (1, 10_000), (3, 50)])
def test_context_plans_agree_with_slicing(spark, chat, window, block):
    n = 120
    messages = chat(*[("u", f"m{i}") for i in range(1, n + 1)])
    expected = {
        i: ([j for j in range(max(1, i - window), i)], [j for j in range(i + 1, min(n, i + window) + 1)])
        for i in range(1, n + 1)
    }
    ids = lambda c: F.transform(c, lambda m: m.message_id)
    wide = pl.attach_context(messages, window, block).select("message_id", ids("previous"), ids("next"))
    assert {r[0]: (r[1], r[2]) for r in wide.collect()} == expected

    targets = messages.where("message_id % 9 < 2").union(messages.limit(1).withColumn("message_id", F.lit(-1)))
    few = pl.context_for(targets, messages, window).select(
        "message_id", ids("context.previous"), ids("context.next"), "context.current.message"
    )
    assert {r[0]: (r[1], r[2]) for r in few.collect()} == {
        i: e for i, e in expected.items() if i % 9 < 2
    }

    texts = {r.message_id: r.context_text for r in pl.attach_context_text(messages, window, block).collect()}
    for r in pl.context_text_for(targets, messages, window).collect():
        assert r.context_text == texts[r.message_id]
        lo, hi = max(1, r.message_id - window), min(n, r.message_id + window)
        assert r.context_text == "\n".join(f"u: m{j}" for j in range(lo, hi + 1))


def test_dates_in_context_are_text(chat):
    messages = chat(("A", "one"), ("B", "two"))
    row = pl.context_for(messages, messages).orderBy("message_id").first()
    assert row.context.current.date == "2026-01-01 00:01:00"
    assert ctx.message_struct is not None


def test_unknown_action_has_no_source(chat):
    messages = chat(("A", "one"), ("B", "two"))
    unknown = messages.limit(1).withColumn("message_id", F.lit(0).cast("long"))
    assert pl.action_source(unknown, messages).count() == 0


def test_prompt_blocks(chat):
    messages = chat(("A", "hi"), ("B", "please send"), ("A", "ok"))
    batches = pl.create_batches(messages, pl.filter_candidates(messages))
    assert pl.prompt_blocks(batches).first().conversations == (
        "\nMESSAGE_ID: 2\n\nPREVIOUS MESSAGES:\nA: hi\n\nCURRENT MESSAGE:\nB: please send\n\n"
        "NEXT MESSAGES:\nA: ok\n"
    )
