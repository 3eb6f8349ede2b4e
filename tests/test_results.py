"""Validation, duplicates, sections, extractors, search and CSV on hand-made cases."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import parley as pl
from catalog import fixtures as fx
from parley.functions import vectors as vec
from parley.operators import extract as ex
from parley.schema import AI_RESULTS

RESULT = (
    "chat_id string, seq long, message_id string, date timestamp_ntz, user string, message string, "
    "is_important boolean, type string, task string, deadline string, priority string, "
    "confidence string, evidence string"
)


def results(spark, *rows):
    """Rows of (message_id, type, task, deadline, priority, confidence, evidence)."""
    full = [
        ("c", i, mid, None, "u", f"m{i}", True, kind, task, deadline, prio, conf, evid)
        for i, (mid, kind, task, deadline, prio, conf, evid) in enumerate(rows)
    ]
    return spark.createDataFrame(full, RESULT)


@pytest.fixture
def talk(chat):
    return chat(
        ("A", "Please submit the assignment by tomorrow"), ("B", "ok"),
        ("A", "we decided to use option 2"), ("B", "random"), ("A", "x"), ("B", "far away"),
    )


def test_validation_table(spark, talk):
    raw = results(
        spark,
        ("1", "Task", "Submit", None, "HIGH", "0.95", "SUBMIT the assignment"),
        ("1", "decision", "Other", None, "low", "1", "submit"),
        ("2", "INVALID", "None", "null", "x", "1.5", "ok"),
        ("3", "decision", None, None, "medium", "-0.2", None),
        ("6", "task", "t", "d", "low", "abc", "submit the assignment"),
        ("99", "task", "t", None, "low", "1", "ok"),
        ("4", "none", "t", None, "low", "0.5", None),
        ("x", "task", "t", None, "low", "1", "ok"),
    )
    got = pl.in_date_order(pl.validate_results(raw, talk, seq="seq")).collect()
    assert [
        (r.message_id, r.type, r.task, r.priority, r.confidence, r.is_important, r.evidence)
        for r in got
    ] == [
        (1, "task", "Submit", "high", 0.95, True, "SUBMIT the assignment"),
        (2, "none", None, "low", 1.0, True, "ok"),
        (3, "none", None, "medium", 0.0, False, None),
        (4, "none", "t", "low", 0.5, True, None),
        (6, "none", None, "low", 0.0, False, None),
    ]


def test_missing_evidence_column_demotes(spark, talk):
    raw = results(spark, ("1", "task", "Submit", "d", "low", "1", "ok")).drop("evidence", "task")
    row = pl.validate_results(raw, talk).first()
    assert (row.type, row.task, row.deadline, row.evidence) == ("none", None, None, None)


def test_evidence_over_line_ends(spark, chat):
    messages = chat(("A", "one  two"), ("B", "three"))
    raw = results(spark, ("1", "task", "t", None, "low", "1", "ONE two\nb:   three"))
    assert pl.validate_results(raw, messages).first().type == "task"


def test_action_duplicates(spark):
    raw = results(
        spark,
        ("1", "task", "Submit the assignment!", "Tomorrow", "low", "0.90", None),
        ("2", "deadline", "submit assignment", "tomorrow ", "low", "0.90", None),
        ("3", "request", "submit an assignment provided", None, "low", "0.99", None),
        ("4", "none", None, "tomorrow", "low", "0.95", None),
    ).withColumn("message", F.when(F.col("message_id") == 4, "Submit assignment").otherwise("-"))
    kept = pl.deduplicate_actions(raw)
    assert {r.message_id for r in kept.collect()} == {"3", "4"}
    without_none = pl.deduplicate_actions(raw.where("message_id != 4"))
    assert {r.message_id for r in without_none.collect()} == {"2", "3"}
    totals = pl.dedup_summary(raw).first()
    assert (totals.unique_actions, totals.results) == (2, 4)


def test_sections(spark):
    raw = results(
        spark,
        ("1", "information", None, None, "High", "1", None),
        ("2", "deadline", None, None, "low", "1", "e"),
        ("3", "task", None, None, None, "1", ""),
        ("4", "decision", "d", "x", "low", "1", "e"),
        ("5", "none", "n", None, "low", "1", "e"),
    )
    got = {r.message_id: r for r in pl.sections(raw).collect()}
    assert {k: (r.section, r.headline, r.deadline_text, r.evidence_text) for k, r in got.items()} == {
        "1": ("High Priority", "m0", "Not specified", "No evidence available."),
        "2": ("Deadlines", "Deadline mentioned", "Date not specified", "e"),
        "3": ("Tasks", "m2", None, "No evidence available."),
        "4": ("Decisions", "d", None, "e"),
    }
    assert [r.message_id for r in pl.filter_actions(raw, priority="HIGH").collect()] == ["1"]
    assert [r.message_id for r in pl.filter_actions(raw, "Decisions").collect()] == ["4"]


def test_last_answer_wins_and_bad_batches_drop(spark, talk):
    candidates = pl.filter_candidates(talk)

    def twice(batch):
        for kind in ("task", "request"):
            for item in batch:
                yield {
                    "message_id": item["message_id"], "is_important": True, "type": kind,
                    "priority": "low", "confidence": 1.0, "evidence": "ok",
                }
        yield {"message_id": 77, "is_important": True, "type": "task", "priority": "low", "confidence": 1.0}

    got = pl.analyze_candidates(talk, candidates, extractor=twice).collect()
    assert [(r.message_id, r.type) for r in got] == [(1, "request")]
    assert pl.analyze_chat(talk, extractor=lambda batch: 1 / 0).count() == 0
    assert pl.analyze_chat(talk, extractor=lambda batch: [{"message_id": 1}]).count() == 0


def test_every_batch_is_sent_once(spark, sf, tmp_path):
    log = str(tmp_path / "calls")

    def extractor(batch):
        with open(log, "a") as file:
            file.write(f"{batch[0]['context']['current']['user']} {batch[0]['message_id']}\n")
        return []

    messages = fx.messages(spark, sf)
    sent = pl.create_batches(messages, pl.filter_candidates(messages)).count()
    pl.analyze_chat(messages, extractor=extractor).count()
    with open(log) as file:
        assert len(file.readlines()) == sent


def test_one_pass_equals_the_separate_steps(spark, sf):
    messages = fx.messages(spark, sf)
    steps = pl.validate_results(
        pl.analyze_candidates(messages, pl.filter_candidates(messages)), messages
    )
    whole = pl.analyze_chat(messages)
    assert sorted(map(str, whole.select(*steps.columns).collect())) == sorted(
        map(str, steps.collect())
    )


def test_no_candidates_gives_typed_empty_results(chat):
    quiet = pl.analyze_chat(chat(("A", "ok"), ("B", "fine then")))
    assert quiet.count() == 0 and {"type", "evidence", "confidence"} <= set(quiet.columns)
    assert pl.summary(quiet).count() == 0


def test_malformed_answers(spark):
    good = '{"results":[{"message_id":1,"is_important":true,"type":"task","priority":"low","confidence":1}]}'
    answers = [good, good[:-4], "[]", "x", None, good.replace("confidence", "c"), '{"results":[]}']
    df = spark.createDataFrame(
        [("c", i, a) for i, a in enumerate(answers)], "chat_id string, batch_no long, answer string"
    )
    assert [r.batch_no for r in ex.parse_extractions(df).collect()] == [0]


def test_csv_of_other_tools(spark, tmp_path):
    """A file with byte-order mark, quotes, line ends and empty cells."""
    frame = pd.DataFrame(
        {
            "message_id": [1, 2], "date": ["2026-01-01 10:00:00"] * 2, "user": ["A", "B"],
            "message": ['say "hi",\nbye ', "x"], "candidate_score": [3, 4],
            "candidate_reason": ["action, request", ""], "is_important": [True, False],
            "type": ["task", "none"], "task": ["t", None], "deadline": [None, None],
            "priority": ["low", "low"], "confidence": [0.5, None], "evidence": ["e\\", None],
        }
    )
    frame.insert(0, "chat_id", "c")
    frame.to_csv(tmp_path / "r.csv", index=False, encoding="utf-8-sig")
    got = pl.read_results_csv(spark, str(tmp_path / "r.csv")).orderBy("message_id").collect()
    assert [r.message for r in got] == ['say "hi",\nbye ', "x"]
    assert (got[0].chat_id, got[0].evidence, got[1].task, got[1].confidence) == ("c", "e\\", None, None)

    pl.write_results_csv(pl.read_results_csv(spark, str(tmp_path / "r.csv")), str(tmp_path / "out"))
    again = pl.read_results_csv(spark, str(tmp_path / "out")).orderBy("message_id").collect()
    assert again == got and got[0].__fields__ == AI_RESULTS.fieldNames()


def encoder():
    words = ["submit", "assignment", "random"]

    def encode(texts):
        return [[float(w in t.lower()) + 0.01 for w in words] for t in texts]

    return pl.FunctionEncoder(encode)


def test_search_end_to_end(spark, talk):
    index = pl.build_index(talk, encoder())
    found = pl.analyze_chat(talk)
    question = "When do I need to submit the assignment?"
    hits = pl.ask(talk, index, encoder(), question, found, top_k=2).orderBy("rank").collect()
    assert hits[0].message_id == 1 and hits[0].ai_result.type == "task"
    assert hits[0].keyword_score == 1.0 and hits[0].ai_score == 1.0
    assert [m.message_id for m in hits[0].context] == [1, 2, 3]
    assert hits[1].ai_result is None
    answer = pl.answer(index, encoder(), question, found).first()
    assert answer.answer == (
        "The conversation indicates that you need to "
        "**Please submit the assignment by tomorrow**."
    )
    assert pl.rank_hits(index, "  ", vec.literal([0, 0, 0])).count() == 0
    with pytest.raises(ValueError):
        pl.build_index(talk.where("message_id = 2"), encoder(), strict=True)


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [[round(x, 6) for x in r[0]] for r in df.select(vec.unit(F.col("v"))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_ill_typed_answer_loses_only_its_batch(spark, chat):
    messages = chat(*[("a", f"please submit task {i}") for i in range(1, 11)])
    candidates = pl.filter_candidates(messages)

    def extractor(items):
        odd = any(item["message_id"] == 1 for item in items)
        return [
            {
                "message_id": item["message_id"],
                "is_important": True,
                "type": "task",
                "priority": "low",
                "confidence": "high" if odd else 1,
                "evidence": None,
            }
            for item in items
        ]

    found = pl.analyze_candidates(messages, candidates, extractor=extractor, batch_size=5)
    assert sorted(r.message_id for r in found.collect()) == [6, 7, 8, 9, 10]


def test_first_result_of_a_hit_counts(spark):
    from parley.operators import search

    hits = spark.createDataFrame([("c", 1, 0.9), ("c", 2, 0.8)], "chat_id string, message_id long, semantic_score double")
    fields = "chat_id string, message_id long, seq int, type string, task string, deadline string, priority string, confidence double, evidence string, is_important boolean"
    found = spark.createDataFrame(
        [("c", 1, 2, "task", "late", None, None, 0.5, None, False), ("c", 1, 1, "task", "early", None, None, 0.5, None, False)], fields
    )
    got = search.with_results(hits, found, seq="seq").orderBy("message_id").collect()
    assert [(r.message_id, r.task) for r in got] == [(1, "early"), (2, None)]
    assert search.with_results(hits, found).count() == 2


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    import pytest

    from parley import storage

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError):
        storage.shared_dir(session)


def test_answers_leave_the_task_before_all_batches_are_sent():
    import pyarrow as pa

    from parley.operators import extract as ex

    sent = []

    def extractor(batch):
        sent.append(batch[0]["message_id"])
        if sent[-1] == 3:
            raise RuntimeError("model unavailable")
        yield {"message_id": sent[-1], "is_important": True, "type": "task", "priority": "low", "confidence": 1}

    payload = [f'[{{"message_id": {i}}}]' for i in range(1000)]
    whole = pa.table({"chat_id": [None, "b"] * 500, "batch_no": range(1000), "items": payload}).to_batches()
    parts = ex.attempts(iter(whole), extractor)
    first = next(parts)
    assert len(sent) == ex.BATCHES_AT_ONCE == first.num_rows
    rows = first.to_pylist() + [r for p in parts for r in p.to_pylist()]
    assert len(sent) == len(rows) == 1000
    assert [r["chat_id"] for r in rows] == [None, "b"] * 500
    assert [(i, r["error"]) for i, r in enumerate(rows) if r["error"]] == [(3, "model unavailable")]
    assert [r["message_id"] for r in rows[:5]] == [0, 1, 2, None, 4]
