"""Column functions on fixed cases and against Python's own string methods."""

import pytest
from pyspark.sql import functions as F

import parley as pl
from catalog.fixtures import PHRASES
from parley.functions import cleaning as cl
from parley.functions import keywords as kw
from parley.functions import text as tx
from parley.operators.words import spoken
from parley.sources import stopwords as sw

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 　     "


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_strip_and_split_follow_unicode_whitespace(spark):
    texts = [a + "x" + b + "y​" + a for a in SPACES for b in SPACES] + ["", " \n ", "​"]
    df = column(spark, texts)
    assert evaluate(df, tx.strip(F.col("v"))) == [t.strip() for t in texts]
    assert evaluate(df, tx.split_words(F.col("v"))) == [t.split() for t in texts]
    assert evaluate(df, tx.word_count(F.col("v"))) == [len(t.split()) for t in texts]
    assert evaluate(df, tx.collapse_spaces(F.col("v"))) == [
        __import__("re").sub(r"\s+", " ", t) for t in texts
    ]


def test_clean_words(spark):
    texts = ['"Hello," (WORLD)!', "don't ... [it's]", "Ünïcode; ΣΑΣ"]
    expected = [["hello", "world"], ["don't", "it's"], ["ünïcode", "σας"]]
    assert evaluate(column(spark, texts), tx.clean_words(F.col("v"))) == expected


SCORES = {
    0: (8, "action, request, deadline"), 3: (6, "action, request, question"), 4: (2, "decision"),
    9: (5, "action, request"), 10: (6, "action, deadline"), 13: (3, "deadline"),
    14: (3, "decision, question"), 15: (1, "question"), 18: (3, "deadline"),
    19: (9, "action, request, deadline, question"), 23: (3, "action"),
}


def test_golden_scores(spark):
    rows = column(spark, PHRASES).withColumnRenamed("v", "message")
    got = pl.score_messages(rows).collect()
    assert {r.i: (r.candidate_score, r.candidate_reason) for r in got} == {
        i: SCORES.get(i, (0, "")) for i in range(len(PHRASES))
    }


@pytest.mark.parametrize(
    "message, score",
    [
        (None, 0), ("", 0), ("submit", 0), ("Good  Night", 0), ("GOOD NIGHT", 0),
        ("https://a.b/submit www.c.d?", 0), ("see www.c.d?submit now", 4),
        ("SUBMIT IT", 3), ("ſubmit it", 3), ("mujhe\nbhej", 0), ("mujhe\rkal ka bhej", 5),
        ("assignment no १२", 3), ("éby the way", 0), ("by éthe way", 3),
    ],
)
def test_score_edges(spark, message, score):
    df = spark.createDataFrame([(message,)], "message string")
    assert pl.score_messages(df).first().candidate_score == score


def test_emoji_by_code_point(spark):
    texts = ["a😂😂b", "❤️", "👨‍👩‍👧", "👍🏽", "🇮🇳 1#*", "©"]
    expected = [["😂", "😂"], ["❤"], ["👨", "👩", "👧"], ["👍", "🏽"], [], ["©"]]
    assert evaluate(column(spark, texts), tx.emojis(F.col("v"))) == expected


def test_emoji_by_sequence(spark):
    family, flag, tone = "\U0001F468\u200d\U0001F469\u200d\U0001F467", "\U0001F1EE\U0001F1F3", "\U0001F44D\U0001F3FD"
    wales = "\U0001F3F4\U000E0067\U000E0062\U000E0077\U000E006C\U000E0073\U000E007F"
    heart, key, both = "\u2764\ufe0f", "#\ufe0f\u20e3", "\U0001F469\U0001F3FD\u200d\U0001F4BB"
    texts = [family + flag + flag, "a" + tone + "b" + heart, key + "1", wales, both + " \U0001F3FD", "\U0001F1EE x", heart + "\u200d\U0001F525", "", None]
    expected = [[family, flag, flag], [tone, heart], [key], [wales], [both, "\U0001F3FD"], [], [heart + "\u200d\U0001F525"], [], None]
    assert evaluate(column(spark, texts), tx.emojis(F.col("v"), sequences=True)) == expected


def test_links(spark):
    texts = ["see https://a.io/x?y=1 and www.b.c", "mail.example.com/x ok", "e.g. this. No link", "1.5"]
    assert evaluate(column(spark, texts), tx.link_count(F.col("v"))) == [2, 1, 0, 0]
    texts = ["bob@example.com", "HTTPS://EXAMPLE.COM/x", "Example.COM WWW.a.b", "google.xyz, a.shop",
             "https://me@host.com/a@b.com", "a.com/x@b mail: x.y@z.org", "a" * 100_000, None]
    assert evaluate(column(spark, texts), tx.link_count(F.col("v"))) == [0, 1, 2, 2, 1, 1, 0, None]


def test_clean_value_and_numbers(spark):
    df = column(spark, ["None", " null ", "NaN", "", "x ", None])
    assert evaluate(df, cl.clean_value(F.col("v"))) == [None, None, None, None, "x", None]
    numbers = ["1.5", "-0.2", "abc", None, "nan", "0.25", " 1 ", "1d", "inf", "1e-1"]
    df = column(spark, numbers)
    assert evaluate(df, cl.clean_confidence(F.col("v"))) == [1, 0, 0, 0, 0, 0.25, 1, 0, 1, 0.1]
    ids = ["7", "7.9", "9007199254740993", "x", None, "-1"]
    df = column(spark, ids)
    assert evaluate(df, cl.clean_message_id(F.col("v"))) == [7, 7, 9007199254740993, None, None, -1]


def test_action_keys(spark):
    df = column(spark, ["Submit the  assignment!", "provided AN a", "हिन्दी काम", None])
    assert evaluate(df, cl.action_key(F.col("v"))) == ["submit assignment", "", "", ""]
    wide = evaluate(df, cl.action_key(F.col("v"), unicode_keys=True))
    assert wide == ["submit assignment", "", "हिन्दी काम", ""]


def test_keyword_scores(spark):
    question = F.lit("When do I need to submit the assignment?")
    df = column(spark, [PHRASES[0], "submit it now", "ok", ""])
    assert evaluate(df, kw.keyword_score(question, F.col("v"))) == [1.0, 0.5, 0.0, 0.0]
    assert evaluate(df, kw.keyword_score(F.lit("what is it"), F.col("v"))) == [0.0] * 4


def test_searchable_phrases(spark):
    flags = evaluate(column(spark, PHRASES), kw.searchable(F.col("v")))
    assert [i for i, ok in enumerate(flags) if not ok] == [1, 2, 5, 6, 8, 12, 17]


def test_stop_word_files(spark, tmp_path):
    (tmp_path / "stop.txt").write_text(" The \n\nthe\nAur\n", encoding="utf-8")
    got = {r.word for r in pl.read_stop_words(spark, str(tmp_path / "stop.txt")).collect()}
    assert got == {"the", "aur"}
    assert pl.read_stop_words(spark, str(tmp_path / "missing.txt")).count() == 0
    assert len(sw.default_words()) == pl.default_stop_words(spark).count() <= 200


def test_word_ties_go_to_first_use(spark, chat):
    messages = chat(
        ("A", "zeta alpha"), ("group_notification", "alpha alpha"), ("B", "<Media omitted>"),
        ("B", "alpha zeta mid"), ("A", "early"),
    )
    got = pl.top_words(messages, top=3).orderBy("rank").collect()
    assert [(r.word, r.n) for r in got] == [("zeta", 2), ("alpha", 2), ("mid", 1)]
    assert [r.word for r in pl.top_words(messages, user="A").orderBy("rank").collect()] == [
        "zeta", "alpha", "early",
    ]
    assert spoken(messages).count() == 3


def test_stop_words_by_default_and_as_a_table(spark, chat):
    messages = chat(("A", "The notes, and the plan!"), ("B", "the and"), ("B", "plan b"))
    assert {r.word for r in pl.top_words(messages).collect()} == {"notes", "plan", "b"}
    assert {r.word for r in pl.top_words(messages, stop_words=None).collect()} >= {"the", "and"}
    with pytest.raises(ValueError):
        pl.top_words(messages, stop_words="other")
    for words in (["the", "and"], spark.createDataFrame([("the",), ("and",)], "word string")):
        got = pl.clean_corpus(messages, words).orderBy("message_id").collect()
        assert [r.clean_text for r in got] == ["notes plan", "", "plan b"]
