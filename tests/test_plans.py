"""What the plans must and must not contain, whatever the size of the data."""

import pytest

from catalog import stored_queries
from catalog import fixtures as fx

# plans of the language-model queries are tested beside them
QUERIES = dict(stored_queries.QUERIES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """Plan as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


#: Queries that write and read files on the way; their parts are tested below.
ON_FILES = ("ai_results_csv_roundtrip", "ai_results_csv_split", "parse_export_files", "export_files_actions", "vector_topk_many", "search_many")
PYTHON = ("embed_messages", "search_index", "ask_question")
NO_ACTION = [n for n in QUERIES if n not in ON_FILES + PYTHON]


@pytest.mark.parametrize("name", NO_ACTION)
def test_no_cross_joins_and_no_single_task(spark, sf, large, name):
    text = plan(QUERIES[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text
    if name != "vector_topk":
        # the one-row query vector and the table size are the only single partitions
        main = text.split("Subquery")[0]
        assert "SinglePartition" not in main or name in ("search_with_ai", "hybrid_search", "grounded_answer")


def test_user_filter_reads_needed_columns_only(spark, sf):
    text = plan(QUERIES["daily_timeline"](spark, sf))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text


@pytest.mark.parametrize(
    "name", ["busy_users_top5", "top_words", "word_weights", "dedup_actions", "search_with_ai"]
)
def test_top_k_is_cut_before_the_shuffle(spark, sf, large, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf))


def test_whole_exports_parse_without_a_shuffle(spark, tmp_path):
    from parley.sources import exports

    (tmp_path / "a.txt").write_text("x")
    texts = exports.scan_texts(spark, str(tmp_path))
    assert "Exchange" not in plan(exports.parse_texts(texts, 2026))


def test_rules_analyse_stored_messages_without_a_shuffle(spark, sf, tmp_path):
    import parley as pl
    from catalog import fixtures as fx

    fx.messages(spark, sf).write.parquet(str(tmp_path / "messages"))
    stored = spark.read.parquet(str(tmp_path / "messages"))
    assert "Exchange" not in plan(pl.analyze_chat(stored))


def test_words_are_hash_aggregated(spark, sf):
    text = plan(QUERIES["top_words"](spark, sf))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_numbers_never_window_over_a_whole_chat_of_rows(spark, sf, large):
    """The only window by chat alone is the running sum over slice counts."""
    text = plan(fx.messages(spark, sf))
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) == 2
    assert sum("row_number" in w and "_slice" in w for w in windows) == 1


def ancestors(text, leaf):
    """Operators above each plan line that holds a word, up to the next join or aggregate."""
    lines = text.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if leaf in line:
            above, at = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < at:
                    at = depth[j]
                    above.append(lines[j])
                    if "Join" in lines[j] or "Aggregate" in lines[j]:
                        break
            yield above


def test_stored_messages_are_joined_where_they_lie(spark, sf, large):
    import parley as pl

    messages = pl.store_messages(fx.messages(spark, sf))
    targets = fx.messages(spark, sf).where("message_id % 50 = 0")
    text = plan(pl.context_for(targets, messages))
    found = list(ancestors(text, "Bucketed: true"))
    assert found and not any("Exchange" in x for above in found for x in above)


def test_split_exports_are_read_once(spark, tmp_path):
    from parley.sources import exports

    (tmp_path / "a.txt").write_text("12/09/26, 10:30 pm - Ann: hi")
    pieces = exports.scan_pieces(spark, str(tmp_path))
    assert plan(exports.segments(pieces)).count("FileScan text") == 1
    # the messages come out of the stored segments alone, whose text is not shuffled again
    text = plan(exports.parse_pieces(pieces))
    assert "FileScan text" not in text and "Bucketed: true" in text


def test_clusters_are_skipped_at_the_scan(spark, sf):
    from parley.operators import vector_index as vi

    rows = fx.table(spark, sf, "embeddings").selectExpr("0 AS corpus", "vec_id", "embedding AS vector")
    index = vi.cluster_index(rows, by="corpus")
    asked = rows.where("vec_id = 3").selectExpr("vec_id AS question_id", "vector")
    assert "dynamicpruning" in plan(vi.nearest_each(index, asked, 5, "vec_id")).lower()
