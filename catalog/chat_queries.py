"""Registered queries on parsing, statistics, words and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

import parley as pl
from parley.functions import cleaning as cl
from parley.functions import keywords as kw
from parley.functions import scoring
from parley.functions import text as tx
from parley.functions import timestamps as ts
from parley.operators import candidates as cand
from parley.operators import context as ctx
from parley.schema import MEDIA_MESSAGE, MESSAGES
from parley.sources import exports
from parley.sources import stopwords as sw

from . import fixtures as fx
from .fixtures import CONV, DOCS, EV, MSGS, quote, s_clean_words, s_collapse, s_strip
from .fixtures import s_word_count

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# --- parsing ----------------------------------------------------------------------------------

_MESSAGE_COLUMNS = ", ".join(f'"{c}"' for c in MESSAGES.fieldNames())


@register("parse_export", f"WITH {MSGS} SELECT {_MESSAGE_COLUMNS} FROM msgs")
def parse_export(spark, sf):
    """Every part of a chat as an export of its own; ids continue from part to part."""
    texts = fx.export_texts(spark, sf).select(
        F.struct("chat_id", "split").alias("chat_id"), "text"
    )
    return pl.parse_texts(texts, fx.PIVOT_YEAR).select(
        F.col("chat_id.chat_id").alias("chat_id"),
        (F.col("chat_id.split") * fx.PART + F.col("message_id")).alias("message_id"),
        *MESSAGES.fieldNames()[2:],
    )


@register("parse_export_split", ORACLES["parse_export"])
def parse_export_split(spark, sf):
    return pl.parse_pieces(exports.pieces_of(fx.export_texts(spark, sf)), fx.PIVOT_YEAR)


_RAW_CASES = """CASE turn % 4
  WHEN 0 THEN role || ': ' || text
  WHEN 1 THEN text
  WHEN 2 THEN '  ' || role || ' :' || text || chr(10)
  ELSE text || chr(10) || role || ': late' END"""


@register(
    "parse_sender",
    f"""WITH raw AS (SELECT conv_id, turn, {s_strip(_RAW_CASES)} AS raw FROM conversations)
SELECT conv_id, turn,
  CASE WHEN regexp_matches(raw, '^[^:\\n]+:') THEN {s_strip("regexp_extract(raw, '^([^:\\n]+):', 1)")}
       ELSE 'group_notification' END AS "user",
  CASE WHEN regexp_matches(raw, '^[^:\\n]+:')
       THEN {s_strip("regexp_extract(raw, '(?s)^[^:\\n]+:(.*)$', 1)")} ELSE raw END AS message
FROM raw""",
)
def parse_sender(spark, sf):
    user, message = exports.split_sender(F.col("raw"))
    return (
        fx.table(spark, sf, "conversations")
        .select("conv_id", "turn", F.expr(_RAW_CASES).alias("raw"))
        .select("conv_id", "turn", user.alias("user"), message.alias("message"))
    )


# Headers of all kinds from the event number: swapped, short and impossible dates among them.
_D, _M = "event_id % 33", "event_id // 33 % 14"
_H, _MI, _PM = "event_id % 14", "event_id * 7 % 62", "event_id % 2"
_YEARS = """CASE event_id // 462 % 5
  WHEN 0 THEN lpad((event_id % 100)::VARCHAR, 2, '0')
  WHEN 1 THEN (1990 + event_id % 60)::VARCHAR
  WHEN 2 THEN (event_id % 1000)::VARCHAR
  WHEN 3 THEN (1600 + event_id % 200)::VARCHAR
  ELSE (2200 + event_id % 200)::VARCHAR END"""


@register(
    "parse_timestamp",
    f"""WITH p AS (
  SELECT event_id, {_D} AS a, {_M} AS b, {_YEARS} AS ytext, {_H} AS h, {_MI} AS mi, {_PM} AS pm
  FROM events),
q AS (
  SELECT *, b > 12 AND a <= 12 AS swapped, ytext::INT AS y FROM p),
r AS (
  SELECT event_id, h, mi, pm,
    CASE WHEN swapped THEN b ELSE a END AS d, CASE WHEN swapped THEN a ELSE b END AS m,
    CASE WHEN len(ytext) = 2 THEN CASE WHEN 2000 + y >= 2076 THEN 1900 + y ELSE 2000 + y END
         WHEN len(ytext) = 4 AND y BETWEEN 1678 AND 2261 THEN y END AS y
  FROM q)
SELECT event_id, try_cast(printf('%04d-%02d-%02d %02d:%02d:00', y, m, d, h % 12 + 12 * pm, mi)
  AS TIMESTAMP) AS date
FROM r WHERE h <= 12 AND y IS NOT NULL AND date IS NOT NULL""",
)
def parse_timestamp(spark, sf):
    n = F.col("event_id")
    div = lambda by: F.floor(n / F.lit(by))
    kind = div(462) % 5
    year = (
        F.when(kind == 0, F.lpad((n % 100).cast("string"), 2, "0"))
        .when(kind == 1, (1990 + n % 60).cast("string"))
        .when(kind == 2, (n % 1000).cast("string"))
        .when(kind == 3, (1600 + n % 200).cast("string"))
        .otherwise((2200 + n % 200).cast("string"))
    )
    gap = F.when(n % 3 == 0, " ").when(n % 3 == 1, " ").otherwise("")
    stamp = F.concat(
        (n % 33).cast("string"), F.lit("/"), (div(33) % 14).cast("string"), F.lit("/"), year,
        F.lit(", "), (n % 14).cast("string"), F.lit(":"), F.lpad((n * 7 % 62).cast("string"), 2, "0"),
        gap, F.when(n % 2 == 1, "PM").otherwise("am"),
    )
    return (
        fx.table(spark, sf, "events")
        .select("event_id", stamp.alias("stamp"))
        .select("event_id", F.expr(ts.stamp_to_date("stamp", fx.PIVOT_YEAR)).alias("date"))
        .where(F.col("date").isNotNull())
    )


@register(
    "parse_rejects",
    """SELECT doc_id AS chat_id FROM documents
WHERE trim(text) <> '' AND doc_id % 3 <> 0""",
)
def parse_rejects(spark, sf):
    """Every third document quotes a header somewhere; the others are no exports."""
    quoted = F.when(F.col("doc_id") % 3 == 0, "\n12/09/26, 10:30 pm - A: hi").otherwise("")
    texts = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("chat_id"), F.concat("text", quoted).alias("text")
    )
    return exports.text_rejects(texts)


@register(
    "parse_empty",
    f"WITH {MSGS} SELECT {_MESSAGE_COLUMNS} FROM msgs WHERE false",
)
def parse_empty(spark, sf):
    """Texts without any header give the typed, empty messages table."""
    texts = fx.table(spark, sf, "pages").select(
        F.col("page_id").alias("chat_id"), F.col("html").alias("text")
    )
    return pl.parse_texts(texts, fx.PIVOT_YEAR)


@register("message_id", f"WITH {MSGS} SELECT event_id, chat_id, message_id FROM msgs")
def message_id(spark, sf):
    return fx.messages(spark, sf).select("event_id", "chat_id", "message_id")


_CALENDAR = ["year", "month_num", "month", "only_date", "day", "day_name", "hour", "minute"]


@register(
    "calendar_features", f"WITH {EV} SELECT event_id, {', '.join(_CALENDAR)} FROM evc"
)
def calendar_features(spark, sf):
    return fx.event_messages(spark, sf).select("event_id", *_CALENDAR)


@register("hour_period", f"WITH {EV} SELECT event_id, hour, period FROM evc")
def hour_period(spark, sf):
    return fx.event_messages(spark, sf).select("event_id", "hour", "period")


# --- statistics -------------------------------------------------------------------------------


@register(
    "filter_user",
    f"WITH {EV} SELECT event_id, chat_id, \"user\", message FROM evc WHERE \"user\" = 'user_42'",
)
def filter_user(spark, sf):
    return pl.filter_user(fx.event_messages(spark, sf), "user_42").select(
        "event_id", "chat_id", "user", "message"
    )


_URL_SQL = r"(?i)(https?://|www\.)[^\x09-\x0d\x1c-\x1f\x{85}\p{Z}]+"
_MAIL_SQL = r"(?i)[a-z0-9._%+-]{1,64}@[a-z0-9.-]+"
_HOST_SQL = rf"(?i){tx.LABEL}(\.{tx.LABEL})+(/[^\x09-\x0d\x1c-\x1f\x{{85}}\p{{Z}}]*)?"
_ENDINGS_SQL = ", ".join(quote(x) for x in tx.BARE_DOMAINS.split())


def s_links(text: str) -> str:
    """Full URLs, and hosts in what is left without URLs and mail addresses."""
    bare = text
    for pattern in (_URL_SQL, _MAIL_SQL):
        bare = f"regexp_replace({bare}, {quote(pattern)}, ' ', 'g')"
    labels = "string_split(lower(string_split(x, '/')[1]), '.')[2:]"
    hosts = f"list_filter(regexp_extract_all({bare}, {quote(_HOST_SQL)}), lambda x: list_has_any({labels}, [{_ENDINGS_SQL}]))"
    return f"len(regexp_extract_all({text}, {quote(_URL_SQL)})) + len({hosts})"


def _measures() -> str:
    return f"""count(*) AS messages,
  sum({s_word_count("message")})::BIGINT AS words,
  count(*) FILTER (WHERE {s_strip("message")} = '{MEDIA_MESSAGE}') AS media,
  sum({s_links('message')})::BIGINT AS links"""


@register("fetch_stats", f"WITH {EV} SELECT chat_id, {_measures()} FROM evc GROUP BY chat_id")
def fetch_stats(spark, sf):
    return pl.fetch_stats(fx.event_messages(spark, sf))


@register(
    "fetch_stats_documents",
    f"WITH {DOCS} SELECT chat_id, {_measures()} FROM docs GROUP BY chat_id",
)
def fetch_stats_documents(spark, sf):
    return pl.fetch_stats(fx.document_messages(spark, sf))


@register(
    "stats_rollup",
    f"""WITH {EV} SELECT chat_id, coalesce("user", 'Overall') AS "user",
  grouping("user")::INT AS is_overall, {_measures()}
FROM evc GROUP BY GROUPING SETS ((chat_id, "user"), (chat_id))""",
)
def stats_rollup(spark, sf):
    return pl.stats_rollup(fx.event_messages(spark, sf))


@register(
    "link_counts",
    f"SELECT page_id, ({s_links('html')})::INT AS links FROM pages",
)
def link_counts(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", tx.link_count(F.col("html")).alias("links"))


@register(
    "busy_users_top5",
    f"""WITH {EV}, n AS (SELECT chat_id, "user", count(*) AS messages FROM evc GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY messages DESC, "user")::INT AS rank
  FROM n)
SELECT * FROM r WHERE rank <= 5""",
)
def busy_users_top5(spark, sf):
    return pl.busy_users(fx.event_messages(spark, sf), 5)


@register(
    "user_percent",
    f"""WITH {EV}, n AS (SELECT chat_id, "user", count(*) AS n FROM evc GROUP BY 1, 2)
SELECT chat_id, "user" AS name,
  round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY chat_id), 2)::DOUBLE AS percent FROM n""",
)
def user_percent(spark, sf):
    return pl.user_percent(fx.event_messages(spark, sf))


@register(
    "monthly_timeline",
    f"""WITH {EV} SELECT chat_id, year, month_num, month, count(*) AS messages,
  month || '-' || year AS time,
  (row_number() OVER (PARTITION BY chat_id ORDER BY year, month_num))::INT AS place
FROM evc GROUP BY chat_id, year, month_num, month""",
)
def monthly_timeline(spark, sf):
    return pl.monthly_timeline(fx.event_messages(spark, sf))


@register(
    "daily_timeline",
    f"WITH {EV} SELECT chat_id, only_date, count(*) AS messages, "
    "(row_number() OVER (PARTITION BY chat_id ORDER BY only_date))::INT AS place "
    "FROM evc GROUP BY chat_id, only_date",
)
def daily_timeline(spark, sf):
    return pl.daily_timeline(fx.event_messages(spark, sf))


@register(
    "week_activity",
    f"WITH {EV} SELECT chat_id, day_name, count(*) AS messages, "
    "(row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC, day_name))::INT AS place "
    "FROM evc GROUP BY chat_id, day_name",
)
def week_activity(spark, sf):
    return pl.week_activity(fx.event_messages(spark, sf))


@register(
    "month_activity",
    f"WITH {EV} SELECT chat_id, month, count(*) AS messages, "
    "(row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC, month))::INT AS place "
    "FROM evc GROUP BY chat_id, month",
)
def month_activity(spark, sf):
    return pl.month_activity(fx.event_messages(spark, sf))


@register(
    "activity_heatmap",
    f"WITH {EV} SELECT chat_id, day_name, period, count(*) AS messages FROM evc GROUP BY ALL",
)
def activity_heatmap(spark, sf):
    return pl.activity_heatmap(fx.event_messages(spark, sf))


_PERIODS = [f"{h:02d}-{(h + 1) % 24:02d}" for h in range(24)]


@register(
    "activity_heatmap_wide",
    f"""WITH {EV} SELECT chat_id, day_name,
  {", ".join(f"count(*) FILTER (WHERE period = '{p}') AS \"{p}\"" for p in _PERIODS)}
FROM evc GROUP BY chat_id, day_name""",
)
def activity_heatmap_wide(spark, sf):
    return pl.activity_heatmap_wide(fx.event_messages(spark, sf))


@register(
    "participants",
    f"""WITH {EV}, u AS (SELECT DISTINCT chat_id, "user" FROM evc WHERE "user" <> 'group_notification')
SELECT chat_id, (row_number() OVER (PARTITION BY chat_id ORDER BY "user"))::INT AS place, "user" FROM u
UNION ALL SELECT DISTINCT chat_id, 0, 'Overall' FROM evc""",
)
def participants(spark, sf):
    return pl.participants(fx.event_messages(spark, sf))


# --- words and emoji --------------------------------------------------------------------------


@register(
    "stop_words",
    f"""SELECT DISTINCT lower({s_strip("line")}) AS word
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {s_strip("line")} <> ''""",
)
def stop_words(spark, sf):
    """The list loader on the lines of all documents: strip, lower, drop blanks, dedupe."""
    lines = fx.table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return sw.normalize_words(lines)


_STOP = "stop AS (SELECT unnest([" + ", ".join(quote(w) for w in sw.default_words()) + "]) AS word)"


def _word_table(source: str) -> str:
    return f"""tokens AS (
  SELECT chat_id, message_id, unnest(words) AS word, unnest(range(len(words))) AS pos
  FROM (SELECT chat_id, message_id, {s_clean_words("message")} AS words FROM {source}
        WHERE "user" <> 'group_notification' AND {s_strip("message")} <> '{MEDIA_MESSAGE}')),
kept AS (SELECT * FROM tokens WHERE word NOT IN (SELECT word FROM stop)),
counted AS (
  SELECT chat_id, word, count(*) AS n, min({{'m': message_id, 'p': pos}}) AS first_use
  FROM kept GROUP BY chat_id, word)"""


def _top_words_sql(ctes: str, source: str) -> str:
    return f"""WITH {ctes}, {_STOP}, {_word_table(source)},
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, first_use)::INT AS rank
  FROM counted)
SELECT chat_id, word, n, rank FROM r WHERE rank <= 20"""


@register("top_words", _top_words_sql(MSGS, "msgs"))
def top_words(spark, sf):
    return pl.top_words(fx.messages(spark, sf), stop_words=pl.default_stop_words(spark))


@register("top_words_documents", _top_words_sql(DOCS, "docs"))
def top_words_documents(spark, sf):
    return pl.top_words(fx.document_messages(spark, sf), stop_words=pl.default_stop_words(spark))


@register(
    "word_weights",
    f"""WITH {CONV}, {_STOP}, {_word_table("conv")},
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, word)::INT AS rank
  FROM counted)
SELECT chat_id, word, n, rank,
  round(n::DOUBLE / max(n) OVER (PARTITION BY chat_id), 6) AS weight FROM r WHERE rank <= 200""",
)
def word_weights(spark, sf):
    return pl.word_weights(
        fx.conversation_messages(spark, sf), stop_words=pl.default_stop_words(spark)
    )


@register(
    "clean_text",
    f"""WITH {CONV}, {_STOP} SELECT chat_id, message_id, array_to_string(
  list_filter({s_clean_words("message")},
    lambda w: NOT list_contains([{", ".join(quote(w) for w in sw.default_words())}], w)), ' ')
  AS clean_text FROM conv WHERE {s_strip("message")} <> '{MEDIA_MESSAGE}'""",
)
def clean_text(spark, sf):
    return pl.clean_corpus(fx.conversation_messages(spark, sf), sw.default_words()).select(
        "chat_id", "message_id", "clean_text"
    )


_EMOJI_COUNTED = f"""found AS (
  SELECT chat_id, message_id, unnest(e) AS emoji, unnest(range(len(e))) AS pos
  FROM (SELECT chat_id, message_id, regexp_extract_all(message, {quote(tx.EMOJI)}) AS e FROM msgs)),
counted AS (
  SELECT chat_id, emoji, count(*) AS n, min({{'m': message_id, 'p': pos}}) AS first_use
  FROM found GROUP BY chat_id, emoji),
ranked AS (
  SELECT chat_id, emoji, n,
    row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, first_use)::INT AS rank
  FROM counted)"""


@register("emoji_counts", f"WITH {MSGS}, {_EMOJI_COUNTED} SELECT * FROM ranked")
def emoji_counts(spark, sf):
    return pl.emoji_counts(fx.messages(spark, sf))


_SEQUENCES = ["\U0001F1EE\U0001F1F3", "\U0001F468\u200d\U0001F469\u200d\U0001F467", "\U0001F44D\U0001F3FD", "1\ufe0f\u20e3", "\u2764\ufe0f\u200d\U0001F525", "x"]
_WITH_SEQUENCES = f"""seq AS (SELECT * REPLACE (message || ([{", ".join(map(quote, _SEQUENCES))}])[(event_id % 6)::INT + 1] AS message)
  FROM msgs)"""


@register(
    "emoji_sequences",
    f"""WITH {MSGS}, {_WITH_SEQUENCES},
{_EMOJI_COUNTED.replace(quote(tx.EMOJI), quote(tx.EMOJI_SEQUENCE)).replace("FROM msgs", "FROM seq")}
SELECT * FROM ranked""",
)
def emoji_sequences(spark, sf):
    """Emoji as they are seen, on messages with flags, families, skin tones and keycaps."""
    added = F.get(F.array(*map(F.lit, _SEQUENCES)), (F.col("event_id") % 6).cast("int"))
    messages = fx.messages(spark, sf).withColumn("message", F.concat("message", added))
    return pl.emoji_counts(messages, sequences=True)


@register(
    "emoji_share",
    f"""WITH {MSGS}, {_EMOJI_COUNTED} SELECT *,
  round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY chat_id), 1)::DOUBLE AS percent
FROM ranked WHERE rank <= 5""",
)
def emoji_share(spark, sf):
    return pl.emoji_share(fx.messages(spark, sf))


# --- candidates -------------------------------------------------------------------------------


def scored(source: str, columns: str = "*") -> str:
    """SELECT adding candidate_score and candidate_reason to a relation with `message`."""
    flags = ",\n    ".join(
        f"worth AND regexp_matches(t, {quote(scoring.any_of(pats))}) AS f_{name}"
        for name, _, pats in scoring.SIGNALS
    )
    weights = [(n, w) for n, w, _ in scoring.SIGNALS] + [("question", scoring.QUESTION_WEIGHT)]
    total = " + ".join(f"CASE WHEN f_{n} THEN {w} ELSE 0 END" for n, w in weights)
    reason = ", ".join(f"CASE WHEN f_{n} THEN '{n}' END" for n, _ in weights)
    small_talk = ", ".join(quote(s) for s in scoring.SMALL_TALK)
    bare = f"regexp_replace(t, {quote(tx.FULL_URL)}, '', 'g')"
    return f"""SELECT {columns}, ({total})::INT AS candidate_score,
  concat_ws(', ', {reason}) AS candidate_reason
FROM (SELECT *, {flags},
    worth AND contains(t, '?') AS f_question
  FROM (SELECT *, {s_word_count("t")} > 1 AND t NOT IN ({small_talk})
        AND {s_strip(bare)} <> '' AS worth
    FROM (SELECT *, lower({s_strip("message")}) AS t FROM {source}))) """


CANDS = f"""scored AS ({scored("msgs")}),
cands AS (SELECT * FROM scored WHERE candidate_score >= 3 AND "user" <> 'group_notification')"""


@register(
    "candidate_score",
    f"WITH {EV} {scored('evc', 'event_id')}",
)
def candidate_score(spark, sf):
    return pl.score_messages(fx.event_messages(spark, sf)).select(
        "event_id", "candidate_score", "candidate_reason"
    )


@register(
    "candidate_score_documents",
    f"WITH {DOCS} {scored('docs', 'chat_id, message_id')}",
)
def candidate_score_documents(spark, sf):
    return pl.score_messages(fx.document_messages(spark, sf)).select(
        "chat_id", "message_id", "candidate_score", "candidate_reason"
    )


@register(
    "candidates",
    f"""WITH {MSGS}, {CANDS} SELECT chat_id, message_id, "user", message, candidate_score,
  candidate_reason, true AS is_candidate FROM cands""",
)
def candidates(spark, sf):
    return pl.filter_candidates(fx.messages(spark, sf)).select(
        "chat_id", "message_id", "user", "message", "candidate_score", "candidate_reason",
        "is_candidate",
    )


# --- context and batches ----------------------------------------------------------------------

_NEIGHBOUR_SQL = """strftime(date, '%Y-%m-%d %H:%M:%S') || ' ' || "user" || ': ' || message"""


def _contexts(source: str) -> str:
    over = "OVER (PARTITION BY chat_id ORDER BY message_id ROWS BETWEEN {} AND {})"
    prev, nxt = over.format("2 PRECEDING", "1 PRECEDING"), over.format("1 FOLLOWING", "2 FOLLOWING")
    line = "\"user\" || ': ' || message"
    return f"""ctx AS (
  SELECT *, coalesce(string_agg({_NEIGHBOUR_SQL}, chr(10)) {prev}, '') AS previous,
    coalesce(string_agg({_NEIGHBOUR_SQL}, chr(10)) {nxt}, '') AS next,
    coalesce(string_agg({line}, chr(10)) {prev}, '') AS prev_lines,
    coalesce(string_agg({line}, chr(10)) {nxt}, '') AS next_lines,
    count(*) {over.format("2 PRECEDING", "2 FOLLOWING")} AS around_n,
    string_agg({line}, chr(10)) {over.format("2 PRECEDING", "2 FOLLOWING")} AS context_text
  FROM {source})"""


def _flat(neighbours) -> F.Column:
    return F.array_join(
        F.transform(neighbours, lambda m: F.concat(m.date, F.lit(" "), m.user, F.lit(": "), m.message)),
        "\n",
    )


@register(
    "context_window",
    f"WITH {MSGS}, {_contexts('msgs')} SELECT chat_id, message_id, previous, next FROM ctx",
)
def context_window(spark, sf):
    return pl.attach_context(fx.messages(spark, sf)).select(
        "chat_id",
        "message_id",
        _flat("previous").alias("previous"),
        _flat("next").alias("next"),
    )


@register(
    "context_join",
    f"""WITH {MSGS}, {_contexts('msgs')}, {CANDS}
SELECT chat_id, message_id, previous, {_NEIGHBOUR_SQL} AS current, next
FROM ctx SEMI JOIN cands USING (chat_id, message_id)""",
)
def context_join(spark, sf):
    messages = fx.messages(spark, sf)
    return pl.context_for(pl.filter_candidates(messages), messages).select(
        "chat_id",
        "message_id",
        _flat("context.previous").alias("previous"),
        _flat(F.array("context.current")).alias("current"),
        _flat("context.next").alias("next"),
    )


@register(
    "context_text",
    f"""WITH {CONV}, c AS (SELECT *, NULL::TIMESTAMP AS date FROM conv), {_contexts('c')}
SELECT chat_id, message_id, context_text FROM ctx""",
)
def context_text(spark, sf):
    return pl.attach_context_text(fx.conversation_messages(spark, sf)).select(
        "chat_id", "message_id", "context_text"
    )


NUMBERED = """numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY chat_id ORDER BY message_id) - 1) AS nth,
    (row_number() OVER (PARTITION BY chat_id ORDER BY message_id) - 1) // 5 AS batch_no
  FROM cands)"""


@register(
    "batches",
    f"""WITH {MSGS}, {CANDS}, {_contexts('msgs')}, {NUMBERED}
SELECT chat_id, batch_no::BIGINT AS batch_no, count(*)::INT AS items,
  string_agg(message_id::VARCHAR, ',' ORDER BY message_id) AS message_ids,
  sum(around_n)::INT AS context_messages
FROM numbered JOIN (SELECT chat_id, message_id, around_n FROM ctx) USING (chat_id, message_id)
GROUP BY chat_id, batch_no""",
)
def batches(spark, sf):
    messages = fx.messages(spark, sf)
    made = pl.create_batches(messages, pl.filter_candidates(messages))
    sizes = F.transform(
        "items", lambda i: F.size(i.context.previous) + F.size(i.context.next) + F.lit(1)
    )
    return made.select(
        "chat_id",
        "batch_no",
        F.size("items").alias("items"),
        F.array_join(F.transform("items", lambda i: i.message_id.cast("string")), ",").alias("message_ids"),
        F.aggregate(sizes, F.lit(0), lambda a, x: a + x).alias("context_messages"),
    )


@register(
    "prompt_blocks",
    f"""WITH {MSGS}, {CANDS}, {_contexts('msgs')}, {NUMBERED}
SELECT chat_id, batch_no::BIGINT AS batch_no, string_agg(
  printf({quote(cand.BLOCK_FORMAT)}, message_id, prev_lines, "user" || ': ' || message, next_lines),
  {quote(cand.BLOCK_SEPARATOR)} ORDER BY message_id) AS conversations
FROM numbered JOIN (SELECT chat_id, message_id, prev_lines, next_lines FROM ctx)
  USING (chat_id, message_id)
GROUP BY chat_id, batch_no""",
)
def prompt_blocks(spark, sf):
    messages = fx.messages(spark, sf)
    return pl.prompt_blocks(pl.create_batches(messages, pl.filter_candidates(messages)))


# --- text functions ---------------------------------------------------------------------------


@register(
    "searchable",
    f"""WITH {EV} SELECT event_id, lower({s_strip("message")}) NOT IN
  ({", ".join(quote(s) for s in kw.UNSEARCHABLE)}) AND {s_word_count("message")} >= 3 AS searchable
FROM evc""",
)
def searchable(spark, sf):
    return fx.event_messages(spark, sf).select(
        "event_id", kw.searchable(F.col("message")).alias("searchable")
    )


def s_normalize(x: str) -> str:
    bare = f"regexp_replace(lower({x}), {quote(tx.FULL_URL)}, ' ', 'g')"
    return s_strip(s_collapse(f"regexp_replace({bare}, '[^a-z0-9{tx.WS}]', ' ', 'g')"))


def s_keywords(x: str) -> str:
    stop = ", ".join(quote(w) for w in kw.QUESTION_STOP_WORDS)
    return f"""list_filter(string_split({s_normalize(x)}, ' '),
  lambda w: len(w) >= 3 AND NOT list_contains([{stop}], w))"""


def s_overlap(asked: str, x: str) -> str:
    return f"""(CASE WHEN len({s_keywords(asked)}) = 0 THEN 0.0::DOUBLE ELSE coalesce(
  len(list_intersect(list_distinct({s_keywords(asked)}), list_distinct({s_keywords(x)})))::DOUBLE
  / len(list_distinct({s_keywords(asked)})), 0.0) END)"""


@register("normalize_text", f"SELECT page_id, {s_normalize('html')} AS normalized FROM pages")
def normalize_text(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id", kw.normalize(F.col("html")).alias("normalized")
    )


@register(
    "keywords", f"SELECT doc_id, array_to_string({s_keywords('text')}, ' ') AS keywords FROM documents"
)
def keywords(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.array_join(kw.keywords(F.col("text")), " ").alias("keywords")
    )


@register(
    "keyword_score",
    f"""WITH {CONV} SELECT chat_id, message_id,
  round({s_overlap("'The heures of und ' || \"user\" || ' with des mit'", 'message')}, 6) AS keyword_score
FROM conv""",
)
def keyword_score(spark, sf):
    """A question that differs from row to row, so both sides are computed per row."""
    asked = F.concat(F.lit("The heures of und "), "user", F.lit(" with des mit"))
    return fx.conversation_messages(spark, sf).select(
        "chat_id",
        "message_id",
        F.round(kw.keyword_score(asked, F.col("message")), 6).alias("keyword_score"),
    )


_VALUE_CASES = """CASE turn % 5 WHEN 0 THEN ' ' || text WHEN 1 THEN '  None ' || chr(10)
  WHEN 2 THEN 'NaN' WHEN 3 THEN chr(9) END"""


@register(
    "clean_values",
    f"""WITH v AS (SELECT conv_id, turn, {_VALUE_CASES} AS v FROM conversations)
SELECT conv_id, turn, CASE WHEN lower({s_strip("v")}) NOT IN ('', 'none', 'null', 'nan')
  THEN {s_strip("v")} END AS value FROM v""",
)
def clean_values(spark, sf):
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", cl.clean_value(F.expr(_VALUE_CASES)).alias("value")
    )


_EVIDENCE_CASES = """CASE doc_id % 5 WHEN 0 THEN translate(substr(text, 11, 60),
    'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
  WHEN 1 THEN '  ' || replace(substr(text, 1, 80), ' ', '   ')
  WHEN 2 THEN substr(text, 5, 40) || '~~' WHEN 3 THEN '  ' END"""


@register(
    "evidence_check",
    f"""WITH v AS (SELECT doc_id, lower({s_strip(_EVIDENCE_CASES)}) AS e, lower({s_strip("text")}) AS c
  FROM documents)
SELECT doc_id, coalesce(e <> '' AND c <> '' AND (contains(c, e) OR
  contains({s_collapse("c")}, {s_collapse("e")})), false) AS found FROM v""",
)
def evidence_check(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", cl.evidence_in(F.expr(_EVIDENCE_CASES), F.col("text")).alias("found")
    )


def s_action_key(x: str) -> str:
    plain = f"regexp_replace(lower({s_strip(x)}), '[^a-z0-9{tx.WS}]', ' ', 'g')"
    filler = ", ".join(quote(w) for w in cl.FILLER_WORDS)
    return f"""coalesce(array_to_string(list_filter({fx.s_words(plain)},
  lambda w: w <> '' AND NOT list_contains([{filler}], w)), ' '), '')"""


def s_deadline_key(x: str) -> str:
    return f"coalesce({s_collapse(s_strip(f'lower({x})'))}, '')"


@register(
    "action_key",
    f"""WITH {CONV} SELECT chat_id, message_id, {s_action_key("message")} AS action_key,
  {s_deadline_key("message")} AS deadline_key FROM conv""",
)
def action_key(spark, sf):
    return fx.conversation_messages(spark, sf).select(
        "chat_id",
        "message_id",
        cl.action_key(F.col("message")).alias("action_key"),
        cl.deadline_key(F.col("message")).alias("deadline_key"),
    )
