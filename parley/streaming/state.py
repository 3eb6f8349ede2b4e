"""Chats as they are written: running ids, contexts and duplicates on a stream of messages.

``number_stream`` holds messages back until the watermark has passed them, so that late ones still find their place,
gives them the ids of the batch job and adds the lines around each. ``first_actions`` keeps the best result of every
action that was ever found. State is kept by Spark per chat, and per chat and action; it survives
restarts from the query's checkpoint, and needs the RocksDB state store (see ``STATE_STORE``).

The ids of a chat follow one after the other, so one task numbers a chat's messages. It holds those within the
lateness, and the last ones of the chat, whose following messages are still to come: these are emitted when
they are, and never if none follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import cleaning as cl
from ..operators.actions import add_action_keys

STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
_WAITING = "at bigint, seq bigint, user string, message string"
_NUMBERED = "message_id bigint, at bigint, seq bigint, user string, message string"


def _kind(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def use_state_store(spark: SparkSession) -> None:
    """Choose the state store that these operators need, for queries started afterwards."""
    spark.conf.set(*STATE_STORE)


class _Numbering(StatefulProcessor):
    """Ids and neighbours of one chat; `at` is a time in microseconds."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.recent = handle.getListState("recent", _NUMBERED)
        self.done = handle.getValueState("done", "n bigint, released bigint")

    def _state(self) -> tuple[int, int]:
        return self.done.get() if self.done.exists() else (0, -(1 << 62))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        released, least = self._state()[1], None
        for frame in rows:
            fresh = frame[frame["at"] > released]
            if len(fresh):
                columns = (fresh[c].tolist() for c in ("at", "seq", "user", "message"))
                self.waiting.appendList(list(zip(*columns)))
                first = int(fresh["at"].min())
                least = first if least is None else min(least, first)
        if least is not None:
            self.handle.registerTimer(-(-least // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in held if r[0] <= passed), key=lambda r: r[:2])
        if not due:
            return
        rest = [tuple(r) for r in held if r[0] > passed]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000))
        else:
            self.waiting.clear()
        n, _ = self._state()
        rows = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        emitted = max(0, len(rows) - self.window)  # the others wait for what follows them
        rows += [(n + i, *r) for i, r in enumerate(due, 1)]
        self.done.update((n + len(due), passed))
        complete = range(emitted, len(rows) - self.window)
        # of the emitted ones the last `window` stay, as what lies before the next
        self.recent.put(rows[max(0, len(rows) - 2 * self.window) :])
        if len(complete):
            lines = [f"{r[3]}: {r[4]}" for r in rows]
            yield pd.DataFrame(
                {
                    "chat_id": [key[0]] * len(complete),
                    "message_id": [rows[i][0] for i in complete],
                    "event_time": pd.to_datetime([rows[i][1] for i in complete], unit="us", utc=True),
                    "user": [rows[i][3] for i in complete],
                    "message": [rows[i][4] for i in complete],
                    "previous": [lines[max(0, i - self.window) : i] for i in complete],
                    "next": [lines[i + 1 : i + 1 + self.window] for i in complete],
                }
            )


def number_stream(
    messages: DataFrame, lateness: str = "10 minutes", window: int = 2, seq: str = "seq"
) -> DataFrame:
    """Messages of a stream (chat_id, event_time, seq, user, message) with ids and the lines around them.

    Ids count from 1 per chat in order of (event_time, `seq`), as in the batch job. A message is emitted when the watermark,
    `lateness` behind the latest one, and `window` further messages of its chat have passed it. Messages behind the watermark
    are dropped. `window` is 1 or more.
    """
    if window < 1:
        raise ValueError("a window of at least 1")
    rows = messages.withWatermark("event_time", lateness).select(
        "chat_id", "event_time", F.unix_micros("event_time").alias("at"), F.col(seq).cast("bigint").alias("seq"), "user", "message"
    )
    out = (
        f"chat_id {_kind(rows, 'chat_id')}, message_id bigint, event_time timestamp, user string, message string, "
        "previous array<string>, next array<string>"
    )
    return rows.groupBy("chat_id").transformWithStateInPandas(
        _Numbering(window), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


class _Best(StatefulProcessor):
    """The best result of one action: higher rank first, then the earlier and smaller one."""

    def __init__(self, columns: list[str], row: str):
        self.columns, self.row = columns, row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", f"confidence double, kind int, at bigint, message_id bigint, revision int, {self.row}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.best.get()) if self.best.exists() else None
        best = None if old is None else ((-old[0], -old[1], old[2], old[3]), old[5:])
        revision = 0 if old is None else old[4]
        changed = False
        for frame in rows:
            order = zip(-frame["rank_confidence"], -frame["rank_kind"], frame["rank_at"], frame["message_id"])
            values = frame[self.columns].astype(object).where(frame[self.columns].notna(), None)
            for rank, row in zip(order, values.itertuples(index=False, name=None)):
                if best is None or rank < best[0]:
                    best, changed = (rank, row), True
        if not changed:
            return
        (confidence, kind, at, message_id), row = best
        self.best.update((-float(confidence), -int(kind), int(at), int(message_id), revision + 1, *row))
        yield pd.DataFrame([[*row, revision + 1]], columns=[*self.columns, "revision"])


def first_actions(results: DataFrame, unicode_keys: bool = False) -> DataFrame:
    """The stream form of ``deduplicate_actions`` for results with the column `date`.

    Whenever a better result for an action of a chat arrives, it is emitted with the next `revision`; the row with the last
    revision is the one that the batch job keeps.
    """
    last = (1 << 62) - 1
    # no leading underscore: the state operator renames such columns
    keyed = add_action_keys(results, unicode_keys).withColumns(
        {
            "rank_confidence": F.coalesce(cl.to_number(F.col("confidence")), F.lit(0.0)),
            "rank_kind": cl.type_rank(F.col("type")).cast("int"),
            "rank_at": F.coalesce(F.unix_micros(F.col("date").cast("timestamp")), F.lit(last)),
        }
    )
    columns = results.columns
    row = ", ".join(f"`{c}` {_kind(results, c)}" for c in columns)
    stored = ", ".join(f"c{i} {_kind(results, c)}" for i, c in enumerate(columns))
    return keyed.groupBy("chat_id", "action_key", "deadline_key").transformWithStateInPandas(
        _Best(columns, stored), outputStructType=f"{row}, revision int", outputMode="Update", timeMode="None"
    )
