"""K2: label lists met with the rows they label, as a keyed operator on the group number.

The online loop sends, on group n, one list with the answers of group n - 1 in
row order.  Rows and lists are keyed by the group the answers belong to: rows
are appended to a list state, the list is a value, and when both are complete
the i-th element labels the i-th row by id and the state is cleared.  A timer on
the arrival time frees both sides of a group that never completes, as rows of
kind ``unmatched_row`` and ``unmatched_list``.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracefeat.streaming.events import EVENT_SCHEMA
from tracefeat.streaming.user_state import events_of, millis

GROUP_TTL_MS = 24 * 3_600_000
INPUT_COLUMNS = ["kind", "row_id", "user_id", "timestamp", "arrival_ts", "prior_group_answers_correct", "prior_group_responses"]


class LabelMatcher(StatefulProcessor):
    """Rows and answer list of one group."""

    def __init__(self, ttl_ms: int = GROUP_TTL_MS):
        self.ttl_ms = ttl_ms
        self.names = [f.name for f in EVENT_SCHEMA.fields]
        self.row = Row(*self.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "row_id long, user_id long, timestamp long")
        self.answers = handle.getValueState("answers", "correct string, responses string, arrival long")
        self.size = handle.getValueState("size", "n long, due long")

    def _event(self, at_ms: int, **values) -> Row:
        values["arrival_ts"] = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=at_ms)
        return self.row(*[values.get(name) for name in self.names])

    def handleInputRows(self, key, rows, timerValues):
        """A group that is whole within the call never reaches the state store."""
        group = int(key[0])
        size = self.size.get()
        n, due = size or (0, 0)
        newest, new, sent = 0, [], None
        for e in events_of(rows):
            at = millis(e.arrival_ts)
            newest = max(newest, at)
            if e.kind == "row":
                new.append((int(e.row_id), int(e.user_id), int(e.timestamp)))
            elif e.kind == "list":
                sent = (e.prior_group_answers_correct, e.prior_group_responses, at)
        n += len(new)
        answers = sent or (self.answers.get() if size else None)
        if answers:
            c, a, at = answers
            c, a = json.loads(c), json.loads(a)
            if n == len(c) == len(a):
                own = sorted(new + ([tuple(r) for r in self.rows.get()] if size else []))
                for (r, u, t), x, y in zip(own, c, a):
                    yield self._event(max(at, newest), kind="label", group_num=group + 1, row_id=r, user_id=u, timestamp=t,
                                      answered_correctly=x, user_answer=y)
                if size:
                    self._clear()
                if due:
                    self.handle.deleteTimer(due)
                return
        if new:
            self.rows.appendList(new)
        if sent:
            self.answers.update(sent)
        if not due:
            due = newest + self.ttl_ms
            self.handle.registerTimer(due)
        self.size.update((n, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        group = int(key[0])
        at = timerValues.getCurrentWatermarkInMs() + 1
        for r, u, t in sorted(tuple(r) for r in self.rows.get()):
            yield self._event(at, kind="unmatched_row", group_num=group, row_id=r, user_id=u, timestamp=t)
        if self.answers.exists():
            c, a, _ = self.answers.get()
            yield self._event(at, kind="unmatched_list", group_num=group + 1, prior_group_answers_correct=c,
                              prior_group_responses=a)
        self._clear()

    def _clear(self) -> None:
        self.rows.clear()
        self.answers.clear()
        self.size.clear()

    def close(self) -> None:
        pass


def match_label_lists(events: DataFrame, ttl_ms: int = GROUP_TTL_MS) -> DataFrame:
    """Label events from the rows and lists of a stream with its watermark on ``arrival_ts``."""
    group = F.when(F.col("kind") == "list", F.col("group_num") - 1).otherwise(F.col("group_num"))
    return (events.filter("kind IN ('row', 'list')").select(*INPUT_COLUMNS, group.alias("label_group")).groupBy("label_group")
            .transformWithState(LabelMatcher(ttl_ms), EVENT_SCHEMA, "Append", "EventTime",
                                        eventTimeColumnName="arrival_ts"))


def with_matched_labels(events: DataFrame, ttl_ms: int = GROUP_TTL_MS) -> DataFrame:
    """The stream's rows and, in place of its lists, the label events they hold: what K1 reads."""
    labels = match_label_lists(events, ttl_ms).filter("kind = 'label'")
    return events.filter("kind = 'row'").unionByName(labels.select(*[f.name for f in T.StructType(EVENT_SCHEMA.fields)]))
