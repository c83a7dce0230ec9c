"""K1/K3: online user features with late labels, as one keyed operator over typed state.

Per user the state holds

* a value: the counters, how many early labels wait and the last ``n - 1``
  answered question rows, for sequences,
* a map of the rows still waiting for their answer, one entry a row,
* a map of labels that came before their row,
* a map from a due time to the rows and labels that came at that time.

A call reads and writes only the entries its events name, so its cost does not
grow with the rows a user has waiting, and what is answered within the call
never reaches the state store.  For each group of events (one
micro-batch of the online loop) the operator (a) folds the labels of the
previous group into the state, (b) scores the new rows from the state without
updating it, then (c) makes the new rows pending.  Events are processed group
by group in group order inside each call, so the result does not depend on how
groups are packed into micro-batches.

Event-time timers on the arrival time free what never finds its other half, for
users without further events too: a row without an answer leaves as a row of
kind ``expired_row`` after ``row_ttl_ms``, a label without a row as
``expired_label``, at the latest after the same time and, when the user goes
on, after ``ttl_groups`` groups.  Nothing leaves silently.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

N_SEQ = 21
TTL_GROUPS = 10
ROW_TTL_MS = 24 * 3_600_000
DELAY = "1 hour"

OUTPUT_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("group_num", T.LongType()), T.StructField("u_cnt", T.LongType()),
    T.StructField("u_corr_cnt", T.LongType()), T.StructField("u_corr_rate", T.DoubleType()),
    T.StructField("u_hist_lec_cnt", T.LongType()),
    T.StructField("seq_content_id", T.ArrayType(T.LongType())),
    T.StructField("seq_answered_correctly", T.ArrayType(T.LongType())),
    T.StructField("seq_timestamp_diff", T.ArrayType(T.LongType())),
    T.StructField("kind", T.StringType()),     # feature, expired_row, or expired_label (its answer in u_corr_cnt)
])

INPUT_COLUMNS = ["kind", "group_num", "row_id", "user_id", "timestamp", "content_id", "content_type_id",
                 "answered_correctly", "arrival_ts"]


def millis(at) -> int:
    """Milliseconds since the epoch, floored; a time without zone is in UTC."""
    utc = at if at.tzinfo is None else at.astimezone(timezone.utc).replace(tzinfo=None)
    return int((utc - datetime(1970, 1, 1)) // timedelta(milliseconds=1))


def events_of(rows) -> Iterator:
    """The events of a call one by one, from rows or from frames."""
    for x in rows:
        if isinstance(x, pd.DataFrame):
            yield from x.itertuples(index=False)
        else:
            yield x


class UserLoop(StatefulProcessor):
    """The online loop of one user."""

    def __init__(self, n_seq: int = N_SEQ, ttl_groups: int = TTL_GROUPS, row_ttl_ms: int = ROW_TTL_MS):
        self.n_seq, self.ttl_groups, self.row_ttl_ms = n_seq, ttl_groups, row_ttl_ms
        self.row = Row(*[f.name for f in OUTPUT_SCHEMA.fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "u_cnt long, u_corr long, lec long, n_early long, "
                                             "content array<long>, answer array<long>, ts array<long>")
        self.pending = handle.getMapState("pending", "row_id long", "ct int, content int, ts long, group_num long")
        self.early = handle.getMapState("early", "row_id long", "answer long, group_num long")
        self.due = handle.getMapState("due", "at long", "rows array<long>")

    def handleInputRows(self, key, rows, timerValues):
        user, n = int(key[0]), self.n_seq
        u_cnt, u_corr, lec, n_early, *last = self.counters.get() or (0, 0, 0, 0, [], [], [])
        recent = list(zip(*last))
        new: dict[int, tuple] = {}               # rows of this call that still wait
        ahead: set[int] = set()                  # labels of this call that still wait for their row
        waits: list[tuple] = []                  # (arrival, id) of what came to wait
        out = []

        def fold(found) -> None:
            """Labels into the state, in time order of their rows."""
            nonlocal u_cnt, u_corr, lec, recent
            for _, _, ct, content, ts, answer in sorted(found):
                if ct == 1:
                    lec += 1
                    continue
                u_cnt += 1
                u_corr += answer
                recent = (recent + [(content, answer, ts)])[-(n - 1):] if n > 1 else []

        def take(row_id):
            """The waiting row of that id, no longer waiting; None without one."""
            if row_id in new:
                return new.pop(row_id)
            if not self.pending.containsKey((row_id,)):
                return None
            row = tuple(self.pending.getValue((row_id,)))
            self.pending.removeKey((row_id,))
            return row

        def pad(xs, size):
            return [0] * (size - len(xs)) + xs if len(xs) < size else xs[len(xs) - size:]

        groups: dict[int, tuple] = {}            # group -> its labels and its rows
        for e in events_of(rows):
            if not pd.isna(e.group_num):
                groups.setdefault(int(e.group_num), ([], []))[e.kind == "row"].append(e)
        for g in sorted(groups):
            labels, some = groups[g]
            # (a) labels of the previous group
            found = []
            for e in labels:
                r, a = int(e.row_id), int(e.answered_correctly)
                row = take(r)
                if row is None:
                    if not self.early.containsKey((r,)):
                        n_early += 1
                    self.early.updateValue((r,), (a, g))
                    ahead.add(r)
                    waits.append((e.arrival_ts, r))
                else:
                    found.append((row[2], r, row[0], row[1], row[2], a))
            fold(found)
            # (b) score the new rows from the state, without updating it
            rate = u_corr / u_cnt if u_cnt else None
            h_c, h_a, h_t = ([x[k] for x in recent] for k in range(3))
            for e in sorted(some, key=lambda e: (e.timestamp, e.row_id)):
                r, c, ct, t = int(e.row_id), int(e.content_id), int(e.content_type_id), int(e.timestamp)
                if ct == 0:
                    ts = pad(h_t + [t], n)
                    out.append((r, user, g, u_cnt, u_corr, rate, lec, pad(h_c + [c], n)[1:], pad(h_a, n - 1),
                                [b - a for a, b in zip(ts[:-1], ts[1:])], "feature"))
                new[r] = (ct, c, t, g)
                waits.append((e.arrival_ts, r))
            # (c) labels that came before their row, then those that waited too long
            if n_early:
                found = []
                for (r,), (a, since) in [(tuple(k), tuple(v)) for k, v in self.early.iterator()]:
                    row = take(r)
                    if row is not None:
                        found.append((row[2], r, row[0], row[1], row[2], a))
                    elif g - since > self.ttl_groups:
                        out.append((r, user, g, None, a, None, None, None, None, None, "expired_label"))
                    else:
                        continue
                    self.early.removeKey((r,))
                    ahead.discard(r)
                    n_early -= 1
                fold(found)
        for r, row in new.items():
            self.pending.updateValue((r,), row)
        self._wait([(at, r) for at, r in waits if r in new or r in ahead])
        self.counters.update((u_cnt, u_corr, lec, n_early, *([x[k] for x in recent] for k in range(3))))
        yield from (self.row(*x) for x in out)

    def _wait(self, waits: list) -> None:
        """Timers of the rows and labels (arrival, id) that still wait at the end of the call."""
        due: dict[int, list] = {}
        for at, r in waits:
            due.setdefault(millis(at) + self.row_ttl_ms, []).append(r)
        for at, ids in due.items():
            before = list(self.due.getValue((at,))[0]) if self.due.containsKey((at,)) else []
            self.due.updateValue((at,), (before + ids,))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        user, at = int(key[0]), expiredTimerInfo.getExpiryTimeInMs()
        out = []
        if self.due.containsKey((at,)):
            u_cnt, u_corr, lec, n_early, *last = self.counters.get()
            for r in self.due.getValue((at,))[0]:
                if self.pending.containsKey((r,)):
                    g = self.pending.getValue((r,))[3]
                    out.append((r, user, g, None, None, None, None, None, None, None, "expired_row"))
                    self.pending.removeKey((r,))
                if self.early.containsKey((r,)):
                    a, g = self.early.getValue((r,))
                    out.append((r, user, g, None, a, None, None, None, None, None, "expired_label"))
                    self.early.removeKey((r,))
                    n_early -= 1
            self.due.removeKey((at,))
            self.counters.update((u_cnt, u_corr, lec, n_early, *last))
        yield from (self.row(*x) for x in out)

    def close(self) -> None:
        pass


def online_user_features(events: DataFrame, n_seq: int = N_SEQ, ttl_groups: int = TTL_GROUPS,
                         row_ttl_ms: int = ROW_TTL_MS, delay: str | None = DELAY) -> DataFrame:
    """Keyed stateful scoring of an event stream.  ``delay`` bounds how far apart in arrival time the
    events of one moment may reach the operator (the watermark is that far behind); None if the
    stream has its watermark on ``arrival_ts`` already.  Needs the RocksDB state store."""
    ev = events.withWatermark("arrival_ts", delay) if delay else events
    return (ev.filter("kind IN ('row', 'label')").select(*INPUT_COLUMNS).groupBy("user_id")
            .transformWithState(UserLoop(n_seq, ttl_groups, row_ttl_ms), OUTPUT_SCHEMA, "Append", "EventTime"))
