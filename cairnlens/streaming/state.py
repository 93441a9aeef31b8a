"""State machines of the streams: one small state per key, rows in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairnlens import vocab

RETENTION_MS = vocab.RECENT_HOURS * 3600 * 1000


def _millis(at) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


def _plain(at):
    return None if at is None else pd.Timestamp(at).to_pydatetime()


def _in_order(rows: Iterator[pd.DataFrame], column: str) -> pd.DataFrame:
    """One key's rows of one micro-batch; the trigger's byte limit bounds them."""
    return pd.concat(list(rows), ignore_index=True).sort_values(column, kind="stable")


class StageVisits(StatefulProcessor):
    """Keeps the open stage of a task; a change of stage closes it.

    A timer drops the state of a task that stayed silent for the recent window, as
    events that old are not looked at.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState(
            "open", "sequence BIGINT, stage STRING, started_at TIMESTAMP, seen_at TIMESTAMP"
        )

    def handleInputRows(self, key, rows, timerValues):
        known = self._open.exists()
        state = self._open.get() if known else None
        closed = []
        for row in _in_order(rows, "event_sequence").itertuples(index=False):
            if state is not None and row.event_sequence <= state[0]:
                continue  # delivered before
            if state is None or row.stage != state[1]:
                if state is not None:
                    closed.append((key[0], state[1], state[2], row.created_at))
                state = (int(row.event_sequence), row.stage, row.created_at, row.created_at)
            else:
                state = (int(row.event_sequence), state[1], state[2], row.created_at)
        self._open.update((state[0], state[1], _plain(state[2]), _plain(state[3])))
        if not known:
            self._handle.registerTimer(_millis(state[3]) + RETENTION_MS)
        yield pd.DataFrame(closed, columns=["task_id", "stage", "started_at", "completed_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self._open.exists():
            due = _millis(self._open.get()[3]) + RETENTION_MS
            if due <= timerValues.getCurrentWatermarkInMs():
                self._open.clear()
            else:
                self._handle.registerTimer(due)
        yield pd.DataFrame([], columns=["task_id", "stage", "started_at", "completed_at"])

    def close(self) -> None:
        pass


class OrderedBatches(StatefulProcessor):
    """Gives a task's events out in the order of their sequence numbers, in batches.

    Events ahead of a gap wait in a map. If the gap is not filled within the patience
    (processing time, so no event is dropped as late), it is given up: what waits goes
    on, and the first event behind it states how many numbers were skipped. An event of
    a gap that was given up still comes out, marked as late and without a batch; any
    other event below the next number was delivered before.
    """

    COLUMNS = ["task_id", "event_sequence", "event_type", "created_at", "batch", "position", "skipped", "late"]

    def __init__(self, first: int, size: int, patience_seconds: int):
        self.first, self.size, self.patience_ms = first, size, patience_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._progress = handle.getValueState("progress", "next BIGINT, given BIGINT, waiting BIGINT")
        self._waiting = handle.getMapState("waiting", "sequence BIGINT", "event_type STRING, created_at TIMESTAMP")
        self._missed = handle.getMapState("missed", "start BIGINT", "stop BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        ahead, given, waiting = self._progress.get() if self._progress.exists() else (self.first, 0, 0)
        had, out = waiting, []
        for row in _in_order(rows, "event_sequence").itertuples(index=False):
            sequence, event = int(row.event_sequence), (row.event_type, _plain(row.created_at))
            if sequence < ahead:
                if self._fill(sequence):
                    out.append((key[0], sequence, *event, None, None, 0, True))
            elif sequence > ahead:
                if not (waiting and self._waiting.containsKey((sequence,))):
                    self._waiting.updateValue((sequence,), event)
                    waiting += 1
            else:
                if waiting and self._waiting.containsKey((sequence,)):  # behind a gap that ended here
                    self._waiting.removeKey((sequence,))
                    waiting -= 1
                out.append(self._row(key[0], sequence, event, given, 0))
                ahead, given = ahead + 1, given + 1
                ahead, given, waiting = self._drain(key[0], ahead, given, waiting, out, 0)
        self._progress.update((ahead, given, waiting))
        self._wait(had, waiting, timerValues)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ahead, given, waiting = self._progress.get()
        out = []
        if waiting:
            nearest = min(k[0] for k in self._waiting.keys())
            self._missed.updateValue((ahead,), (nearest,))
            ahead, given, waiting = self._drain(key[0], nearest, given, waiting, out, nearest - ahead)
            self._progress.update((ahead, given, waiting))
            self._wait(0, waiting, timerValues)
        yield self._frame(out)

    def _drain(self, task, ahead, given, waiting, out, skipped):
        while waiting and self._waiting.containsKey((ahead,)):
            event = self._waiting.getValue((ahead,))
            self._waiting.removeKey((ahead,))
            out.append(self._row(task, ahead, (event[0], event[1]), given, skipped))
            ahead, given, waiting, skipped = ahead + 1, given + 1, waiting - 1, 0
        return ahead, given, waiting

    def _fill(self, sequence: int) -> bool:
        """Whether the number lies in a gap that was given up; it is then known."""
        for start, stop in [(k[0], v[0]) for k, v in self._missed.iterator()]:
            if start <= sequence < stop:
                self._missed.removeKey((start,))
                for low, high in ((start, sequence), (sequence + 1, stop)):
                    if low < high:
                        self._missed.updateValue((low,), (high,))
                return True
        return False

    def _wait(self, had: int, waiting: int, timerValues) -> None:
        timers = list(self._handle.listTimers())
        if not waiting or not had:
            for timer in timers:
                self._handle.deleteTimer(timer)
            timers = []
        if waiting and not timers:
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def _row(self, task, sequence, event, given, skipped):
        return (task, sequence, *event, given // self.size, given % self.size + 1, skipped, False)

    def _frame(self, rows) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=self.COLUMNS)
        return frame.astype({"batch": "Int64", "position": "Int64"})

    def close(self) -> None:
        pass


class FailureBursts(StatefulProcessor):
    """Fixed window per client from its first attempt; a full window starts a block.

    Attempts during a block change nothing; the first one afterwards, or after the
    window ended, opens a new window. A timer forgets clients whose window and block
    have passed.
    """

    COLUMNS = ["client", "window_started_at", "blocked_at", "blocked_until", "failure_count"]

    def __init__(self, threshold: int, window_seconds: int, block_seconds: int):
        self.threshold = threshold
        self.window = pd.Timedelta(seconds=window_seconds)
        self.block = pd.Timedelta(seconds=block_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._window = handle.getValueState(
            "window", "started_at TIMESTAMP, failures BIGINT, blocked_until TIMESTAMP"
        )

    def handleInputRows(self, key, rows, timerValues):
        known = self._window.exists()
        started, failures, blocked = None, 0, None
        if known:
            started, failures, blocked = self._window.get()
        bursts = []
        for row in _in_order(rows, "attempt_id").itertuples(index=False):
            now = row.attempted_at
            if blocked is not None and blocked > now:
                continue
            if started is None or blocked is not None or started + self.window <= now:
                started, failures, blocked = now, 0, None
            if row.failed:
                failures += 1
                if failures >= self.threshold:
                    blocked = now + self.block
                    bursts.append((key[0], started, now, blocked, failures))
        self._window.update((_plain(started), int(failures), _plain(blocked)))
        if not known:
            self._handle.registerTimer(self._due(started, blocked))
        yield pd.DataFrame(bursts, columns=self.COLUMNS)

    def _due(self, started, blocked) -> int:
        return _millis(blocked if blocked is not None else started + self.window)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self._window.exists():
            started, _, blocked = self._window.get()
            due = self._due(started, blocked)
            if due <= timerValues.getCurrentWatermarkInMs():
                self._window.clear()
            else:
                self._handle.registerTimer(due)
        yield pd.DataFrame([], columns=self.COLUMNS)

    def close(self) -> None:
        pass


class WorkerFreshness(StatefulProcessor):
    """Remembers each worker's last heartbeat; a timer reports it when it gets stale."""

    def __init__(self, max_age_seconds: int):
        self.max_age_ms = max_age_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "last_checked_at TIMESTAMP")

    def handleInputRows(self, key, rows, timerValues):
        beats = _in_order(rows, "last_checked_at")
        newest = beats.iloc[-1]
        at = pd.Timestamp(newest["last_checked_at"])
        if self._last.exists() and pd.Timestamp(self._last.get()[0]) > at:
            yield self._rows([])
            return
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if newest["status"] != "ready":
            self._last.clear()
            yield self._rows([(key[0], at, "stopped")])
            return
        self._last.update((at.to_pydatetime(),))
        self._handle.registerTimer(int(at.timestamp() * 1000) + self.max_age_ms)
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self._last.exists():
            at = pd.Timestamp(self._last.get()[0])
            self._last.clear()
            yield self._rows([(key[0], at, "stale")])
        else:
            yield self._rows([])

    @staticmethod
    def _rows(rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["worker_owner", "last_checked_at", "reason"])

    def close(self) -> None:
        pass
