"""The barrier of groups of background tasks as a stream with a state for each group and a timer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "group_id string, members int, completed int, failed int, resumed boolean, status string, ready boolean, expired boolean"
_NONE = -(1 << 62)


class Barrier(StatefulProcessor):
    """Of each task the first registration and the last completion and failure, of a group the last resumption.

    What counts is decided by the events' own order (ts, event_id), not by their arrival: late events within the
    watermark and repeated ones end in the same state. A group without events for `idle_ms` of event time is reported
    once more as expired, and its state goes.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        times = ", ".join(f"{what}_{part} bigint" for what in ("registered", "completed", "failed") for part in ("ts", "id"))
        self.tasks = handle.getMapState("tasks", "task string", times)
        self.resumed = handle.getValueState("resumed", "ts bigint, id bigint")

    def _update(self, rows: pd.DataFrame) -> None:
        for task, kind, ts, event in zip(rows["task"], rows["kind"], rows["ts"], rows["event_id"]):
            at = (int(pd.Timestamp(ts).value // 1000), int(event))
            if kind == "resume":
                self.resumed.update(max(at, self.resumed.get() if self.resumed.exists() else at))
                continue
            if task is None or not task.strip():
                continue
            held = self.tasks.getValue((task,)) if self.tasks.containsKey((task,)) else (-_NONE, -_NONE, _NONE, _NONE, _NONE, _NONE)
            registered, completed, failed = tuple(held[:2]), tuple(held[2:4]), tuple(held[4:])
            if kind == "register":
                registered = min(registered, at)
            elif kind in ("complete", "fail"):
                completed = max(completed, at)
                failed = max(failed, at) if kind == "fail" else failed
            else:
                continue
            self.tasks.updateValue((task,), (*registered, *completed, *failed))

    def _state(self, key, expired: bool) -> pd.DataFrame | None:
        held = [(tuple(v[:2]), tuple(v[2:4]), tuple(v[4:])) for _, v in self.tasks.iterator()]
        begun = min((r for r, _, _ in held), default=(-_NONE, -_NONE))
        if begun[0] == -_NONE:
            return None  # nothing is registered yet
        members = sum(r[0] != -_NONE for r, _, _ in held)
        completed, failed = sum(c >= begun for _, c, _ in held), sum(f >= begun for _, _, f in held)
        resumed = self.resumed.exists() and tuple(self.resumed.get()) >= begun
        done = completed >= members
        status = "resumed" if resumed else "running" if not done else "failed" if failed else "completed"
        return pd.DataFrame({"group_id": [str(key[0])], "members": [members], "completed": [completed], "failed": [failed], "resumed": [resumed], "status": [status], "ready": [done and not resumed], "expired": [expired]})

    def handleInputRows(self, key, rows, timerValues):
        last = 0
        for batch in rows:
            self._update(batch)
            last = max(last, int(pd.Timestamp(batch["ts"].max()).value // 1_000_000))
        for timer in list(self.handle.listTimers()):
            last = max(last, int(timer) - self.idle_ms)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        out = self._state(key, False)
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = self._state(key, True)
        self.tasks.clear()
        self.resumed.clear()
        if out is not None:
            yield out

    def close(self) -> None:
        pass


def barriers(events: DataFrame, late: str = "1 hour", idle_ms: int = 6 * 3_600_000) -> DataFrame:
    """A row with a group's state for each batch that has events of it, and one when it expires.

    events: a stream of (group_id string, task string, kind string, ts timestamp, event_id long). The state store must be
    RocksDB (spark.sql.streaming.stateStore.providerClass); update mode.
    """
    own = events.select("group_id", "task", "kind", "ts", "event_id").withWatermark("ts", late)
    return own.groupBy("group_id").transformWithStateInPandas(Barrier(idle_ms), _OUT, "Update", "EventTime")
