"""Keyed state of the streaming jobs that look back or wait: values, lists and event-time timers per key.

Rows of a key come in chunks; only times and numbers are kept of them. Expiry follows event
time and never the clock: a job that is stopped for a week, or replays a month in an hour,
gives the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opslens.functions.codes import MILESTONE_GAP_SECONDS, MILESTONES

# Executors get the classes below with the tasks; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RESPONSE_ROWS = ("server_name string, rule string, event_id long, event_time timestamp, "
                 "error_number long, severity long")
MILESTONE_ROWS = ("server_name string, job_id long, milestone long, sampled_at timestamp, "
                  "percent_complete double, announced boolean")
MILESTONE_HISTORY = "server_name string, job_id long, milestone long, announced_at timestamp"
RATE_ROWS = ("server_name string, counter_name string, instance_name string, sample_id long, "
             "captured_at timestamp, seconds long, change long, rate_per_second long")


def _micros(times: pd.Series) -> np.ndarray:
    if times.dt.tz is not None:
        times = times.dt.tz_convert("UTC").dt.tz_localize(None)
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def _stamps(micros: Iterable[int]) -> pd.Series:
    return pd.Series(pd.to_datetime(np.asarray(list(micros), dtype=np.int64), unit="us"))


class RateLimit(StatefulProcessor):
    """Responses of a key at least a delay apart, in the order of event time within a micro-batch.

    The last response is forgotten once the watermark is the delay past it: no row that may
    still come could be held back by it.
    """

    def __init__(self, delay_seconds: int):
        self.gap = delay_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        waiting = []
        for chunk in rows:
            at = _micros(chunk["event_time"])
            open_ = np.ones(len(at), dtype=bool) if last is None else at >= last + self.gap
            waiting.append(chunk.assign(_at=at)[open_])
        found = pd.concat(waiting).sort_values(["_at", "event_id"], ignore_index=True)
        at, chosen = found["_at"].to_numpy(), []
        i = 0
        while i < len(at):
            chosen.append(i)
            i = int(np.searchsorted(at, at[i] + self.gap, side="left"))
        if chosen:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = int(at[chosen[-1]])
            self.last.update((last,))
            self.handle.registerTimer((last + self.gap) // 1000 + 1)
        yield found.iloc[chosen][["server_name", "rule", "event_id", "event_time", "error_number", "severity"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class Milestones(StatefulProcessor):
    """Bands of progress as they are first reached; starts from what a history has announced already."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reached = handle.getValueState("reached", "milestone long, announced_at long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        newest = initialState.sort_values("milestone").iloc[-1]
        told = initialState["announced_at"].dropna()
        self.reached.update((int(newest["milestone"]), int(_micros(told).max()) if len(told) else None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        milestone, announced_at = self.reached.get() if self.reached.exists() else (0, None)
        firsts: dict[int, tuple] = {}
        for chunk in rows:
            chunk = chunk.assign(_at=_micros(chunk["sampled_at"]))
            for low, high in MILESTONES:
                inside = chunk[(chunk["percent_complete"] >= low) & (chunk["percent_complete"] < high)]
                if len(inside):
                    row = inside.sort_values(["_at", "sample_id"]).iloc[0]
                    found = (int(row["_at"]), int(row["sample_id"]), float(row["percent_complete"]))
                    firsts[low] = min(firsts.get(low, found), found)
        reached = []
        for low, (at, _, percent) in sorted(firsts.items(), key=lambda item: item[1]):
            if low <= milestone:
                continue
            milestone = low
            told = announced_at is None or at // 1_000_000 - announced_at // 1_000_000 > MILESTONE_GAP_SECONDS
            if told:
                announced_at = at
            reached.append((*key, low, at, percent, told))
        if reached:
            self.reached.update((milestone, announced_at))
        found = pd.DataFrame(reached, columns=["server_name", "job_id", "milestone", "sampled_at", "percent_complete", "announced"])
        yield found.assign(sampled_at=_stamps(found["sampled_at"]))

    def close(self) -> None:
        pass


class OrderedRates(StatefulProcessor):
    """Samples wait until the watermark has passed them, then each is paired with the one before it.

    Spark leaves out rows behind the watermark, so a sample never comes after a later one was paired.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, value long")
        self.last = handle.getValueState("last", "at long, id long, value long")

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        names = ["server_name", "counter_name", "instance_name", "sample_id", "captured_at", "seconds", "change", "rate_per_second"]
        found = pd.DataFrame([(*key, *r) for r in rows], columns=names)
        return found.assign(captured_at=_stamps(found["captured_at"]), **{c: found[c].astype("Int64") for c in ("seconds", "change", "rate_per_second")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for chunk in rows:
            fresh += zip(_micros(chunk["captured_at"]).tolist(), chunk["sample_id"].tolist(), chunk["value"].tolist())
        timers = list(self.handle.listTimers())
        due = min(at for at, _, _ in fresh) // 1000 + 1
        if not timers or due < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        self.waiting.appendList(fresh)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        samples = sorted(tuple(s) for s in self.waiting.get())
        due = [s for s in samples if s[0] < passed]
        last = tuple(self.last.get()) if self.last.exists() else None
        paired = []
        for at, id, value in due:
            if last is not None:
                seconds, change = at // 1_000_000 - last[0] // 1_000_000, value - last[2]
                rate = (abs(change) // seconds) * (1 if change >= 0 else -1) if seconds > 0 else None
                paired.append((id, at, seconds, change, rate))
            last = (at, id, value)
        rest = samples[len(due):]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        if last is not None:
            self.last.update(last)
        if paired:
            yield self._rows(key, paired)

    def close(self) -> None:
        pass
