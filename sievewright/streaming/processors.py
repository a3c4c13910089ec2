"""Stateful processors of event feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class AgentTimes(StatefulProcessor):
    """How long agents take, by event time. Timers are in whole milliseconds, so one fires at the first that isn't before its event; events are taken in the order of their microseconds."""

    def __init__(self, timeout: int, started: str):
        self.timeout, self.started = timeout, started

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "micros long, event_id long", "event_type string")
        self.start = handle.getValueState("start", "micros long, event_id long, open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            micros = pdf["ts"].astype("datetime64[us]").astype("int64") if pdf["ts"].dt.tz is None else pdf["ts"].dt.tz_convert("UTC").dt.tz_localize(None).astype("datetime64[us]").astype("int64")
            for t, event, kind in zip(micros, pdf["event_id"], pdf["event_type"], strict=True):
                self.waiting.updateValue((int(t), int(event)), (kind,))
                self.handle.registerTimer(-(-int(t) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        out = []
        for (t, event), (kind,) in sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= now)):
            self.waiting.removeKey((t, event))
            self._lost(key, t, out)
            held = self.start.get()
            if kind == self.started:
                self.start.update((t, event, True))
                self.handle.registerTimer(-(-(t + self.timeout + 1) // 1000))
            elif held is not None:
                if t - held[0] <= self.timeout:
                    out.append((key[0], event, kind, round((t - held[0]) / 1e6, 3)))
                self.start.update((held[0], held[1], False))
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        if not any(k[0] <= reached for k, _ in self.waiting.iterator()):
            now = max(now, reached)  # a timer set here would wait for another batch, which may never come
        self._lost(key, now, out)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "outcome", "elapsed"])

    def _lost(self, key, now: int, out: list) -> None:
        """A start that nothing has followed within its time."""
        held = self.start.get()
        if held is not None and held[2] and now - held[0] > self.timeout:
            self.start.update((held[0], held[1], False))
            out.append((key[0], held[1], "timed_out", self.timeout / 1e6))

    def close(self) -> None:
        pass
