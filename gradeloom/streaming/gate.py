"""The state of the upload gate. Workers import this module, so it needs no session."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISION = "key string, event_id string, ts timestamp, decision string, remaining long, suspends boolean"


class UploadGate(StatefulProcessor):
    """The uploads of a bucket of keys, each key's decided in the order of their own times.

    Uploads wait in the state until the watermark passes their time, as an
    earlier one may still come; a timer then decides all that are due, in order.
    The state is one value for the bucket, as a call for each key costs more than
    its uploads do. For each key it holds uploads made so far, the limit last seen, and the
    waiting uploads with those decided during the last ``late`` seconds, by which
    an upload that is sent anew is known. The last of these leave by a timer too.
    """

    def __init__(self, late_seconds: int, warn_below: int):
        self.late, self.warn_below = late_seconds * 1_000_000, warn_below

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("uploads", "keys string")

    def _read(self) -> dict[str, list]:
        """For each key: uploads made, limit, and time and whether it is decided of each upload."""
        return json.loads(self.held.get()[0]) if self.held.exists() else {}

    def _write(self, keys: dict[str, list]) -> None:
        self.held.update((json.dumps(keys),))

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        keys = self._read()
        for batch in rows:
            for name, event, micros, given in zip(batch["key"], batch["event_id"], batch["micros"].tolist(), batch["upload_limit"].tolist()):
                own = keys.setdefault(name, [0, 0, {}])
                own[1] = given
                known = own[2].get(event)
                if known is None or (not known[1] and micros < known[0]):
                    own[2][event] = [micros, False]
        self._write(keys)
        if waiting := [t for _, _, events in keys.values() for t, done in events.values() if not done]:
            self._wake(min(waiting))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        keys = self._read()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        out, waiting, left_over = [], [], []
        for name, own in keys.items():
            used, limit, events = own
            for micros, event in sorted((t, e) for e, (t, done) in events.items() if not done and t <= passed):
                left = limit - used
                out.append((name, event, micros, "blocked" if left <= 0 else "warned" if left <= self.warn_below else "allowed", max(left - 1, 0), left == 1))
                used += 1
                events[event][1] = True
            own[0], own[2] = used, {e: x for e, x in events.items() if not x[1] or x[0] > passed - self.late}
            for t, done in own[2].values():
                (left_over if done else waiting).append(t)
        self._write(keys)
        if waiting:
            self._wake(min(waiting))
        elif left_over:
            self._wake(min(left_over) + self.late)
        made = pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])
        made["ts"] = pd.to_datetime(made["ts"], unit="us")
        yield made
