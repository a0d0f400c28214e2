"""The least row of each key by an order, kept until the watermark makes it final."""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import datetime

from pyspark.sql import Row, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_MILLIS = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}


def interval_ms(text: str) -> int:
    """Milliseconds of an interval such as ``10 minutes`` or ``1 day 2 hours``."""
    parts = re.findall(r"(\d+)\s*([a-z]+?)s?\b", text.lower())
    if not parts or any(unit not in _MILLIS for _, unit in parts):
        raise ValueError(f"not an interval of weeks to milliseconds: {text!r}")
    return sum(int(n) * _MILLIS[unit] for n, unit in parts)


def _millis(ts) -> int:
    return int(ts.timestamp() * 1000)


class FirstSeen(StatefulProcessor):
    """One row of state per key: the least so far, and whether it has been put out."""

    def __init__(self, key: str, rest: T.StructType, order: Sequence[str], kept_ms: int):
        self.key, self.rest, self.order, self.kept_ms = key, rest, list(order), kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", T.StructType([*self.rest, T.StructField("__done", T.BooleanType())]))

    def _rank(self, row) -> tuple:
        values = [row[c] for c in self.order]
        # null last; times out of the state have a zone, those of rows have not
        return tuple((v is None, v.timestamp() if isinstance(v, datetime) else v) for v in values)

    def _due(self, best: dict) -> int:
        """When the timer of a row fires: it is final, or forgotten if it has been put out."""
        return _millis(best[self.order[0]]) + 1 + (self.kept_ms if best["__done"] else 0)

    def _read(self) -> dict | None:
        return dict(zip([*self.rest.names, "__done"], self.best.get())) if self.best.exists() else None

    def _expire(self, key, best: dict) -> tuple[list[Row], dict | None]:
        """What a row whose time is over puts out, and what is kept of it."""
        self.handle.deleteTimer(self._due(best))
        if best["__done"]:
            self.best.clear()
            return [], None
        out = Row(**dict(zip([self.key, *self.rest.names], (key[0], *[best[c] for c in self.rest.names]))))
        best["__done"] = True
        self._store(best)
        return [out], best

    def _store(self, best: dict) -> None:
        self.best.update(tuple(best[c] for c in [*self.rest.names, "__done"]))
        self.handle.registerTimer(self._due(best))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, out = self._read(), []
        # timers fire after the rows of a batch; what is over by now does not hide them
        while best is not None and self._due(best) <= timerValues.getCurrentWatermarkInMs():
            more, best = self._expire(key, best)
            out += more
        if best is not None and best["__done"]:
            return iter(out)
        old = best
        for row in rows:
            if row[self.order[0]] is not None and (best is None or self._rank(row) < self._rank(best)):
                best = {**{c: row[c] for c in self.rest.names}, "__done": False}
        if best is not old:
            if old is not None:
                self.handle.deleteTimer(self._due(old))
            self._store(best)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        best = self._read()
        return iter(()) if best is None else iter(self._expire(key, best)[0])

    def close(self) -> None:
        pass
