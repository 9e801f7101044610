"""The sliding-window limiter with a timer for each key: what a key's state holds goes as soon as its window has passed.

State is a key's admitted hits within the window, so it is bounded by the keys that are live, however many have been seen. A timer
stands at the end of the window of a key's last admitted hit, in event time; when the watermark reaches it, the hits that are too
old go, and with the last of them the key. Rows behind the watermark are late: they are dropped by the engine and leave no trace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.streaming.limits import admit

#: What a session needs for streams with timers.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Limiter(StatefulProcessor):
    """Admits fewer than limit hits in the seconds before each."""

    def __init__(self, key: str, hit: str, limit: int, seconds: float) -> None:
        self.key, self.hit, self.limit, self.seconds = key, hit, limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "hits array<double>, timer long")

    def _held(self) -> tuple[list[float], int | None]:
        got = self.kept.get()  # None where there is none
        return (list(got[0]), got[1]) if got else ([], None)

    def _hold(self, hits: list[float], timer: int | None, watermark: int) -> None:
        """Keep hits, with one timer at the end of the oldest one's window. Each call of the store waits for an answer, so none is made for nothing."""
        due = max(int((hits[0] + self.seconds) * 1000) + 1, watermark + 1) if hits else None
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if hits:
            self.kept.update((hits, due))
        else:
            self.kept.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        parts = [(p["ts"].to_numpy("datetime64[us]"), p[self.key].array, p[self.hit].array) for p in rows]  # a key's rows of one batch
        at = np.concatenate([t for t, *_ in parts])
        keys, own = (pd.concat([pd.Series(p[i]) for p in parts], ignore_index=True) if len(parts) > 1 else pd.Series(parts[0][i]) for i in (1, 2))
        order = np.lexsort((own.argsort().argsort().to_numpy() if own.dtype == object else own.to_numpy(), at))
        order = order[~np.isnat(at[order])]
        if not len(order):
            return
        hits, timer = self._held()
        allowed, hits = admit((at[order].astype(np.int64) / 1e6).tolist(), hits, self.limit, self.seconds)
        self._hold(hits, timer, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({self.key: keys.array[order], self.hit: own.array[order], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        hits, timer = self._held()
        now = timerValues.getCurrentWatermarkInMs()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        self._hold([h for h in hits if (h + self.seconds) * 1000 > now], None if timer == fired else timer, now)
        return iter(())

    def close(self) -> None:
        pass


def limited(stream: DataFrame, key: str, hit: str, limit: int, seconds: float) -> DataFrame:
    """(key, hit, allowed) for every hit of a stream with a watermark on ts, in the order in which batches bring them. Null times are never looked at."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    rows = stream.select(key, hit, "ts").groupBy(key)
    return rows.transformWithStateInPandas(Limiter(key, hit, limit, seconds), f"`{key}` {kinds[key]}, `{hit}` {kinds[hit]}, allowed boolean", "Append", "EventTime")
