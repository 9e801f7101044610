"""Stateful admission: a sliding-window log limiter and a circuit breaker, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(times: list[float], kept: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which of the ascending hits pass: fewer than limit in the window before; a rejected hit leaves no trace."""
    out = []
    for t in times:
        kept = [k for k in kept if t - k < seconds]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, kept


class Breaker:
    """Opens for ``pause`` seconds after ``most`` failures in a row; the time's end doesn't clear the count, a success does."""

    def __init__(self, most: int = 3, pause: float = 300, failures: int = 0, until: float = float("-inf")) -> None:
        self.most, self.pause, self.failures, self.until = most, pause, failures, until

    def allows(self, now: float) -> bool:
        return now >= self.until

    def record(self, ok: bool, now: float) -> None:
        self.failures = 0 if ok else self.failures + 1
        if self.failures >= self.most:
            self.until = now + self.pause

    def pass_through(self, calls: list[tuple[float, bool]]) -> list[bool]:
        """Which of the calls in order of time are made; those that aren't count neither way."""
        out = []
        for now, ok in calls:
            out.append(self.allows(now))
            if out[-1]:
                self.record(ok, now)
        return out


def _in_order(df: DataFrame, key: str, hit: str, result: str, step: Callable[[Any, pd.DataFrame], tuple[list, Any]]) -> DataFrame:
    """(key, hit, result): step(state, rows) over each key's rows in order of ts and hit. Rows are streamed, so a key's log is never held as a whole."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = (), None  # no key yet
        for pdf in pdfs:
            for own, rows in pdf.groupby(key, sort=False, dropna=False):
                own = None if pd.isna(own) else own
                if now != (own,):
                    now, state = (own,), None
                values, state = step(state, rows)
                yield rows.assign(**{result: values})[[key, hit, result]]

    rows = df.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).drop("ts")
    return rows.repartition(key).sortWithinPartitions(key, "at", hit).mapInPandas(run, f"`{key}` {kinds[key]}, `{hit}` {kinds[hit]}, {result} boolean")


def allowed_hits(df: DataFrame, key: str, hit: str, limit: int, seconds: float) -> DataFrame:
    """(key, hit, allowed) for every hit of a batch; needs a column ts. Null times are never allowed; null keys are one key."""

    def step(kept: list[float] | None, rows: pd.DataFrame) -> tuple[list[bool], list[float]]:
        real = rows["at"].notna()
        ok, kept = admit(rows.loc[real, "at"].tolist(), kept or [], limit, seconds)
        passed = iter(ok)
        return [next(passed) if r else False for r in real], kept

    return _in_order(df.select(key, hit, "ts"), key, hit, "allowed", step)


def made_calls(df: DataFrame, key: str, hit: str, ok: str, most: int = 3, pause: float = 300) -> DataFrame:
    """(key, hit, made) for every call of a batch: whether the key's breaker lets it through. Needs a column ts; null times are never made."""

    def step(state: Breaker | None, rows: pd.DataFrame) -> tuple[list[bool], Breaker]:
        state = state or Breaker(most, pause)
        real = rows["at"].notna()
        made = iter(state.pass_through(list(zip(rows.loc[real, "at"], rows.loc[real, "__ok"], strict=True))))
        return [next(made) if r else False for r in real], state

    return _in_order(df.select(key, hit, "ts", F.coalesce(F.col(ok), F.lit(False)).alias("__ok")), key, hit, "made", step)


def _stream(stream: DataFrame, key: str, hit: str, result: str, state_schema: str, idle: float, step: Callable[[tuple | None, pd.DataFrame], tuple[list[bool], tuple]]) -> DataFrame:
    """Event-time state a key, dropped once the watermark is ``idle`` seconds beyond the key's last row. The stream needs a watermark on ts."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs)).dropna(subset=["ts"]).sort_values(["ts", hit])  # a key's rows of one batch
        if rows.empty:
            return
        values, kept = step(state.get if state.exists else None, rows.assign(at=rows["ts"].map(lambda t: t.timestamp())))
        state.update(kept)
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000 + idle * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(**{result: values})[[key, hit, result]]

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{hit}` {kinds[hit]}, {result} boolean", state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def limited_stream(stream: DataFrame, key: str, hit: str, limit: int, seconds: float) -> DataFrame:
    """allowed_hits() over a stream with a watermark on ts; a key's log is dropped once the watermark has passed its window."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[list[bool], tuple]:
        ok, kept = admit(rows["at"].tolist(), list(state[0]) if state else [], limit, seconds)
        return ok, (kept,)

    return _stream(stream.select(key, hit, "ts"), key, hit, "allowed", "kept array<double>", seconds, step)


def breaker_stream(stream: DataFrame, key: str, hit: str, ok: str, most: int = 3, pause: float = 300, idle: float = 86_400) -> DataFrame:
    """made_calls() over a stream with a watermark on ts; a key that is idle for a day starts anew."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[list[bool], tuple]:
        b = Breaker(most, pause, *(state or ()))
        return b.pass_through(list(zip(rows["at"], rows["__ok"], strict=True))), (b.failures, b.until)

    return _stream(stream.select(key, hit, "ts", F.coalesce(F.col(ok), F.lit(False)).alias("__ok")), key, hit, "made", "failures int, until double", idle, step)


def dedupe_stream(stream: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """The first row of each key that comes within the lateness of another; a key's state goes when the watermark has passed it."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)
