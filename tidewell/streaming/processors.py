"""Stateful operators on keyed streams: running folds, timers, rate limits, eager joins, patterns.

All are ``transformWithStateInPandas`` processors with state in the state store. Inside a
key's micro-batch rows are taken in arrival order; across batches the order is the source's.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.operators.cep import Machine
from tidewell.operators.joins import JoinWindow


def _rows(frames: Iterator[pd.DataFrame], seq: str) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(seq, kind="stable")


class RunningReduce(StatefulProcessor):
    """The fold so far after each row: ``step(acc, value)``, started by the first value."""

    def __init__(self, key: str, seq: str, value: str, step: Callable[[float, float], float]):
        self.key, self.seq, self.value, self.step = key, seq, value, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.acc = handle.getValueState("acc", "acc double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        acc = self.acc.get()[0] if self.acc.exists() else None
        out = []
        for seq, v in _rows(rows, self.seq)[[self.seq, self.value]].itertuples(index=False, name=None):
            acc = v if acc is None else self.step(acc, v)
            out.append((key[0], seq, acc))
        self.acc.update((float(acc),))
        yield pd.DataFrame(out, columns=[self.key, self.seq, "acc"])

    def close(self) -> None:
        pass


def running_reduce(df: DataFrame, key: str, seq: str, value: str, step: Callable[[float, float], float]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.groupBy(key).transformWithStateInPandas(RunningReduce(key, seq, value, step), f"{key} {kinds[key]}, {seq} {kinds[seq]}, acc double", "Append", "None")


class Process(StatefulProcessor):
    """User code by key: ``on_row(context, row)`` and ``on_timer(context, ms)`` give output rows.

    The context holds a JSON state ``context.state``, the watermark ``context.watermark_ms``, and
    ``set_timer(ms)``/``delete_timer(ms)``; timers are one a time, fire between batches and are persisted.
    """

    class Context:
        def __init__(self, handle: StatefulProcessorHandle, state: Any, watermark_ms: int):
            self._handle, self.state, self.watermark_ms = handle, state, watermark_ms

        def set_timer(self, ms: int) -> None:
            self._handle.registerTimer(int(ms))

        def delete_timer(self, ms: int) -> None:
            self._handle.deleteTimer(int(ms))

        def timers(self) -> list[int]:
            return [t[0] for t in self._handle.listTimers()]

    def __init__(self, seq: str, columns: list[str], on_row: Callable, on_timer: Callable | None = None):
        self.seq, self.columns, self.on_row, self.on_timer = seq, columns, on_row, on_timer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "json string")

    def _context(self, timerValues) -> Process.Context:
        held = json.loads(self.state.get()[0]) if self.state.exists() else None
        return self.Context(self.handle, held, timerValues.getCurrentWatermarkInMs())

    def _done(self, context: Process.Context, out: list) -> pd.DataFrame:
        if context.state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(context.state),))
        return pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        context, out = self._context(timerValues), []
        for row in _rows(rows, self.seq).to_dict("records"):
            out += list(self.on_row(context, row))
        yield self._done(context, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        context = self._context(timerValues)
        out = list(self.on_timer(context, expiredTimerInfo.getExpiryTimeInMs())) if self.on_timer else []
        yield self._done(context, out)

    def close(self) -> None:
        pass


def process(df: DataFrame, key: str, seq: str, schema: str, on_row: Callable, on_timer: Callable | None = None, time_mode: str = "EventTime") -> DataFrame:
    columns = [c.split()[0] for c in schema.split(",")]
    return df.groupBy(key).transformWithStateInPandas(Process(seq, columns, on_row, on_timer), schema, "Append", time_mode)


class RateLimit(StatefulProcessor):
    """A verdict for each hit; the limiter's numbers are the state."""

    def __init__(self, key: str, seq: str, ms: str, make: Callable[[], Any]):
        self.key, self.seq, self.ms, self.make = key, seq, ms, make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("limit", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        limit = self.make()
        if self.held.exists():
            for name, value in json.loads(self.held.get()[0]).items():
                old = getattr(limit, name)
                setattr(limit, name, type(old)(value) if isinstance(value, list) else value)
        out = [(key[0], s, limit.allow(int(m))) for s, m in _rows(rows, self.seq)[[self.seq, self.ms]].itertuples(index=False, name=None)]
        self.held.update((json.dumps({n: list(v) if hasattr(v, "popleft") else v for n, v in vars(limit).items()}),))
        yield pd.DataFrame(out, columns=[self.key, self.seq, "allowed"])

    def close(self) -> None:
        pass


def rate_limited(df: DataFrame, key: str, seq: str, ms: str, make: Callable[[], Any]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.groupBy(key).transformWithStateInPandas(RateLimit(key, seq, ms, make), f"{key} {kinds[key]}, {seq} {kinds[seq]}, allowed boolean", "Append", "None")


class EagerJoin(StatefulProcessor):
    """Both sides as one stream with ``side`` (l, r): pairs inside the window, and at once a row alone if nothing held fits it.

    Rows are held until the key's newest time is more than the retention ahead.
    """

    def __init__(self, key: str, window: JoinWindow, how: str, retention_ms: int):
        self.key, self.window, self.how, self.retention = key, window, how, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "side string, seq bigint, ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        out = []
        for side, seq, ms in _rows(rows, "seq")[["side", "seq", "ms"]].itertuples(index=False, name=None):
            met = False
            for other, s, m in held:
                if other != side:
                    l, r = (ms, m) if side == "l" else (m, ms)
                    if -self.window.before_ms <= r - l <= self.window.after_ms:
                        met = True
                        out.append((key[0], seq, s) if side == "l" else (key[0], s, seq))
            if not met and (self.how == "full" or self.how == {"l": "left", "r": "right"}[side]):
                out.append((key[0], seq, None) if side == "l" else (key[0], None, seq))
            held.append((side, int(seq), int(ms)))
            newest = max(h[2] for h in held)
            held = [h for h in held if newest - h[2] <= self.retention]
        self.held.put(held)
        frame = pd.DataFrame(out, columns=[self.key, "l_seq", "r_seq"])
        yield frame.astype({"l_seq": "Int64", "r_seq": "Int64"})

    def close(self) -> None:
        pass


def eager_join(both: DataFrame, key: str, window: JoinWindow, how: str = "left", retention_ms: int = 3_600_000) -> DataFrame:
    """``both``: key, side, seq, ms of the two streams in one."""
    kind = dict(both.dtypes)[key]
    return both.groupBy(key).transformWithStateInPandas(EagerJoin(key, window, how, retention_ms), f"{key} {kind}, l_seq bigint, r_seq bigint", "Append", "None")


class Patterns(StatefulProcessor):
    """The pattern machine by key; its partial matches are the state, and those past the limit are dropped with the next event."""

    def __init__(self, key: str, steps: list[tuple[str, int, int]], within_ms: int | None, most_partials: int):
        self.key, self.steps, self.within, self.most = key, steps, within_ms, most_partials

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("partials", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine = Machine(self.steps, self.within, self.most)
        if self.held.exists():
            machine.partials = [(s, c, tuple(tuple(e) for e in events)) for s, c, events in json.loads(self.held.get()[0])]
        out = []
        for seq, ms, bits in _rows(rows, "seq")[["seq", "ms", "bits"]].itertuples(index=False, name=None):
            for events in machine.feed(int(seq), int(ms), int(bits)):
                out.append((key[0], events[0][1], events[-1][1], [e[0] for e in events], [e[2] for e in events]))
        self.held.update((json.dumps(machine.partials),))
        yield pd.DataFrame(out, columns=[self.key, "start_ms", "end_ms", "seqs", "steps"])

    def close(self) -> None:
        pass


def detect(df: DataFrame, key: str, pattern, seq: str = "seq", ms: str = "ms", most_partials: int = 100_000) -> DataFrame:
    from pyspark.sql import functions as F

    bits = F.lit(0)
    for k, step in enumerate(pattern.steps):
        bits = bits + F.when(step.condition, F.lit(1 << k)).otherwise(F.lit(0))
    kind = dict(df.dtypes)[key]
    own = df.select(key, F.col(seq).alias("seq"), F.col(ms).alias("ms"), bits.cast("long").alias("bits"))
    steps = [(s.follows, s.least, s.most) for s in pattern.steps]
    return own.groupBy(key).transformWithStateInPandas(Patterns(key, steps, pattern.within_ms, most_partials), f"{key} {kind}, start_ms bigint, end_ms bigint, seqs array<bigint>, steps array<int>", "Append", "None")
