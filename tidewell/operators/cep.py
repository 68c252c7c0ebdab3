"""Complex event patterns over a key's events in arrival order.

A pattern is a list of steps: a condition (a Column), how it follows the step before, and how
often it occurs. Patterns of one or two plain steps are compiled to window functions; all
others run as a state machine over each key's sorted events, on condition bits computed
before, so no user code runs in Python.

Rules of a match, for each event: partial matches older than the limit are dropped; a
partial takes the event at the first step, from its own on, whose condition holds, where only
steps that may be absent are skipped; taking it forks a partial that stays at the step, while it may
occur again, and one that goes on, once it occurred often enough; a partial that doesn't take
it stays unless the step must follow at once; at a step any later event may answer, the
partial stays as well. An event starts a new match only if no partial took it. A
pattern ends when its last step is passed, so absent last steps never end one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRICT, RELAXED, ANY = "strict", "relaxed", "any"
UNBOUNDED = 2**31 - 1
MATCHES = "match_id long, start_ms long, end_ms long, duration_ms long, seqs array<long>, steps array<int>"


@dataclass(frozen=True)
class Step:
    name: str
    condition: Column
    follows: str = RELAXED
    least: int = 1
    most: int = 1


class Pattern:
    """``Pattern.begin("a", cond).followed_by("b", cond).times(2).within(1000)``"""

    def __init__(self, steps: tuple[Step, ...] = (), within_ms: int | None = None):
        self.steps, self.within_ms = steps, within_ms

    @classmethod
    def begin(cls, name: str, condition: Column) -> Pattern:
        return cls((Step(name, condition),))

    def _then(self, name: str, condition: Column, follows: str) -> Pattern:
        return Pattern((*self.steps, Step(name, condition, follows)), self.within_ms)

    def next(self, name: str, condition: Column) -> Pattern:
        return self._then(name, condition, STRICT)

    def followed_by(self, name: str, condition: Column) -> Pattern:
        return self._then(name, condition, RELAXED)

    def followed_by_any(self, name: str, condition: Column) -> Pattern:
        return self._then(name, condition, ANY)

    def times(self, least: int, most: int | None = None) -> Pattern:
        most = least if most is None else most
        if least < 0 or most < max(1, least):
            raise ValueError("a step occurs at least 0 and at most a positive number of times")
        return Pattern((*self.steps[:-1], replace(self.steps[-1], least=least, most=most)), self.within_ms)

    def one_or_more(self) -> Pattern:
        return self.times(1, UNBOUNDED)

    def zero_or_more(self) -> Pattern:
        return self.times(0, UNBOUNDED)

    def optional(self) -> Pattern:
        return self.times(0, 1)

    def at_least(self, n: int) -> Pattern:
        return self.times(n, UNBOUNDED)

    def within(self, ms: int) -> Pattern:
        return Pattern(self.steps, ms)


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def single_events(df: DataFrame, condition: Column) -> DataFrame:
    """The plain matcher: each event that fits is a match of its own."""
    return df.where(condition)


class Machine:
    """One key's partial matches. ``feed`` gives the matches an event completes, as lists of (seq, ms, step)."""

    def __init__(self, steps: list[tuple[str, int, int]], within_ms: int | None, most_partials: int | None = None):
        self.steps, self.within, self.most = steps, within_ms, most_partials
        self.partials: list[tuple[int, int, tuple]] = []  # step, taken at it, events

    def _take(self, step: int, count: int, bits: int) -> tuple[int, int] | None:
        while step < len(self.steps):
            if bits >> step & 1 and count + 1 <= self.steps[step][2]:
                return step, count
            if count or self.steps[step][1] > 0:
                return None
            step += 1
        return None

    def _advance(self, step: int, count: int, events: tuple, done: list, kept: list) -> None:
        _, least, most = self.steps[step]
        if count < most:
            kept.append((step, count, events))
        if count >= least:
            if step + 1 == len(self.steps):
                done.append(events)
            else:
                kept.append((step + 1, 0, events))

    def feed(self, seq: int, ms: int, bits: int) -> list[tuple]:
        done, kept, taken = [], [], False
        for step, count, events in self.partials:
            if self.within is not None and ms - events[0][1] > self.within:
                continue
            found = self._take(step, count, bits)
            if found:
                taken = True
                self._advance(found[0], found[1] + 1, (*events, (seq, ms, found[0])), done, kept)
                if self.steps[step][0] == ANY:
                    kept.append((step, count, events))
            elif self.steps[step][0] != STRICT:
                kept.append((step, count, events))
        if not taken:
            found = self._take(0, 0, bits)
            if found:
                self._advance(found[0], 1, ((seq, ms, found[0]),), done, kept)
        if self.most is not None and len(kept) > self.most:
            raise RuntimeError(f"more than {self.most} partial matches of one key: give the pattern a time limit")
        self.partials = kept
        return done


def detect(df: DataFrame, key: str, pattern: Pattern, seq: str = "seq", ms: str = "ms", most_partials: int | None = 1_000_000) -> DataFrame:
    """All complete matches by key: key, match_id (from 0), start, end, duration, seqs and step number of each event.

    Keys are dealt and sorted; a task streams over them, so one key's events are never held as a whole.
    """
    bits = F.lit(0)
    for k, step in enumerate(pattern.steps):
        bits = bits + F.when(step.condition, F.lit(1 << k)).otherwise(F.lit(0))
    steps = [(s.follows, s.least, s.most) for s in pattern.steps]
    within_ms, kind = pattern.within_ms, dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, machine, n = None, None, 0
        for frame in frames:
            rows = []
            for own, s, at, b in frame.itertuples(index=False, name=None):
                if machine is None or own != now:
                    now, machine, n = own, Machine(steps, within_ms, most_partials), 0
                for events in machine.feed(s, at, b):
                    rows.append((own, n, events[0][1], events[-1][1], events[-1][1] - events[0][1], [e[0] for e in events], [e[2] for e in events]))
                    n += 1
            yield pd.DataFrame(rows, columns=[key, "match_id", "start_ms", "end_ms", "duration_ms", "seqs", "steps"])

    dealt = df.select(key, F.col(seq).alias("s"), F.col(ms).alias("m"), bits.cast("long").alias("b")).repartition(key).sortWithinPartitions(key, "s")
    return dealt.mapInPandas(run, f"{key} {kind}, {MATCHES}")


# Closed forms: the same matches by window functions, for patterns of plain steps whose conditions exclude each other.

def _by(key: str, seq: str):
    return Window.partitionBy(key).orderBy(seq)


def matched_next(df: DataFrame, key: str, a: Column, b: Column, seq: str = "seq", ms: str = "ms") -> DataFrame:
    """``a`` whose next event is ``b``."""
    by = _by(key, seq)
    out = df.select(key, F.col(seq).alias("a_seq"), F.col(ms).alias("a_ms"), a.alias("__a"), F.lead(b).over(by).alias("__b"), F.lead(seq).over(by).alias("b_seq"), F.lead(ms).over(by).alias("b_ms"))
    return out.where("__a and __b").drop("__a", "__b")


def matched_followed_by(df: DataFrame, key: str, a: Column, b: Column, within_ms: int | None = None, seq: str = "seq", ms: str = "ms") -> DataFrame:
    """Each ``a`` with the first later ``b``."""
    ahead = _by(key, seq).rowsBetween(1, Window.unboundedFollowing)
    out = df.select(key, F.col(seq).alias("a_seq"), F.col(ms).alias("a_ms"), a.alias("__a"), F.min(F.when(b, F.struct(F.col(seq).alias("s"), F.col(ms).alias("m")))).over(ahead).alias("__b"))
    out = out.where("__a and __b is not null").select(key, "a_seq", "a_ms", F.col("__b.s").alias("b_seq"), F.col("__b.m").alias("b_ms"))
    return out if within_ms is None else out.where(F.col("b_ms") - F.col("a_ms") <= within_ms)


def matched_followed_by_any(df: DataFrame, key: str, a: Column, b: Column, within_ms: int, seq: str = "seq", ms: str = "ms") -> DataFrame:
    """Each ``a`` with every later ``b`` inside the limit; time buckets keep a hot key's events from meeting each other all."""
    x = df.where(a).select(key, F.col(seq).alias("a_seq"), F.col(ms).alias("a_ms"), F.explode(F.array(F.floor(F.col(ms) / within_ms), F.floor(F.col(ms) / within_ms) + 1)).alias("__t"))
    y = df.where(b).select(key, F.col(seq).alias("b_seq"), F.col(ms).alias("b_ms"), F.floor(F.col(ms) / within_ms).alias("__t"))
    return x.join(y, [key, "__t"]).where((F.col("b_seq") > F.col("a_seq")) & (F.col("b_ms") - F.col("a_ms") <= within_ms)).drop("__t")


def matched_repeats(df: DataFrame, key: str, a: Column, least: int, most: int | None = None, seq: str = "seq", ms: str = "ms") -> DataFrame:
    """One step taken ``least`` to ``most`` times (``most=None``: no end): key, first and last event and how many."""
    own = df.where(a)
    by = _by(key, seq)
    numbered = own.select(key, F.col(seq).alias("last_seq"), F.row_number().over(by).alias("__i"))
    if most is None:  # one match that grows
        first = F.min("last_seq").over(Window.partitionBy(key))
        return numbered.select(key, first.alias("first_seq"), "last_seq", F.col("__i").cast("long").alias("n")).where(F.col("n") >= least)
    grouped = numbered.withColumn("__g", F.floor((F.col("__i") - 1) / most)).withColumn("n", (F.col("__i") - F.col("__g") * most).cast("long"))
    first = F.min("last_seq").over(Window.partitionBy(key, "__g"))
    return grouped.select(key, first.alias("first_seq"), "last_seq", "n").where(F.col("n") >= least)
