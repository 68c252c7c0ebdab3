"""De-duplication, rate limits, retry schedules, failure routing and dead letters."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# De-duplication

def first_of_each(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The earliest row of each key; rows with a null key are never duplicates. Pre-aggregated, not ranked."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    values = [c for c in df.columns if c not in keys]
    kept = df.where(~missing).groupBy(*keys).agg(F.min_by(F.struct(*values), seq).alias("__v")).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in values])
    return kept.select(df.columns).unionByName(df.where(missing))


def duplicates_marked(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(seq)
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.withColumn("duplicate", ~missing & (F.row_number().over(by) > 1))


def first_after_idle(df: DataFrame, key: str, gap_ms: int, seq: str = "seq", ms: str = "ms") -> DataFrame:
    """The earliest row of each key in each busy period of the whole stream, which ends when nothing came for ``gap_ms``.

    Periods are those of all keys together. They are found on distinct times, dealt by coarse time slots:
    only the first and last time of each slot meet in one window.
    """
    slot = F.floor(F.col(ms) / (gap_ms * 1024))
    times = df.select(ms, slot.alias("__slot")).distinct()
    inside = Window.partitionBy("__slot").orderBy(ms)
    marked = times.withColumn("__gap", F.col(ms) - F.lag(ms).over(inside))
    slots = marked.groupBy("__slot").agg(F.min(ms).alias("lo"), F.max(ms).alias("hi"), F.count(F.when(F.col("__gap") >= gap_ms, 1)).alias("breaks"))
    every = Window.orderBy("__slot")  # a row for each slot of 1024 gaps
    carried = slots.withColumn("__own", F.when(F.col("lo") - F.lag("hi").over(every) >= gap_ms, 1).otherwise(0)).withColumn(
        "__before", F.sum(F.col("__own") + F.col("breaks")).over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("breaks")
    ).select("__slot", "__before")
    period = marked.withColumn("__in", F.sum(F.when(F.col("__gap") >= gap_ms, 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = period.join(carried, "__slot").select(ms, (F.col("__before") + F.col("__in")).alias("period"))
    return first_of_each(df.join(numbered, ms), [key, "period"], seq)


def first_within_horizon(df: DataFrame, key: str, horizon_ms: int, seq: str = "seq", ms: str = "ms") -> DataFrame:
    """Rows of a key that come at least the horizon after the one before."""
    by = Window.partitionBy(key).orderBy(seq)
    last = F.lag(ms).over(by)
    return df.withColumn("__last", last).where(F.col("__last").isNull() | (F.col(ms) - F.col("__last") >= horizon_ms)).drop("__last")


# Rate limits

class SlidingLimit:
    """At most ``limit`` allowed hits in any ``window_ms``; denied hits don't count."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window, self.hits = limit, window_ms, deque()

    def allow(self, now: int) -> bool:
        while self.hits and self.hits[0] <= now - self.window:
            self.hits.popleft()
        if len(self.hits) >= self.limit:
            return False
        self.hits.append(now)
        return True


class TokenBucket:
    """Starts full, refills by time, a hit takes one token."""

    def __init__(self, capacity: float, per_second: float):
        self.capacity, self.rate, self.tokens, self.at = capacity, per_second / 1000, capacity, None

    def allow(self, now: int) -> bool:
        if self.at is not None and now > self.at:
            self.tokens = min(self.capacity, self.tokens + (now - self.at) * self.rate)
        self.at = now if self.at is None else max(self.at, now)
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


class LeakyBucket:
    """Water runs out by time; a hit adds one if there is room."""

    def __init__(self, capacity: float, per_second: float):
        self.capacity, self.rate, self.water, self.at = capacity, per_second / 1000, 0.0, None

    def allow(self, now: int) -> bool:
        if self.at is not None and now > self.at:
            self.water = max(0.0, self.water - (now - self.at) * self.rate)
        self.at = now if self.at is None else max(self.at, now)
        if self.water + 1 > self.capacity:
            return False
        self.water += 1
        return True


LIMITS: dict[str, Callable[..., object]] = {"sliding": SlidingLimit, "token": TokenBucket, "leaky": LeakyBucket}


def rate_limited(df: DataFrame, key: str, make: Callable[[], object], seq: str = "seq", ms: str = "ms", name: str = "allowed") -> DataFrame:
    """A verdict for each hit of a key, in arrival order. A limit is a recurrence, so each key is streamed in its order."""
    kind = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, limit = None, None
        for frame in frames:
            verdicts = []
            for own, at in zip(frame[key], frame[ms], strict=True):
                if limit is None or own != now:
                    now, limit = own, make()
                verdicts.append(limit.allow(int(at)))
            yield frame.assign(**{name: verdicts})

    dealt = df.select(key, seq, ms).repartition(key).sortWithinPartitions(key, seq)
    return dealt.mapInPandas(run, f"{key} {kind[key]}, {seq} {kind[seq]}, {ms} {kind[ms]}, {name} boolean")


def limit_sink(df: DataFrame, verdict: str = "allowed", on_deny: str = "drop") -> DataFrame:
    """Drop denied rows, or fail on the first."""
    if on_deny == "drop":
        return df.where(verdict)
    return df.withColumn(verdict, F.when(F.col(verdict), F.lit(True)).otherwise(F.raise_error(F.lit("rate limit exceeded")).cast("boolean")))


# Retry and dead letters

@dataclass(frozen=True)
class RetryPolicy:
    """Retries after the first try, with growing delays; ``never`` wins over ``only``."""

    most_attempts: int = 3
    initial_ms: int = 100
    multiplier: float = 2.0
    max_ms: int = 10_000
    only: tuple[type[BaseException], ...] = (Exception,)
    never: tuple[type[BaseException], ...] = ()

    def delay_ms(self, attempt: int) -> int:
        return int(min(self.max_ms, self.initial_ms * self.multiplier ** (attempt - 1)))

    def retries(self, error: BaseException) -> bool:
        return isinstance(error, self.only) and not isinstance(error, self.never)

    def run(self, work: Callable[[], object], sleep: Callable[[float], None] = time.sleep) -> object:
        """For work inside ``foreachBatch``: try, wait, try again."""
        attempt = 0
        while True:
            try:
                return work()
            except BaseException as e:
                cause = e.__cause__ if isinstance(e, RuntimeError) and e.__cause__ is not None else e
                attempt += 1
                if attempt > self.most_attempts or not self.retries(cause):
                    raise
                sleep(self.delay_ms(attempt) / 1000)


FAIL_FAST, RETRY, SKIP, DEAD_LETTER, IGNORE = "FAIL_FAST", "RETRY", "SKIP", "DEAD_LETTER_QUEUE", "IGNORE"


@dataclass
class Split:
    good: DataFrame
    dead: DataFrame
    strategy: str = field(default=DEAD_LETTER)


def split_failures(df: DataFrame, ok: Column, error: Column, strategy: str = DEAD_LETTER) -> Split:
    """Good rows and dead letters (with ``error``), or the strategy's other answer to bad rows."""
    flagged = df.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    if strategy == FAIL_FAST:
        good = flagged.where(F.when(F.col("__ok"), F.lit(True)).otherwise(F.raise_error(error).cast("boolean"))).drop("__ok")
        return Split(good, df.limit(0).withColumn("error", error), strategy)
    if strategy == IGNORE:
        return Split(df, df.limit(0).withColumn("error", error), strategy)
    if strategy not in (SKIP, DEAD_LETTER, RETRY):
        raise ValueError(f"unknown strategy: {strategy}")
    dead = flagged.where("not __ok").drop("__ok").withColumn("error", F.coalesce(F.when(F.trim(error) != "", error), F.lit("Unknown error")))
    return Split(flagged.where("__ok").drop("__ok"), dead if strategy != SKIP else dead.limit(0), strategy)


def routed_results(df: DataFrame, result: str, attempt: str, most_attempts: int, now_ms: Column, base_ms: int = 1000, cap_ms: int = 60_000) -> DataFrame:
    """Where each handled message goes: ``ack``, ``retry`` with ``due_ms``, or ``dlq``."""
    r, n = F.col(result), F.col(attempt)
    to = F.when(r == "SUCCESS", "ack").when((r == "RETRY") & (n < most_attempts), "retry").otherwise("dlq")
    delay = F.least(F.lit(cap_ms), F.floor(base_ms * F.pow(F.lit(2.0), n))).cast("bigint")
    return df.withColumn("to", to).withColumn("due_ms", F.when(F.col("to") == "retry", now_ms + delay))


def due(df: DataFrame, now_ms: int, most: int = 100) -> DataFrame:
    """Retries that are due, the longest due first, at most ``most`` a round (the mover's batch)."""
    return df.where(F.col("due_ms") <= now_ms).orderBy("due_ms").limit(most)


def replayed(dead: DataFrame, columns: list[str]) -> DataFrame:
    """Dead letters as messages again, with their attempts at 0."""
    return dead.select(*columns).withColumn("retry_count", F.lit(0))
