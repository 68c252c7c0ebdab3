"""The fluent surface: Stream, Keyed, Windowed over DataFrames with arrival order and event time.

    Stream(events).filter(F.col("value") > 0).key_by("user_id").window(tumbling_ms(3_600_000)).count()
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import aggregates, windows

Assigner = Callable[[DataFrame], DataFrame]


def tumbling_ms(size: int) -> Assigner:
    return lambda df: windows.tumbling(df, size)


def sliding_ms(size: int, slide: int) -> Assigner:
    return lambda df: windows.sliding(df, size, slide)


@dataclass(frozen=True)
class Stream:
    """Rows with ``seq`` (arrival) and ``ms`` (event time); both are kept by every operation."""

    df: DataFrame

    def map(self, **columns: Column) -> Stream:
        return Stream(self.df.select("seq", "ms", *[c.alias(n) for n, c in columns.items()]))

    def filter(self, condition: Column) -> Stream:
        return Stream(self.df.where(condition))

    def flat_map(self, items: Column, name: str) -> Stream:
        """One row for each item of an array; a null array has none."""
        return Stream(self.df.select("*", F.explode(items).alias(name)))

    def assign_timestamps(self, ms: Column) -> Stream:
        return Stream(self.df.withColumn("ms", ms))

    def union(self, *others: Stream) -> Stream:
        out = self.df
        for o in others:
            out = out.unionByName(o.df)
        return Stream(out)

    def key_by(self, *keys: str) -> Keyed:
        return Keyed(self.df, list(keys))

    def add_sink(self, write: Callable[[DataFrame], None]) -> None:
        write(self.df)


@dataclass(frozen=True)
class Keyed:
    df: DataFrame
    keys: list[str]

    def map(self, **columns: Column) -> Keyed:
        return Keyed(self.df.select("seq", "ms", *self.keys, *[c.alias(n) for n, c in columns.items()]), self.keys)

    def reduce(self, value: Column, how: str, name: str = "acc") -> Stream:
        """The fold so far at each row."""
        return Stream(aggregates.running(self.df, self.keys, value, name, how))

    def sum(self, value: str, name: str = "sum") -> Stream:
        return Stream(aggregates.running(self.df, self.keys, F.col(value), name, "sum"))

    def window(self, assign: Assigner) -> Windowed:
        return Windowed(assign(self.df), self.keys)

    def count_window(self, n: int) -> Windowed:
        numbered = windows.count_windows(self.df, self.keys, n)
        return Windowed(numbered.withColumn("w_start", F.col("w_index") * n).withColumn("w_end", F.col("w_start") + n), self.keys)

    def session(self, gap_ms: int, **options) -> Windowed:
        return Windowed(windows.sessions(self.df, self.keys, gap_ms, **options), self.keys)


@dataclass(frozen=True)
class Windowed:
    df: DataFrame
    keys: list[str]

    def aggregate(self, **columns: Column) -> DataFrame:
        return self.df.groupBy(*self.keys, "w_start", "w_end").agg(*[c.alias(n) for n, c in columns.items()])

    def reduce(self, value: Column, fold: Callable[[Column], Column], name: str = "value") -> DataFrame:
        return self.aggregate(**{name: fold(value)})

    def count(self) -> DataFrame:
        return self.aggregate(n=F.count("*"))

    def sum(self, value: str) -> DataFrame:
        """Exact sum of a pane, from 0."""
        return self.aggregate(sum=aggregates.exact_sum(F.col(value)))

    def apply(self, value: str, f: Callable[[Column], Column], name: str = "out") -> DataFrame:
        """A function of the pane's values in arrival order; an array result gives one row an item."""
        panes = aggregates.window_elements(self.df, [*self.keys, "w_start", "w_end"], value)
        return panes.select(*self.keys, "w_start", "w_end", F.explode(f(F.col("elements"))).alias(name))
