"""Upsert tables: the latest value of each key; a null value deletes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UpsertTable:
    """A table of ``key`` and value columns, one row a key. Operations are lazy and return new tables."""

    def __init__(self, rows: DataFrame, key: str):
        self.rows, self.key = rows, key

    @classmethod
    def from_stream(cls, changes: DataFrame, key: str, seq: str, deleted: Column | None = None) -> UpsertTable:
        """Latest change of each key by ``seq``; keys whose latest change is a deletion are gone. Pre-aggregated before the shuffle."""
        values = [c for c in changes.columns if c != key]
        mark = changes.withColumn("__deleted", F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False))
        last = mark.groupBy(key).agg(F.max_by(F.struct(*values, "__deleted"), F.col(seq)).alias("__v"))
        return cls(last.where(~F.col("__v.__deleted")).select(key, *[F.col(f"__v.{c}").alias(c) for c in values]), key)

    def map_values(self, **columns: Column) -> UpsertTable:
        """New value columns; a row all of whose new values are null is deleted."""
        new = self.rows.select(self.key, *[c.alias(n) for n, c in columns.items()])
        return UpsertTable(new.dropna("all", subset=list(columns)), self.key)

    def filter(self, condition: Column) -> UpsertTable:
        return UpsertTable(self.rows.where(condition), self.key)

    def join(self, other: UpsertTable) -> DataFrame:
        return self.rows.join(other.rows.withColumnRenamed(other.key, self.key), self.key, "inner")

    def left_join(self, other: UpsertTable) -> DataFrame:
        return self.rows.join(other.rows.withColumnRenamed(other.key, self.key), self.key, "left")

    def group_by(self, *keys: str | Column) -> GroupedTable:
        return GroupedTable(self.rows, keys)

    def to_stream(self) -> DataFrame:
        return self.rows


class GroupedTable:
    def __init__(self, rows: DataFrame, keys: tuple):
        self.rows, self.keys = rows, keys

    def count(self, name: str = "n") -> DataFrame:
        return self.rows.groupBy(*self.keys).agg(F.count("*").alias(name))

    def reduce(self, value: Column, adder: Callable[[Column], Column], name: str) -> DataFrame:
        """Fold of the group's values by an aggregate such as ``F.sum``."""
        return self.rows.groupBy(*self.keys).agg(adder(value).alias(name))

    def aggregate(self, **aggregates: Column) -> DataFrame:
        return self.rows.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggregates.items()])
