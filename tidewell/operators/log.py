"""Questions to a partitioned log: retention, frontiers, lag, ranges, pending records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, partition: str, order: str, n: int) -> DataFrame:
    """The newest n records of each partition; ranking stops at n in each task before the shuffle."""
    by = Window.partitionBy(partition).orderBy(F.desc(order))
    return log.withColumn("__i", F.row_number().over(by)).where(F.col("__i") <= n).drop("__i")


def younger_than(log: DataFrame, ms: str, now_ms: int, age_ms: int) -> DataFrame:
    return log.where(F.col(ms) >= now_ms - age_ms)


def beyond_frontier(log: DataFrame, commits: DataFrame, partition: str, order: str, committed: str = "committed") -> DataFrame:
    """What some group has yet to read: records after the smallest committed position of a partition, and all of a partition that no group has read from."""
    least = commits.groupBy(partition).agg(F.min(committed).alias("__least"))
    return log.join(least, partition, "left").where(F.col("__least").isNull() | (F.col(order) > F.col("__least"))).drop("__least")


def group_lag(log: DataFrame, commits: DataFrame, partition: str, order: str, group: str = "grp", committed: str = "committed") -> DataFrame:
    """By group: records it has yet to read, and how far the last record is ahead by position."""
    last = log.groupBy(partition).agg(F.max(order).alias("__last"))
    per = commits.join(last, partition).groupBy(group).agg(F.sum(F.greatest(F.col("__last") - F.col(committed), F.lit(0))).cast("bigint").alias("position_lag"))
    unread = commits.join(log.select(partition, order), partition).where(F.col(order) > F.col(committed)).groupBy(group).agg(F.count("*").alias("n"))
    return per.join(unread, group, "left").select(group, F.coalesce("n", F.lit(0).cast("bigint")).alias("lag"), "position_lag")


def range_scan(log: DataFrame, order: str, start: object, end: object, n: int, newest_first: bool = False) -> DataFrame:
    """A page of records with ``start <= position <= end``."""
    return log.where(F.col(order).between(start, end)).orderBy(F.desc(order) if newest_first else F.asc(order)).limit(n)


def pending(log: DataFrame, idle: str, least_idle_ms: int, order: str, n: int, descending: bool = True) -> DataFrame:
    """A page of delivered records that nobody has acknowledged for so long, sorted before it is cut."""
    return log.where(F.col(idle) >= least_idle_ms).orderBy(F.desc(order) if descending else F.asc(order)).limit(n)


def partition_share(log: DataFrame, partition: str, modulo: int, remainder: int) -> DataFrame:
    """The partitions that one of ``modulo`` subscribers reads."""
    return log.where(F.pmod(F.col(partition), F.lit(modulo)) == remainder % modulo)


def history(versions: DataFrame, key: list[str], order: str, n: int | None = None, since: object | None = None) -> DataFrame:
    """Newest first: ``version_rank`` from 1, at most n of a key, not older than ``since``."""
    by = Window.partitionBy(*key).orderBy(F.desc(order))
    out = (versions if since is None else versions.where(F.col(order) >= since)).withColumn("version_rank", F.row_number().over(by))
    return out if n is None else out.where(F.col("version_rank") <= n)


def validity(versions: DataFrame, key: list[str], order: str) -> DataFrame:
    """Versions with the position up to which they hold (null: still)."""
    return versions.withColumn("valid_to", F.lead(order).over(Window.partitionBy(*key).orderBy(order)))
