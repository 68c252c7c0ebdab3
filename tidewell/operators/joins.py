"""Keyed time-window joins, with outer rows decided eagerly or finally, and a bucketed range join for hot keys.

Both sides carry ``key``, arrival order ``seq`` and event time ``ms``; all their columns come
back prefixed ``l_`` and ``r_``. A side's rows are told apart by ``seq``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JoinWindow:
    """``-before <= candidate - reference <= after``, both ends included."""

    before_ms: int
    after_ms: int

    def __post_init__(self) -> None:
        if self.before_ms < 0 or self.after_ms < 0:
            raise ValueError("window bounds must not be negative")

    @classmethod
    def of_size(cls, ms: int) -> JoinWindow:
        return cls(ms, ms)

    @classmethod
    def after_only(cls, ms: int) -> JoinWindow:
        return cls(0, ms)

    @classmethod
    def before_only(cls, ms: int) -> JoinWindow:
        return cls(ms, 0)

    def contains(self, reference: Column, candidate: Column) -> Column:
        return (candidate - reference).between(-self.before_ms, self.after_ms)


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return left.select([F.col(c).alias(f"l_{c}") for c in left.columns]), right.select([F.col(c).alias(f"r_{c}") for c in right.columns])


def _pairs(left: DataFrame, right: DataFrame, window: JoinWindow, key: str, by_arrival: bool, retention_ms: int | None, buckets: bool) -> DataFrame:
    l, r = _sides(left, right)
    if by_arrival:  # later arrival minus earlier arrival
        later_r = F.col("r_seq") > F.col("l_seq")
        fits = F.when(later_r, window.contains(F.col("l_ms"), F.col("r_ms"))).otherwise(window.contains(F.col("r_ms"), F.col("l_ms")))
    else:
        fits = window.contains(F.col("l_ms"), F.col("r_ms"))
    on = [F.col(f"l_{key}") == F.col(f"r_{key}"), fits]
    if buckets:
        # A second equality on time buckets: a hot key's rows spread over its buckets and aren't all compared with each other.
        reach = max(window.before_ms, window.after_ms, 1)
        l = l.withColumn("__b", F.floor(F.col("l_ms") / reach))
        r = r.withColumn("__c", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("r_ms") / reach) + d)))
        on.append(F.col("__b") == F.col("__c"))
    pairs = l.join(r, on, "inner").drop("__b", "__c")
    if retention_ms is not None:
        newest = "__newest"
        pairs = pairs.where(F.greatest(F.col("l_ms"), F.col("r_ms")) >= 0)
        # when the later of the two came, the earlier one must still have been held
        pairs = pairs.withColumn(newest, F.when(F.col("l_seq") < F.col("r_seq"), F.col("r___top")).otherwise(F.col("l___top")))
        pairs = pairs.where(F.col(newest) - F.when(F.col("l_seq") < F.col("r_seq"), F.col("l_ms")).otherwise(F.col("r_ms")) <= retention_ms).drop(newest, "l___top", "r___top")
    return pairs


def _with_top(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Adds to each row the largest time of its key over both sides when it came, itself excluded."""
    both = left.select(key, "seq", "ms", F.lit(0).alias("__side")).unionByName(right.select(key, "seq", "ms", F.lit(1).alias("__side")))
    by = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    top = both.withColumn("__top", F.coalesce(F.max("ms").over(by), F.col("ms")))
    pick = lambda side, df: df.join(top.where(F.col("__side") == side).select(key, "seq", "__top"), [key, "seq"])
    return pick(0, left), pick(1, right)


def window_join(left: DataFrame, right: DataFrame, window: JoinWindow, how: str = "inner", key: str = "key", emit: str = "final", by_arrival: bool = False, retention_ms: int | None = None, buckets: bool = True) -> DataFrame:
    """Pairs inside the window, and the outer rows of ``how`` (inner, left, right, full).

    ``emit="final"``: an outer row has no partner at all. ``emit="eager"``: it had none among those
    that came before it; a later partner still makes a pair besides.
    ``by_arrival``: the window bounds later arrival minus earlier arrival instead of right minus left.
    ``retention_ms``: a row is forgotten once its key's newest time is further ahead than this.
    """
    if how not in ("inner", "left", "right", "full") or emit not in ("eager", "final"):
        raise ValueError(f"unknown join: {how}, {emit}")
    a, b = _with_top(left, right, key) if retention_ms is not None else (left, right)
    pairs = _pairs(a, b, window, key, by_arrival, retention_ms, buckets)
    out = pairs
    for side, df, other in (("left", left, "r"), ("right", right, "l")):
        if how in (side, "full"):
            own = side[0]
            met = pairs if emit == "final" else pairs.where(F.col(f"{other}_seq") < F.col(f"{own}_seq"))
            alone = df.select([F.col(c).alias(f"{own}_{c}") for c in df.columns]).join(met.select(f"{own}_seq").distinct(), f"{own}_seq", "left_anti")
            out = out.unionByName(alone, allowMissingColumns=True)
    return out


def evicted(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Which rows a buffer of ``most`` elements over both sides would hold at the end: the newest by time."""
    both = left.select("seq", "ms", F.lit("left").alias("side")).unionByName(right.select("seq", "ms", F.lit("right").alias("side")))
    return both.orderBy(F.desc("ms"), F.desc("seq")).limit(most)
