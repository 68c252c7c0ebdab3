"""Event-time windows: assigners as expressions, sessions, count windows, late rows.

Times are milliseconds; windows are half-open ``[start, end)``. Assigners add ``w_start`` and ``w_end``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(df: DataFrame, size_ms: int, ms: str = "ms", offset_ms: int = 0) -> DataFrame:
    start = F.col(ms) - F.pmod(F.col(ms) - offset_ms, F.lit(size_ms))
    return df.withColumn("w_start", start).withColumn("w_end", F.col("w_start") + size_ms)


def sliding(df: DataFrame, size_ms: int, slide_ms: int, ms: str = "ms") -> DataFrame:
    """Every window that holds the row; with a slide beyond the size, rows in the gaps have none."""
    last = F.col(ms) - F.pmod(F.col(ms), F.lit(slide_ms))
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max(0, -(-size_ms // slide_ms) - 1))), lambda k: last - k * slide_ms), lambda s: s + size_ms > F.col(ms))
    return df.withColumn("w_start", F.explode(starts)).withColumn("w_end", F.col("w_start") + size_ms)


def sliding_aggregate(df: DataFrame, keys: list[str], size_ms: int, slide_ms: int, partial: dict[str, Column], final: dict[str, Callable[[str], Column]], ms: str = "ms") -> DataFrame:
    """Sliding windows over slices: rows are aggregated once a slide, and only slices are copied to the windows they belong to.

    ``partial`` aggregates a slice's rows by name, ``final[name]`` its slices' values.
    """
    if size_ms % slide_ms:
        raise ValueError("the size must be a multiple of the slide")
    slices = df.withColumn("w_slice", F.col(ms) - F.pmod(F.col(ms), F.lit(slide_ms))).groupBy(*keys, "w_slice").agg(*[c.alias(n) for n, c in partial.items()])
    starts = F.transform(F.sequence(F.lit(0), F.lit(size_ms // slide_ms - 1)), lambda k: F.col("w_slice") - k * slide_ms)
    spread = slices.withColumn("w_start", F.explode(starts))
    return spread.groupBy(*keys, "w_start").agg(*[f(n).alias(n) for n, f in final.items()]).withColumn("w_end", F.col("w_start") + size_ms)


def sessions(df: DataFrame, keys: list[str], gap_ms: int, ms: str = "ms", touching: bool = True, merge: bool = True) -> DataFrame:
    """Session windows as ``w_start``, ``w_end`` of each row.

    ``touching``: a row exactly ``gap_ms`` after the one before still belongs to its session.
    ``merge=False``: each row keeps its own window ``[ms, ms + gap_ms)``.
    """
    if not merge:
        return df.withColumn("w_start", F.col(ms)).withColumn("w_end", F.col(ms) + gap_ms)
    by = Window.partitionBy(*keys).orderBy(ms)
    far = F.col(ms) - F.lag(ms).over(by)
    breaks = far > gap_ms if touching else far >= gap_ms
    marked = df.withColumn("__new", F.when(breaks, 1).otherwise(0))
    numbered = marked.withColumn("__session", F.sum("__new").over(by.rangeBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "__session")
    return numbered.withColumn("w_start", F.min(ms).over(own)).withColumn("w_end", F.max(ms).over(own) + gap_ms).drop("__new", "__session")


def session_aggregate(df: DataFrame, keys: list[str], gap_ms: int, aggregates: dict[str, Column], ms: str = "ms", touching: bool = True) -> DataFrame:
    """One row a session, with one shuffle: numbering and grouping share the partitioning by key."""
    by = Window.partitionBy(*keys).orderBy(ms)
    far = F.col(ms) - F.lag(ms).over(by)
    marked = df.withColumn("__new", F.when(far > gap_ms if touching else far >= gap_ms, 1).otherwise(0))
    numbered = marked.withColumn("__session", F.sum("__new").over(by.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__session").agg(F.min(ms).alias("w_start"), (F.max(ms) + gap_ms).alias("w_end"), *[c.alias(n) for n, c in aggregates.items()]).drop("__session")


def count_windows(df: DataFrame, keys: list[str], n: int, seq: str = "seq") -> DataFrame:
    """Every n rows of a key, by arrival: ``w_index`` from 0."""
    by = Window.partitionBy(*keys).orderBy(seq)
    return df.withColumn("w_index", F.floor((F.row_number().over(by) - 1) / n).cast("bigint"))


def custom(df: DataFrame, windows: Column) -> DataFrame:
    """Any assigner: ``windows`` is an array of structs ``start``, ``end`` for each row."""
    return df.withColumn("__w", F.explode(windows)).withColumn("w_start", F.col("__w.start")).withColumn("w_end", F.col("__w.end")).drop("__w")


def windows_intersect(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Strict: windows that only touch don't intersect."""
    return (a_start < b_end) & (b_start < a_end)


def count_trigger(df: DataFrame, keys: list[str], n: int, seq: str = "seq") -> DataFrame:
    """The rows at which a count trigger of each key and window fires."""
    by = Window.partitionBy(*keys).orderBy(seq)
    return df.withColumn("__k", F.row_number().over(by)).where(F.col("__k") % n == 0).drop("__k")


def watermark_before(df: DataFrame, bound_ms: int, ms: str = "ms", arrival: str = "arrival", keys: list[str] = (), exclusive: bool = False, slot: Column | None = None) -> DataFrame:
    """``wm``: the watermark each row meets, the largest time so far, itself included, less the bound (less 1 if ``exclusive``).

    Deal by a source or partition column in ``keys`` where there is one. Without keys the whole stream has
    one watermark; then ``slot``, a long that never falls as arrivals go on, deals the rows: only the largest
    time of each slot, and of each 4096 slots, is carried on, so no task sees all rows.
    Null arrivals come first; null times don't move the watermark.
    """
    less = bound_ms + (1 if exclusive else 0)
    if keys or slot is None:
        by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("wm", F.max(ms).over(by) - less)
    placed = df.withColumn("__slot", F.coalesce(slot.cast("bigint"), F.lit(-(2**62))))
    fine = placed.groupBy("__slot").agg(F.max(ms).alias("__most")).withColumn("__block", F.floor(F.col("__slot") / 4096))
    blocks = fine.groupBy("__block").agg(F.max("__most").alias("__most"))  # a row for each 4096 slots
    before = (Window.unboundedPreceding, -1)
    above = blocks.select("__block", F.max("__most").over(Window.orderBy("__block").rowsBetween(*before)).alias("__above"))
    inside = F.max("__most").over(Window.partitionBy("__block").orderBy("__slot").rowsBetween(*before))
    carried = fine.join(above, "__block").select("__slot", F.greatest("__above", inside).alias("__carried"))
    own = F.max(ms).over(Window.partitionBy("__slot").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(carried, "__slot").withColumn("wm", F.greatest(own, "__carried") - less).drop("__slot", "__carried")


def drop_late(df: DataFrame, lateness_ms: int = 0) -> DataFrame:
    """Rows whose window had not closed when they came: closing is ``w_end + lateness``, and lateness delays the only firing."""
    return df.where(F.col("wm") < F.col("w_end") + lateness_ms)


def late(df: DataFrame, lateness_ms: int = 0) -> DataFrame:
    """The side output: what ``drop_late`` leaves out."""
    return df.where(F.col("wm") >= F.col("w_end") + lateness_ms)
