"""Aggregates with exact decimals, a registry of named ones, running folds and window functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Aggregate = Callable[[Column], Column]


def _exact(c: Column, scale: int) -> Column:
    return c.cast(f"decimal(18,{scale})")


def exact_sum(c: Column, scale: int = 2) -> Column:
    """Sum as decimal; nothing sums to 0."""
    return F.coalesce(F.sum(_exact(c, scale)), F.lit(0)).cast(f"decimal(38,{scale})")


def exact_avg(c: Column, scale: int = 2) -> Column:
    """Sum / count to ten places, half up; nothing averages to 0."""
    return F.coalesce(F.sum(_exact(c, scale)) / F.count(c), F.lit(0)).cast("decimal(38,10)")


REGISTRY: dict[str, Aggregate] = {"COUNT": F.count, "SUM": exact_sum, "AVERAGE": exact_avg, "MIN": F.min, "MAX": F.max}


def register(name: str, f: Aggregate) -> None:
    REGISTRY[name] = f


def named(name: str, c: Column) -> Column:
    if name not in REGISTRY:
        raise ValueError(f"no aggregate of that name: {name}")
    return REGISTRY[name](c)


def aggregate(df: DataFrame, keys: list[str], *, value: str, names: list[str], distinct: bool = False) -> DataFrame:
    """Named aggregates of ``value`` by ``keys``. ``distinct``: equal values of a group count once (values kept as a set)."""
    own = df.select(*keys, value)
    if distinct:
        own = own.distinct()
    return own.groupBy(*keys).agg(*[named(n, F.col(value)).alias(n.lower()) for n in names])


def collection_aggregate(df: DataFrame, keys: list[str], order: str, value: str, f: Callable[[Column], Column], name: str) -> DataFrame:
    """A function of all values of a group in arrival order, as an array expression."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("__all")).select(*keys, f(F.transform("__all", lambda x: x[value])).alias(name))


def running(df: DataFrame, keys: list[str], value: Column, name: str, how: str = "sum", seq: str = "seq") -> DataFrame:
    """The fold so far at each row of a key: sum, min, max or count, by arrival."""
    by = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    fold = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how]
    return df.withColumn(name, fold(value).over(by))


def running_fold(df: DataFrame, key: str, seq: str, value: str, start: float, step: Callable[[float, object], float], name: str) -> DataFrame:
    """Any reducer, as a Python function of fold and value, over a key's rows by arrival: the fold at each row.

    For reducers without a window function. Each key is streamed in its order, and only its fold is held.
    """
    own = df.select(key, F.col(seq).cast("bigint").alias(seq), value)
    kind = dict(own.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, begun = None, start, False
        for batch in batches:
            folds = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or k != now:
                    now, fold, begun = k, start, True
                fold = step(fold, x)
                folds.append(fold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(folds, pa.float64())], names=[key, seq, name])

    dealt = own.repartition(key).sortWithinPartitions(key, seq, value)
    return dealt.mapInArrow(run, f"{key} {kind[key]}, {seq} bigint, {name} double")


def greatest(fold: float, x: float | None) -> float:
    """The larger one; null is passed over, NaN is above all."""
    return fold if x is None or fold != fold or x <= fold else x


def window_elements(df: DataFrame, keys: list[str], value: str, seq: str = "seq") -> DataFrame:
    """Full panes: first, last and all values of a group in arrival order."""
    return df.groupBy(*keys).agg(F.min_by(value, seq).alias("first"), F.max_by(value, seq).alias("last"), F.transform(F.sort_array(F.collect_list(F.struct(seq, value))), lambda x: x[value]).alias("elements"))
