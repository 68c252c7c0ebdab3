"""Event-time streams: strategies, windowed aggregates, de-duplication and joins by Spark's own operators.

Spark moves its watermark between micro-batches, not between records; panes are emitted when
the watermark passes their end, and those still open when a stream stops stay open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class WatermarkStrategy:
    """How far behind the greatest time seen rows are still expected, and how long panes wait besides.

    Allowed lateness delays the only firing of a pane, so it adds to the bound.
    """

    bound_ms: int = 0
    lateness_ms: int = 0

    @classmethod
    def monotonous(cls) -> WatermarkStrategy:
        return cls()

    @classmethod
    def bounded(cls, bound_ms: int, lateness_ms: int = 0) -> WatermarkStrategy:
        return cls(bound_ms, lateness_ms)

    def assign(self, df: DataFrame, ts: Column | str = "ts", name: str = "event_time") -> DataFrame:
        stamp = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")
        return df.withColumn(name, stamp).withWatermark(name, f"{self.bound_ms + self.lateness_ms} milliseconds")


NO_WATERMARK = None


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as a stream, in batches of files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).option("pathGlobFilter", "*.parquet").parquet(path)


def windowed(df: DataFrame, keys: list[str], size: str, slide: str | None = None, time: str = "event_time", **aggregates: Column) -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.unix_millis("w.start").alias("w_start"), F.unix_millis("w.end").alias("w_end"), *aggregates)


def sessions(df: DataFrame, keys: list[str], gap: str, time: str = "event_time", **aggregates: Column) -> DataFrame:
    out = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.unix_millis("w.start").alias("w_start"), F.unix_millis("w.end").alias("w_end"), *aggregates)


def first_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key while its state lives, which is as long as the watermark says."""
    return df.dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, before: str, after: str, how: str = "inner", time: str = "event_time") -> DataFrame:
    """``right - left`` between ``-before`` and ``after``; outer rows come once the watermark has passed."""
    l = left.select([F.col(c).alias(f"l_{c}") for c in left.columns])
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    on = F.expr(f"l_{key} = r_{key} and r_{time} >= l_{time} - interval {before} and r_{time} <= l_{time} + interval {after}")
    return l.join(r, on, {"left": "leftOuter", "right": "rightOuter", "full": "fullOuter"}.get(how, how))


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take up what there is, then stop; for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_batches(df: DataFrame, write, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """``write(batch, batch_id)`` for each micro-batch; offsets and state restart from the checkpoint."""
    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def progress(query: StreamingQuery) -> dict:
    """Rows read, rows dropped as late, and state rows, summed over the query's recent batches."""
    recent = [p for p in query.recentProgress]
    operators = [o for p in recent for o in p["stateOperators"]]
    return {
        "input_rows": sum(p["numInputRows"] for p in recent),
        "late_rows": sum(o["numRowsDroppedByWatermark"] for o in operators),
        "state_rows": max([0, *(o["numRowsTotal"] for o in operators)]),
    }
