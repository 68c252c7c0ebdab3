"""Sessions, tables and the time column that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def build_session(name: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and the RocksDB state store; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone; doesn't depend on the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a table: arrival order ``seq``, event time ``ms``, and the payload."""
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), epoch_ms("ts").alias("ms"), "user_id", "event_type", "value", "props")
