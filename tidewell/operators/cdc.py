"""Change data: the envelope, selection, application to tables, polling, and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.scalar import change_key, decoded_columns, table_allowed
from tidewell.operators.table import UpsertTable

ENVELOPE = (
    "seq bigint, event_type string, database string, table string, key string, before map<string,string>, after map<string,string>, "
    "timestamp timestamp, transaction_id string, position string, source string"
)
DATA = ("INSERT", "UPDATE", "DELETE")


def event_class(event_type: Column | str) -> Column:
    t = F.col(event_type) if isinstance(event_type, str) else event_type
    return F.when(t.isin(*DATA), "data").when(t == "SCHEMA_CHANGE", "schema").when(t.startswith("TRANSACTION"), "transaction").otherwise("other")


def selected(changes: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    return changes.where(table_allowed("database", "table", list(include), list(exclude)))


def applied(changes: DataFrame, key: str = "key", seq: str = "seq", event_type: str = "event_type") -> UpsertTable:
    """The table that the changes lead to: the last change of each key, without deleted keys."""
    return UpsertTable.from_stream(changes, key, seq, F.col(event_type) == "DELETE")


def event_rates(changes: DataFrame, event_type: str = "event_type", ms: str = "ms") -> DataFrame:
    """Count by type, and events a second over the type's span (nothing where the span is empty)."""
    span = (F.max(ms) - F.min(ms)) / 1000
    return changes.groupBy(event_type).agg(F.count("*").alias("n"), F.when(span > 0, F.count("*") / span).alias("per_second"))


def fan_in(*streams: DataFrame) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def as_inserts(rows: DataFrame, database: str, table: str, position: str, source: str = "polling") -> DataFrame:
    """Rows of a polled table as INSERT envelopes; ``position`` is the polling column."""
    after = F.map_from_arrays(F.array(*[F.lit(c) for c in rows.columns]), F.array(*[F.col(c).cast("string") for c in rows.columns]))
    return rows.select(
        F.lit("INSERT").alias("event_type"), F.lit(database).alias("database"), F.lit(table).alias("table"), change_key(after).alias("key"),
        F.lit(None).cast("map<string,string>").alias("before"), after.alias("after"), F.col(position).cast("string").alias("position"), F.lit(source).alias("source"),
    )


def polled(rows: DataFrame, column: str, last: object | None, inclusive: bool = False) -> DataFrame:
    """What a poll takes up: rows beyond the last position (``last=None``: all, the snapshot). ``inclusive`` rereads ties."""
    if last is None:
        return rows.orderBy(column)
    return rows.where(F.col(column) >= F.lit(last) if inclusive else F.col(column) > F.lit(last)).orderBy(column)


def polled_jdbc(spark: SparkSession, url: str, table: str, column: str, last: object | None, partitions: int = 8, **options: str) -> DataFrame:
    """A poll over JDBC; the filter is pushed to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, numPartitions=str(partitions), **options)
    return polled(reader.load(), column, last)


def decoded_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Text lines of logical decoding, ``table s.t: INSERT: col[type]:value ...``, as envelope columns."""
    head = r"^table ([^.\s]+)\.([^:\s]+): (INSERT|UPDATE|DELETE):\s?(.*)$"
    parts = lines.select(*[F.regexp_extract(value, head, k).alias(n) for k, n in enumerate(("database", "table", "event_type", "body"), 1)]).where("event_type != ''")
    old = F.regexp_extract("body", r"^old-key: (.*?) new-tuple:", 1)
    new = F.when(F.col("body").startswith("old-key:"), F.regexp_extract("body", r"new-tuple: (.*)$", 1)).otherwise(F.col("body"))
    both = parts.select("event_type", "database", "table", F.when(old != "", decoded_columns(old)).alias("__old"), decoded_columns(new).alias("__new"))
    gone = F.col("event_type") == "DELETE"
    out = both.select("event_type", "database", "table", F.when(gone, F.col("__new")).otherwise(F.col("__old")).alias("before"), F.when(~gone, F.col("__new")).alias("after"))
    return out.withColumn("key", change_key(F.coalesce("after", "before")))
