"""Sinks, for batches and for ``foreachBatch``. Tables are Parquet folders; a batch is published by one rename-free overwrite of its own folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def print_rows(df: DataFrame, prefix: str = "", n: int = 20) -> None:
    for row in df.limit(n).collect():  # a console shows a page
        print(f"{prefix}{row.asDict(recursive=True)}")


def text_file(df: DataFrame, path: str, column: str, append: bool = False) -> None:
    df.select(F.col(column).cast("string")).write.mode("append" if append else "overwrite").text(path)


def kafka_ready(df: DataFrame, key: str | None = None, partition: str | None = None) -> DataFrame:
    """Rows as key, value and, if given, partition for ``format("kafka")``."""
    picks = [F.to_json(F.struct("*")).alias("value")]
    if key:
        picks.insert(0, F.col(key).cast("string").alias("key"))
    if partition:
        picks.append(F.col(partition).cast("int").alias("partition"))
    return df.select(*picks)


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(where)


def idempotent_append(path: str, id_column: str) -> Callable[[DataFrame, int], None]:
    """Append rows whose id, which must not be blank, isn't in the table yet, one row an id.

    A batch is written to ``path/batch_id=N``: a batch that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.trim(F.col(id_column).cast("string")) != "").dropDuplicates([id_column])
        if _exists(batch, path):
            known = spark.read.option("basePath", path).parquet(path).where(F.col("batch_id") != batch_id).select(id_column)
            new = new.join(known, id_column, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def upsert(path: str, key: str, seq: str, deleted: str | None = None) -> Callable[[DataFrame, int], None]:
    """Keep a table's latest row of each key in ``path/version=N``; readers take the greatest version. A deleted mark removes the key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch
        if batch_id > 0 and _exists(batch, f"{path}/version={batch_id - 1}"):
            rows = spark.read.parquet(f"{path}/version={batch_id - 1}").unionByName(batch, allowMissingColumns=True)
        values = [c for c in rows.columns if c != key]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*values), seq).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in values])
        (last.where(f"not coalesce({deleted}, false)") if deleted else last).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return write


def with_dead_letters(good_path: str, dead_path: str, ok: Column, error: Column) -> Callable[[DataFrame, int], None]:
    """Good rows and dead letters of a batch, each to its own table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("__ok", F.coalesce(ok, F.lit(False))).persist()
        try:
            marked.where("__ok").drop("__ok").write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
            marked.where("not __ok").drop("__ok").withColumn("error", error).write.mode("overwrite").parquet(f"{dead_path}/batch_id={batch_id}")
        finally:
            marked.unpersist()

    return write
