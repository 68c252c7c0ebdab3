"""Sources: collections, files, generators, messages, HTTP payloads, a Python data source."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MESSAGE = "id string, topic string, key string, payload string, headers map<string,string>, timestamp timestamp, publisher string, retryCount int, maxRetries int"
_SOURCE_ID = re.compile(r"[A-Za-z0-9_.-]+")


def from_elements(spark: SparkSession, values: Iterable[Any], schema: str = "v string") -> DataFrame:
    """Literal rows with arrival order ``seq`` and event time ``ms`` 0..N-1."""
    rows = [(i, i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"seq bigint, ms bigint, {schema}")


def text_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return spark.readStream.text(path) if streaming else spark.read.text(path)


def sequence(spark: SparkSession, count: int, start: int = 0, partitions: int | None = None) -> DataFrame:
    return spark.range(start, start + count, 1, partitions).select(F.col("id").alias("v"))


def generated(spark: SparkSession, rows_per_second: int = 1, partitions: int = 1) -> DataFrame:
    """An endless stream of (timestamp, value)."""
    return spark.readStream.format("rate").options(rowsPerSecond=str(rows_per_second), numPartitions=str(partitions)).load()


def checked_source_id(name: str, known: set[str]) -> str:
    """Source ids are letters, digits, ``_ . -`` and unique in a job."""
    if not _SOURCE_ID.fullmatch(name) or name in known:
        raise ValueError(f"not a usable source id: {name!r}")
    known.add(name)
    return name


def kafka(spark: SparkSession, servers: str, topic: str, streaming: bool = True, starting: str = "earliest", **options: str) -> DataFrame:
    """Raw records of a topic; needs the Kafka package on the cluster. Positions are the query's checkpoint."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    return reader.options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting} | options).load()


def decoded(df: DataFrame, schema: str, value: str = "value", keep_bad: bool = False) -> DataFrame:
    """JSON payloads as ``data``; records that don't decode are left out, or kept with null data."""
    out = df.withColumn("data", F.from_json(F.col(value).cast("string"), schema, {"mode": "PERMISSIVE"}))
    valid = F.try_parse_json(F.col(value).cast("string")).isNotNull()
    out = out.withColumn("data", F.when(valid, F.col("data")))
    return out if keep_bad else out.where("data is not null")


def decoded_list(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """A JSON list of objects, a row each; a single object is a list of one."""
    text = F.trim(F.col(value).cast("string"))
    whole = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return df.withColumn("data", F.explode(F.from_json(whole, f"array<struct<{schema}>>")))


class HttpSource(DataSource):
    """``spark.read.format("http_json").option("urls", "u1 u2")``: one partition a URL, one row an object of its JSON.

    An answer other than 200 or one that isn't JSON gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "url string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HttpReader(self.options)


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls, self.timeout = options.get("urls", "").split(), float(options.get("timeoutSeconds", "10"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        try:
            with urllib.request.urlopen(partition.value, timeout=self.timeout) as answer:
                found = json.loads(answer.read()) if answer.status == 200 else []
        except (OSError, ValueError):
            return
        for item in found if isinstance(found, list) else [found]:
            yield partition.value, json.dumps(item)
