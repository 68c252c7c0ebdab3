"""Helpers shared by the corpus operators: tables, shared scratch tables, SQL-side let-bindings."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as Python's ``bytes.split`` sees it, which is also ``[\x20\x09-\x0D]``.
WS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a local one for a local master, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of rows that Spark hands to Python at once: a worker holds a batch as Arrow data, as Python objects and as output.
BATCH_BYTES = 4 << 20


def _give_back() -> None:
    """Free memory of the worker goes back to the system, so that an idle worker is small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes; the session's limit is lowered to ``BATCH_BYTES``, never raised."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, None)
    if now is None or not 0 < int(re.match(r"-?\d+", now)[0]) <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(small, schema)


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later jobs start from the written table: it is computed once, its lineage ends there,
    and it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that is always a shuffle, for tables that grow with the input: nothing of them is broadcast from the driver."""
    return df.hint("merge")


#: Places of the bitmap of ``marked``: 131,072 words of 64 bits are broadcast at most, and eight times that by ``places_for``.
PLACES = 1 << 23
MOST_PLACES = 1 << 26


def places_for(n: int) -> int:
    """Places for a bitmap of ``n`` keys: at most one in eight is set, as long as ``MOST_PLACES`` allow it."""
    return min(MOST_PLACES, max(PLACES, 1 << (8 * n - 1).bit_length()))


def marked(df: DataFrame, by: Column, keys: DataFrame, key: str, name: str = "__maybe", places: int = PLACES) -> DataFrame:
    """``name``: false only where ``by``, a 64-bit hash, isn't among ``keys``; so rows without a partner needn't be shuffled to a join.

    The hashes are set in a bitmap of ``places``. Many keys make it less choosy, never wrong.
    """
    place = F.pmod(F.col(key), F.lit(places))
    words = keys.select(place.alias("p")).select(F.shiftright("p", 6).alias("__word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    placed = df.withColumn("__place", F.pmod(by, F.lit(places)))
    found = placed.join(F.broadcast(words), F.shiftright("__place", 6) == F.col("__word"), "left")
    return found.withColumn(name, F.expr("coalesce((shiftright(__bits, cast(__place & 63 as int)) & 1) = 1, false)")).drop("__place", "__word", "__bits")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A lambda variable can't be inlined by the optimizer, so an array used inside nested
    lambdas isn't computed anew for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def two_columns(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text (null: empty), so that other columns can't clash with ours."""
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
