"""Token ids in files: bit- or byte-plane shuffled chunks, each plane compressed, with an index.

Layout of a shard (integers little-endian):

    magic "TIDEWTK1"
    chunks: for each, its planes one after another, each a zstandard frame
    document table: zstandard frame of doc_id int64[], then ids-of-document int64[], then null flags uint8[]
    index: uint32 ids, uint64 place, uint32 bytes of each plane, for each chunk
    tail: uint64 place of the document table, uint32 its bytes, uint64 documents,
          uint64 place of the index, uint32 chunks, uint8 planes (4 byte planes or 32 bit planes), magic

A chunk holds ``chunk_ids`` ids (the last one fewer). Transposed into planes, the high bytes
or bits of all ids lie together, and those hardly vary.

The documents are range-partitioned and sorted by doc_id, so shard k holds the ids before
those of shard k + 1. A task writes beside its shard's name and then renames: a task that is
repeated after a lost executor writes the same bytes under the same name.

Defined cases: null text is empty, and an empty document is its end id alone; a null doc_id
sorts first; rows with equal doc_id are documents of their own, in the order of their texts;
no documents give no shards and no rows; other columns are not looked at; a very long text
runs over as many chunks as it needs.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import in_arrow, settle, shared_dir, two_columns
from tidewell.llm.tokens import by_bytes, tokenizer

MAGIC = b"TIDEWTK1"
_TAIL = struct.Struct("<QIQQIB8s")


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of unsigned 32-bit ids; bit planes hold 8 ids in a byte."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class ShardWriter:
    """Streams documents into one shard; memory: one chunk, and two integers a document."""

    def __init__(self, out, chunk_ids: int = 1 << 16, planes: int = 4, level: int = 3):
        self.out, self.chunk_ids, self.planes = out, chunk_ids, planes
        self.zip = zstandard.ZstdCompressor(level=level)
        self.place, self.held, self.held_bytes = 0, [], 0
        self.index: list[bytes] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self._write(MAGIC)

    def _write(self, b: bytes) -> None:
        self.out.write(b)
        self.place += len(b)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= 4 * self.chunk_ids:
            self._chunks(b"".join(self.held), False)

    def _chunks(self, raw: bytes, last: bool) -> None:
        at, step = 0, 4 * self.chunk_ids
        while at + step <= len(raw) or last and at < len(raw):
            ids = np.frombuffer(raw[at : at + step], "<u4")
            zipped = [self.zip.compress(p) for p in to_planes(ids, self.planes)]
            self.index.append(struct.pack(f"<IQ{self.planes}I", len(ids), self.place, *map(len, zipped)))
            for z in zipped:
                self._write(z)
            at += step
        self.held, self.held_bytes = [raw[at:]], max(0, len(raw) - at)

    def close(self) -> tuple[int, int]:
        """(documents, ids)"""
        self._chunks(b"".join(self.held), True)
        at = self.place
        table = self.zip.compress(np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.sizes, "<i8").tobytes() + np.array([d is None for d in self.docs], np.uint8).tobytes())
        self._write(table)
        index_at = self.place
        self._write(b"".join(self.index))
        self._write(_TAIL.pack(at, len(table), len(self.docs), index_at, len(self.index), self.planes, MAGIC))
        return len(self.docs), sum(self.sizes)


class ShardReader:
    """Random access by chunk: ``chunk(k)``; ``documents()`` streams (doc_id, start in shard, ids)."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - _TAIL.size)
        at, table_bytes, self.n_docs, index_at, self.n_chunks, self.planes, magic = _TAIL.unpack(source.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(at)
        table = zstandard.ZstdDecompressor().decompress(source.read(table_bytes))
        n = self.n_docs
        self.doc_ids, self.sizes, self.nulls = np.frombuffer(table, "<i8", n), np.frombuffer(table, "<i8", n, 8 * n), np.frombuffer(table, np.uint8, n, 16 * n)
        source.seek(index_at)
        entry = struct.Struct(f"<IQ{self.planes}I")
        self.index = [entry.unpack(source.read(entry.size)) for _ in range(self.n_chunks)]

    def chunk(self, k: int) -> np.ndarray:
        n, place, *sizes = self.index[k]
        self.source.seek(place)
        unzip = zstandard.ZstdDecompressor()
        return from_planes([unzip.decompress(self.source.read(s)) for s in sizes], n)

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        held, start, k = b"", 0, 0
        for doc_id, n, null in zip(self.doc_ids.tolist(), self.sizes.tolist(), self.nulls.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < 4 * n:
                parts.append(self.chunk(k).tobytes())
                have, k = have + len(parts[-1]), k + 1
            held = b"".join(parts)
            yield (None if null else doc_id), start, held[: 4 * n]
            held, start = held[4 * n :], start + n


def write_tokens(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 1, chunk_ids: int = 1 << 16, planes: int = 4, to: str | None = None) -> DataFrame:
    """Write all documents' ids to shards in ascending doc_id order; return the manifest.

    A manifest row: shard, path, documents, ids, ids_before (of all earlier shards).
    ``to``: a folder that all executors see; else one in the shared folder.
    """
    spark = docs.sparkSession
    folder = (to or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        files, root = pafs.FileSystem.from_uri(folder)
        tok, writer, out = tokenizer(tokenizer_path, end_id), None, None
        name = f"{root}/shard-{shard:07d}.tok"
        beside = f"{root}/.{shard:07d}-{uuid.uuid4().hex}"
        for batch in batches:
            ids_of, strings = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in by_bytes(strings):
                for doc_id, ids in zip(ids_of[a:b], tok.encode(strings[a:b]), strict=True):
                    if writer is None:
                        files.create_dir(root, recursive=True)
                        out = files.open_output_stream(beside)
                        writer = ShardWriter(out, chunk_ids, planes)
                    writer.add(doc_id, ids)
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            files.move(beside, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [f"{folder}/shard-{shard:07d}.tok"], "documents": pa.array([n_docs], pa.int64()), "ids": pa.array([n_ids], pa.int64())})

    shards = (
        two_columns(docs, key, text).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .transform(in_arrow, write, "shard long, path string, documents long, ids long")
    )
    manifest = settle(shards, "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return manifest.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document from the shards: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, name = pafs.FileSystem.from_uri(path)
                with files.open_input_file(name) as source:
                    rows, size = [], 0
                    for doc_id, start, ids in ShardReader(source).documents():
                        rows.append((doc_id, before + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 1 << 22:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    spread = manifest.select("path", "ids_before").repartition(max(1, manifest.count()))  # a task for about each shard
    return spread.transform(in_arrow, read, "doc_id long, start long, n_tokens long, ids binary")
