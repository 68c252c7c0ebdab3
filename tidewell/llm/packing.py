"""Packing of whole documents into fixed windows: bounded-space online best fit.

Each partition streams its documents through a fixed number of open windows. A document's
full windows go out at once; its rest is placed where it fits best. When it fits nowhere the
fullest window goes out: it is topped up with the start of the document if the gap is worth
a cut, and padded otherwise. Windows still open when a partition ends are leftovers; they
are merged by packing them again, with many partitions feeding one, until one round's
leftovers come from a single partition.

Memory of a task: the open windows and one batch of texts. Nothing passes through the driver
but a count. A lost executor repeats its partition, which gives the same pieces and numbers.

Defined cases: null text is empty, and an empty document is its end id alone; a null id or
a repeated row is a document of its own; no documents give no pieces; other columns
are not looked at; very long texts are cut into windows as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import in_arrow, settle, two_columns
from tidewell.llm.tokens import by_bytes, tokenizer

#: ids: little-endian unsigned 32-bit; start and doc_tokens: in the document; offset: in the sequence.
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"


class _Windows:
    """A fixed number of open windows. ``place`` yields closed windows as lists of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, most_open: int, worth_a_cut: int):
        self.size, self.most_open, self.worth_a_cut = size, most_open, worth_a_cut
        self.windows: list[tuple[int, list]] = []  # used, pieces

    def document(self, doc_id, ids: bytes) -> Iterator[list]:
        n, whole = len(ids) // 4, len(ids) // 4 // self.size * self.size
        for at in range(0, whole, self.size):
            yield [(doc_id, at, ids[4 * at : 4 * (at + self.size)], n)]
        if whole < n:
            yield from self.place([(doc_id, whole, ids[4 * whole :], n)], True)

    def place(self, pieces: list, may_cut: bool) -> Iterator[list]:
        need = sum(len(p[2]) // 4 for p in pieces)
        best = max((i for i, (used, _) in enumerate(self.windows) if used + need <= self.size), key=lambda i: self.windows[i][0], default=None)
        if best is None and len(self.windows) >= self.most_open:
            fullest = max(range(len(self.windows)), key=lambda i: self.windows[i][0])
            used, out = self.windows.pop(fullest)
            gap = self.size - used
            if may_cut and len(pieces) == 1 and gap >= self.worth_a_cut:
                doc_id, start, ids, n = pieces[0]
                out.append((doc_id, start, ids[: 4 * gap], n))
                pieces, need = [(doc_id, start + gap, ids[4 * gap :], n)], need - gap
            yield out
        if best is None:
            self.windows.append((need, list(pieces)))
        else:
            used, held = self.windows.pop(best)
            held.extend(pieces)
            if used + need == self.size:
                yield held
            else:
                self.windows.append((used + need, held))

    def rest(self) -> Iterator[list]:
        out, self.windows = [w[1] for w in self.windows], []
        yield from out


def _rows(first: int, windows: Iterator[tuple[list, bool]], at_once: int = 256) -> Iterator[pa.RecordBatch]:
    """Rows of the closed (False) and leftover (True) windows, numbered from ``first``."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
    rows: list[tuple] = []
    for k, (pieces, leftover) in enumerate(windows):
        offset = 0
        for doc_id, start, ids, n in pieces:
            rows.append((doc_id, start, len(ids) // 4, ids, n, first + k, offset, leftover))
            offset += len(ids) // 4
        if len(rows) >= at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _first(level: int) -> int:
    """Sequence numbers of a task: level, partition and a count, in 5 + 26 + 32 bits."""
    from pyspark import TaskContext

    return level << 58 | TaskContext.get().partitionId() << 32


def _closed(found: Iterator[list]) -> Iterator[tuple[list, bool]]:
    return ((w, False) for w in found)


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1, most_open: int = 64, worth_a_cut: int = 16, fan_in: int = 32) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Each id of a document and its end id lies in exactly one piece; a sequence holds at most
    ``size`` ids from offset 0 without gaps; what a sequence lacks to ``size`` is padding.
    ``worth_a_cut``: the smallest gap that is filled by cutting a document.
    ``fan_in``: so many partitions' leftovers meet in one task of the next round.
    """
    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, open_windows = tokenizer(tokenizer_path, end_id), _Windows(size, most_open, worth_a_cut)

        def windows() -> Iterator[tuple[list, bool]]:
            for batch in batches:
                texts = batch.column(1)
                ids_of = batch.column(0).to_pylist()
                strings = texts.to_pylist()
                for a, b in by_bytes(strings):
                    for doc_id, ids in zip(ids_of[a:b], tok.encode(strings[a:b]), strict=True):
                        yield from _closed(open_windows.document(doc_id, ids))
            for w in open_windows.rest():
                yield w, True

        return _rows(_first(0), windows())

    def merge_round(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_windows = _Windows(size, most_open, worth_a_cut)

            def windows() -> Iterator[tuple[list, bool]]:
                sequence, held = None, []
                for batch in batches:
                    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        if row[0] != sequence:
                            for piece in held:  # pieces one by one: small ones fill the gaps of others
                                yield from _closed(open_windows.place([piece], True))
                            sequence, held = row[0], []
                        held.append((row[2], row[3], row[4], row[5]))
                for piece in held:
                    yield from _closed(open_windows.place([piece], True))
                for w in open_windows.rest():
                    yield w, True

            return _rows(_first(level), windows())

        return run

    done = settle(two_columns(docs, key, text).transform(in_arrow, first_round, PIECES), "packed")
    closed, level = done.where("not open"), 1
    left = done.where("open")
    groups = left.select(F.expr("shiftright(sequence_id, 32) & 67108863").alias("p")).distinct().count()
    while groups > 1:
        groups = -(-groups // fan_in)
        merged = (
            left.withColumn("__to", F.expr(f"(shiftright(sequence_id, 32) & 67108863) % {groups}"))
            .repartition(groups, "__to").sortWithinPartitions("sequence_id", "offset")
            .select("sequence_id", "offset", "doc_id", "start", "ids", "doc_tokens").transform(in_arrow, merge_round(level), PIECES)
        )
        merged = settle(merged, "packed")
        closed, left, level = closed.unionByName(merged.where("not open")), merged.where("open"), level + 1
    return closed.unionByName(left).drop("open")
